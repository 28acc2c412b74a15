"""What the operators need of a session: lineage cuts, and batches of a bounded size."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.cuts import discard, shared_dir, written

__all__ = ["BATCH", "bounded_batches", "discard", "shared_dir", "written"]

#: Rows of an Arrow batch at most, so that tasks hold a few megabytes of texts at once.
BATCH = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH``, unless they are fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))
