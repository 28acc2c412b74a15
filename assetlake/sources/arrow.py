"""Rows of Python tuples in and out of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_map(rows: DataFrame, f: Callable[..., Iterable[tuple]], schema: str | StructType, block: int = 256) -> DataFrame:
    """f(*row) -> output rows, in Arrow batches of ``block`` rows."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)  # here: tasks have no session

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in f(*row):
                    out.append(made)
                    if len(out) >= block:
                        yield _batch(out, arrow)
                        out = []
        if out:
            yield _batch(out, arrow)

    return rows.mapInArrow(run, kind)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that stand for work, dealt by columns over four tasks a core. Their number is given, so that small rows are not
    put together again."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
