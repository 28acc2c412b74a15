from assetlake.operators import inventory
from assetlake.plans import catalogue, reports


def test_reports(spark, sf, tmp_path):
    files = catalogue.labelled(spark, sf)
    summary = inventory.summary(files)
    reports.write_tables(str(tmp_path / "tables"), summary=summary, files=files.drop("content", "text"))
    assert spark.read.parquet(str(tmp_path / "tables/summary")).count() == summary.count()
    reports.write_text(reports.summary_lines(summary), str(tmp_path / "summary"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "summary")).collect()]
    assert lines[0].startswith("total  *  *  200  ") and len(lines) == summary.count()
    listing = reports.listing(files.drop("ordinal").withColumnRenamed("format", "detected_format")).collect()
    assert len(listing) == 200 and listing[0].line.split()[0] == "1"
