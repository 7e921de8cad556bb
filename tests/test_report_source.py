import pytest
from pyspark.sql import functions as F

from corpusflow.sources import report_source


@pytest.fixture()
def report(spark, tmp_path):
    report_source.register(spark)
    return f"file://{tmp_path}/report", tmp_path / "report"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_save_and_load(spark, report):
    uri, _ = report
    one = spark.createDataFrame([(1, "é", [1.5, 2.0], True), (2, None, None, None)], "id long, name string, v array<double>, ok boolean").repartition(2)
    one.write.format(report_source.NAME).mode("append").save(uri)
    loaded = spark.read.format(report_source.NAME).load(uri)
    assert loaded.schema == one.schema and rows(loaded) == rows(one)
    two = spark.createDataFrame([(3, "x", [], False)], one.schema)
    two.write.format(report_source.NAME).mode("append").save(uri)
    assert rows(spark.read.format(report_source.NAME).load(uri)) == rows(one.union(two))
    assert rows(spark.read.format(report_source.NAME).schema("name string").load(uri)) == rows(one.union(two).select("name"))
    two.write.format(report_source.NAME).mode("overwrite").save(uri)
    assert rows(spark.read.format(report_source.NAME).load(uri)) == rows(two)
    two.limit(0).write.format(report_source.NAME).mode("overwrite").save(uri)
    assert rows(spark.read.format(report_source.NAME).load(uri)) == []


def test_an_aborted_write_leaves_nothing(spark, report):
    uri, path = report
    good = spark.range(3)
    good.write.format(report_source.NAME).mode("append").save(uri)
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format(report_source.NAME).mode("append").save(uri)
    assert rows(spark.read.format(report_source.NAME).load(uri)) == [(0,), (1,), (2,)]
    assert len([p for p in (path / "manifest").iterdir() if p.suffix == ".json"]) == 1


def test_stream_reads_each_commit_once(spark, report, tmp_path):
    uri, _ = report
    out = f"{tmp_path}/out"

    def run():
        stream = spark.readStream.format(report_source.NAME).load(uri)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)

    for start in (0, 10):
        spark.range(start, start + 5).write.format(report_source.NAME).mode("append").save(uri)
        run()
    run()
    assert rows(spark.read.parquet(out)) == sorted(((i,) for i in (*range(5), *range(10, 15))), key=repr)


def test_no_commit_needs_a_schema(spark, report):
    with pytest.raises(Exception, match="no commit"):
        spark.read.format(report_source.NAME).load(report[0]).schema  # noqa: B018
    assert spark.read.format(report_source.NAME).schema("id long").load(report[0]).count() == 0
