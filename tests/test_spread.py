"""Rows of few bytes that much is made of are dealt over all cores, and what is computed once isn't computed again."""

import json

from pyspark.sql import functions as F

from inkwell import cloud, queries


def test_analyses_are_dealt_over_cores(spark, tmp_path):
    rows = [(i, f"n{i}") for i in range(40)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.QUERIES["cu_format"](spark, str(tmp_path))
    tasks = out.select("doc_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in tasks}) >= 4
    assert out.count() == 40


def test_analyses_with_odd_fields(spark):
    """Fields that are no object are left out, the others stay."""
    given = [{"fields": [1], "contents": [{"fields": {"a": {"value": 'q"\\'}}, "text": " x "}, {"fields": {"a": {"content": 2}, "b": "y"}}]}, {"fields": {}, "markdown": "m"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(given)], "i int, j string")
    got = [r.m for r in df.orderBy("i").select(cloud.markdown_of(F.col("j")).alias("m")).collect()]
    assert got == [cloud.result_markdown(r) for r in given]


def test_files_are_made_on_all_cores(spark):
    rows = spark.createDataFrame([(i, "n") for i in range(40)], "k long, n string").coalesce(1)
    made = queries._files(rows, "k", lambda k, n: f"{k}{n}".encode(), ".txt", ["k", "n"])
    got = made.select("doc_id", "content", F.spark_partition_id().alias("task")).collect()
    assert {(r.doc_id, bytes(r.content)) for r in got} == {(i, f"{i}n".encode()) for i in range(40)} and len({r.task for r in got}) >= 4
