"""Cursors as offsets: a stream over runs of posts loses and repeats nothing, whenever it stops."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from almanack.operators import state
from almanack.sources import connectors

SCHEMA = "id long, account string, likes int"


def drained(spark, path, out, fail=False):
    posts = spark.readStream.format("post_log").schema(SCHEMA).option("path", path).load()
    if fail:
        posts = posts.withColumn("likes", F.when(F.col("id") % 7 == 6, F.raise_error(F.lit("stopped")).cast("int")).otherwise(F.col("likes")))
    posts.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()


def test_a_stopped_query_goes_on_where_it_was(spark, tmp_path):
    connectors.register(spark)
    path, out = str(tmp_path / "posts"), str(tmp_path / "out")
    run = lambda a, b: spark.range(a, b).selectExpr("id", "concat('a', id % 3) AS account", "CASE WHEN id % 2 = 0 THEN CAST(id AS INT) END AS likes").repartition(3)
    connectors.append_run(run(0, 5), path, 1)
    drained(spark, path, out)
    drained(spark, path, out)  # nothing new
    connectors.append_run(run(5, 20), path, 2)
    with pytest.raises(Exception, match="stopped"):
        drained(spark, path, out, fail=True)
    connectors.append_run(run(20, 22), path, 3)
    run(90, 95).write.json(f"{path}/run-{4:09d}")  # in the making: no marker
    connectors.append_run(run(22, 23), path, 5)  # waits for run 4
    drained(spark, path, out)  # the batch that broke off, with the end that it had
    drained(spark, path, out)
    rows = lambda: sorted(((r.id, r.account, r.likes) for r in spark.read.schema(SCHEMA).parquet(f"{out}/rows").collect()), key=lambda r: (r[0] is None, r[0]))
    want = [(i, f"a{i % 3}", i if i % 2 == 0 else None) for i in range(22)]
    assert rows() == want
    Path(path, f"run-{4:09d}", "part-x.json").write_text('{"id": 30, "account": "a0", "more": [1]}\n[1]\nnot json\n\n{"account": "é"}\n')
    Path(path, f"run-{4:09d}.done").write_bytes(b"")
    drained(spark, path, out)
    assert rows() == [*want, (22, "a1", 22), (30, "a0", None), *((i, f"a{i % 3}", i if i % 2 == 0 else None) for i in range(90, 95)), (None, "é", None)]


def test_refetch_depth_follows_the_yield(spark):
    rows = [(9, 9, 3), (10, 10, 8), (10, 5, 5), (100, 9, 1), (100, 10, 3), (0, 0, 3)]
    df = spark.createDataFrame(rows, "seen long, found long, want int")
    assert all(r.got == r.want for r in df.withColumn("got", state.refetch_depth(F.col("seen"), F.col("found"))).collect())


def test_stale(spark):
    df = spark.createDataFrame([(None, True), ("2024-01-01", True), ("2024-03-01", False)], "d string, want boolean").withColumn("d", F.col("d").cast("date"))
    assert all(r.got == r.want for r in df.withColumn("got", state.stale(F.col("d"), F.lit("2024-03-10").cast("date"))).collect())
