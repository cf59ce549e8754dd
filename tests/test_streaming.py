from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern import streaming
from quern.operators import state as st

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    d.repartition(2).write.parquet(f"{tmp_path}/in")
    return d, lambda: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")


def run(frame, mode, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return frame.sparkSession.table(name)


def test_windowed_counts_equal_batch(stream):
    batch, read = stream
    got = run(streaming.windowed_counts(read(), "ts", "6 hours", "40 days", "event_type"), "update", "windows")
    last = got.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = st.tumbling(batch, "ts", "6 hours", "event_type")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_first_seen(stream):
    batch, read = stream
    got = run(streaming.first_seen(read(), ["user_id"], "ts", "60 days"), "append", "firsts")
    assert got.count() == batch.select("user_id").distinct().count()


def test_health(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    lots = [[("a", t0, False), ("a", t0 + timedelta(seconds=1), False), ("b", t0, True)], [("c", t0 + timedelta(hours=2), True)], [("a", t0 + timedelta(hours=2, seconds=5), True)]]
    for rows in lots:
        spark.createDataFrame(rows, "engine string, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
        read = spark.readStream.schema("engine string, ts timestamp, ok boolean").parquet(f"{tmp_path}/h")
        q = streaming.health(read, "engine", "ts", "ok").writeStream.foreachBatch(lambda d, _: d.write.mode("append").parquet(f"{tmp_path}/out"))
        q = q.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        q = q.start()
        q.awaitTermination(120)
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("updated", "ema").select("engine", "failures", "state").collect()]
    assert ("a", 2, "open") in rows and ("b", 0, "closed") in rows and ("a", 0, "closed") in rows
    a = spark.read.parquet(f"{tmp_path}/out").where("engine = 'a'").agg(F.min("ema").alias("e")).first().e
    assert abs(a - 0.81) < 1e-9
