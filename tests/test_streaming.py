import os
import tempfile

from pyspark.sql import functions as F

from panelspark.operators import trends as W
from panelspark.streaming import trends as ST

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_daily_trend_matches_batch(spark):
    schema = spark.read.parquet(EVENTS).schema
    stream = ST.read_stream(spark, os.path.dirname(EVENTS), schema, glob="events.parquet")
    q = ST.start(ST.daily_trend_stream(stream, "ts", {"avg_value": "value"}, watermark="0 seconds"), "w1_stream",
                 os.path.join(tempfile.mkdtemp(prefix="panelspark-stream-"), "ckpt"), mode="complete")
    try:
        q.processAllAvailable()
        got = {r.day: (r.n, round(r.avg_value, 9)) for r in spark.sql("SELECT * FROM w1_stream").collect()}
    finally:
        q.stop()
    batch = W.daily_trend(spark.read.parquet(EVENTS), "ts", {"avg_value": "value"}, count_name="n")
    exp = {r.day: (r.n, round(r.avg_value, 9)) for r in batch.collect()}
    assert got == exp


def test_stream_running_kpis(spark):
    schema = spark.read.parquet(EVENTS).schema
    stream = ST.read_stream(spark, os.path.dirname(EVENTS), schema, glob="events.parquet")
    q = ST.start(ST.running_kpis(stream, {"avg_value": "value"}), "a1_stream",
                 os.path.join(tempfile.mkdtemp(prefix="panelspark-stream-"), "ckpt"), mode="complete")
    try:
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM a1_stream").collect()[0]
    finally:
        q.stop()
    b = spark.read.parquet(EVENTS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v")).collect()[0]
    assert r.n == b.n and abs(r.avg_value - b.v) < 1e-9
