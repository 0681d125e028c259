import pytest
from pyspark.sql import functions as F

from edgelens.operators import enforce
from edgelens.streaming import guard


@pytest.fixture
def arrivals(spark, tmp_path):
    """Requests of five ips in four files by time, some without a time or an ip; the stream of them and the table."""
    rows = spark.range(400).select(
        F.when(F.col("id") % 29 != 0, F.concat(F.lit("10.0.0."), (F.col("id") % 5).cast("string"))).alias("ip"),
        F.when(F.col("id") % 31 != 1, F.timestamp_micros(1_700_000_000_000_000 + F.col("id") * 700_000)).alias("ts"),
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 != 0, F.col("id") % 37 == 0).alias("block"),
    )
    rows = rows.filter((F.col("event_id") < 100) | F.col("ts").isNotNull())  # a null time sorts first, so it is to come first
    for i in range(4):
        rows.filter(F.col("event_id").between(100 * i, 100 * i + 99)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in/*"))
    return stream, rows


def streamed(spark, found, tmp_path):
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_buckets_equal_batch(spark, arrivals, tmp_path):
    stream, rows = arrivals
    got = streamed(spark, guard.token_bucket(stream, 0.2, 3), tmp_path)
    want = enforce.rate_limited(rows, 0.2, 3).filter("ip is not null")
    assert 0 < want.filter("allowed").count() < want.count()
    assert sorted(map(tuple, got.select("event_id", "allowed").collect())) == sorted(map(tuple, want.select("event_id", "allowed").collect()))


def test_streamed_decisions_equal_batch(spark, arrivals, tmp_path):
    stream, rows = arrivals
    got = streamed(spark, guard.decisions(stream, 0.2, 3, 40, True), tmp_path)
    want = enforce.decisions(rows, 0.2, 3, 40, True)
    assert {r.decision for r in want.select("decision").distinct().collect()} == {"allowed", "limited", "blocked", "banned"}
    assert sorted(map(tuple, got.select("event_id", "decision").collect())) == sorted(map(tuple, want.select("event_id", "decision").collect()))


def test_late_requests_do_not_turn_a_bucket_back():
    start, step = enforce.bucket_step(1.0, 2)
    state, _ = step(start, 10.0)
    state, _ = step(state, 4.0)
    assert state == (0.0, 10.0) and step(state, 10.5)[1] is False and step(state, 11.0)[1] is True
