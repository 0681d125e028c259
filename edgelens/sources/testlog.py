"""An access log derived from the ``events`` table: 30 days pressed into one hour, as records and as log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"
SQUEEZE = 720


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, t, site, ip, method, path, query and status of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    t = F.timestamp_micros(start + F.expr(f"(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'{START}')) div {SQUEEZE}"))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    user, event, kind = F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type")
    rows = e.select("event_id", "user_id", "event_type", t.alias("t"), k.alias("k"))
    k = F.col("k")
    path = (
        F.when(kind == "view", F.concat(F.lit("/api/products/"), event))
        .when(kind == "click", F.concat(F.lit("/v1/files/"), F.md5(event)))
        .when(kind == "purchase", F.concat(F.lit("/api/users/"), user, F.lit("/orders/"), event))
        .when(kind == "signup", "/signup")
        .otherwise(F.concat(F.lit("/download/tok"), (F.col("event_id") + 100000000).cast("string"), F.lit("/file")))
    )
    query = F.concat(F.lit("k="), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("&u="), user)).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("&k="), (k + 1).cast("string"))).otherwise(""))
    failed = F.when(k % 3 == 0, 500).when(k % 3 == 1, 404).otherwise(400)
    status = F.when(kind == "error", failed).when(kind == "signup", 302).when(kind == "purchase", 201).when((kind == "click") & (F.col("t") >= F.lit("2024-01-01 00:58:00").cast("timestamp")), 503).otherwise(200)
    return rows.select(
        "event_id",
        "t",
        F.concat(F.lit("site-"), (F.col("user_id") % 3).cast("string")).alias("site"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        path.alias("path"),
        query.alias("query"),
        status.cast("int").alias("status"),
    )


def lines(rows: DataFrame) -> DataFrame:
    """event_id, value and site of the log line of each row of ``access``: combined for even event_id, JSON for odd."""
    target = F.concat("path", F.lit("?"), "query")
    size = F.col("event_id") % 5000
    plain = F.format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "-" "agent/1.0"', "ip", F.date_format("t", "dd/MMM/yyyy:HH:mm:ss"), "method", target, "status", size)
    json = F.to_json(F.struct(
        F.lit(1).alias("v"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("time"), F.lit("192.0.2.1").alias("remote_addr"),
        F.concat("ip", F.lit(", 192.0.2.1")).alias("forwarded_for"), "method", target.alias("uri"), "status", size.alias("bytes_sent"),
        F.lit("-").alias("referer"), F.lit("agent/1.0").alias("user_agent"), F.lit("example.org").alias("host"),
    ))
    return rows.select("event_id", F.when(F.col("event_id") % 2 == 0, plain).otherwise(json).alias("value"), "site")
