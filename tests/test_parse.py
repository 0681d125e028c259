import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgelens.functions import normalize, query_string
from edgelens.functions.parse import parse_lines, status_class
from edgelens.operators import rollup

AT = "2026-01-01 00:00:00"
LINE = '203.0.113.9 - - [15/Jul/2026:13:04:05 +0200] "GET /api/users/42?a=1 HTTP/1.1" {} 512 "-" "curl/8"'


def parse(spark, *lines):
    return parse_lines(spark.createDataFrame([(x, "shop") for x in lines], "value string, site string"), F.lit(AT).cast("timestamp")).collect()


def test_combined(spark):
    (r,) = parse(spark, LINE.format(200))
    assert (r.ip, r.method, r.path, r.query, r.status, r.bytes, r.referer, r.ua) == ("203.0.113.9", "GET", "/api/users/42", "a=1", 200, 512, "-", "curl/8")
    assert r.tz_offset_s == 7200 and r.ts == dt.datetime(2026, 7, 15, 11, 4, 5)


def test_lines_that_do_not_parse(spark):
    bad = ["not a log line", "{not json at all", "", '1.1.1.1 - - [x] "-" 400 0 "-" "-"', '1.1.1.1 - - [x] "GET /" 400 0 "-" "-"', '{"uri":"/a","status":"x"}', '{"uri":"","status":200}', '{"uri":"/a","status":200} tail', "{'uri':'/a','status':200}"]
    assert parse(spark, *bad) == []


def test_json_first_hop_and_defaults(spark):
    rows = parse(
        spark,
        '{"v":1,"time":"2026-07-15T13:04:05+05:30","remote_addr":"10.0.0.1","forwarded_for":" 198.51.100.7 , 10.0.0.1","method":"POST","uri":"/x?y=1?z","status":503,"bytes_sent":7,"host":"h"}',
        '  {"time":"bad","remote_addr":"10.0.0.2","forwarded_for":"-","uri":"/y","status":200}  ',
    )
    by = {r.path: r for r in rows}
    assert by["/x"].ip == "198.51.100.7" and by["/x"].query == "y=1?z" and by["/x"].tz_offset_s == 19800 and by["/x"].ts == dt.datetime(2026, 7, 15, 7, 34, 5)
    assert by["/y"].ip == "10.0.0.2" and by["/y"].method == "" and by["/y"].ts == dt.datetime(2026, 1, 1) and by["/y"].bytes == 0


def test_mixed_lines_and_bad_bytes(spark):
    rows = parse(spark, LINE.format(200), '{"uri":"/z","status":200}', LINE.format(404).replace(" 512 ", " - "))
    assert sorted((r.path, r.status, r.bytes) for r in rows) == [("/api/users/42", 200, 512), ("/api/users/42", 404, 0), ("/z", 200, 0)]


def test_status_class(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 99, 100, 204, 599, 600, 999)], "s int").select(status_class(F.col("s")).alias("k")).collect()
    assert [r.k for r in rows] == [0, 0, 1, 2, 5, 0, 0]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("", "/"), ("/", "/"), ("/api/products/12345", "/api/products/{id}"), ("/u/6f9619ff-8b86-d011-b42d-00cf4fc964ff/x", "/u/{uuid}/x"), ("/f/deadbeefdeadbeef0123", "/f/{hash}"), ("/k/aGVsbG9rZXkx9zQ", "/k/{token}"), ("/v1/products/list", "/v1/products/list"), ("/blog/my-post-title-2024", "/blog/my-post-title-2024"), ("//a//1/", "/a//{id}")],
)
def test_templates(spark, path, expected):
    assert spark.range(1).select(normalize.template(F.lit(path)).alias("t")).first().t == expected


def test_patterns_and_ignored(spark):
    patterns = ["nope/:x", " /api/users/:id ", "/api/users/:id/orders/:orderId"]
    paths = ["/API/users/42/orders/99", "/api/users/42", "/other/7"]
    got = [spark.range(1).select(normalize.template(F.lit(p), patterns)).first()[0] for p in paths]
    assert got == ["/api/users/{id}/orders/{orderId}", "/api/users/{id}", "/other/{id}"]
    prefixes = ["/api/agent/", "", "no-slash", "/"]
    rows = spark.createDataFrame([(p,) for p in ("/api/agent", "/api/agent/v1", "/api/agents", "/", "/x", "//x", "no-slash")], "p string")
    assert [r[0] for r in rows.select(normalize.ignored(F.col("p"), prefixes)).collect()] == [True, True, False, True, False, True, False]


def test_query_strings(spark):
    q = "a=1&&b=x+y&c&a=2&bad=%ZZ&semi=1;2&=v&u=%E2%82%AC"
    row = spark.range(1).select(query_string.pairs(F.lit(q)).alias("p"), query_string.is_clean(F.lit(q)).alias("ok"), query_string.values(F.lit(q), "a").alias("a"), query_string.raw_value(F.lit(q), "b").alias("b"), query_string.shown(F.lit("x=a%01b"), "x").alias("raw")).first()
    assert [(p.k, p.v) for p in row.p] == [("a", "1"), ("b", "x y"), ("c", ""), ("a", "2"), ("", "v"), ("u", "€")]
    assert (row.ok, row.a, row.b, row.raw) == (False, "1 | 2", "x+y", "a%01b")


def test_cap_arithmetic():
    assert [rollup.kept_of(n, 100) for n in (0, 100, 101, 110, 111, 1000)] == [0, 100, 91, 100, 91, 100]
