"""Access-log lines to records, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelens.schema import JSON_LINE, RECORD_NAMES

# The combined format (not anchored at its end) and the two time formats. White space and digits are
# spelt out, as Java's \S leaves out U+000B too and its \d may take other digits.
COMBINED = r'^([^\t\n\f\r ]+) [^\t\n\f\r ]+ [^\t\n\f\r ]+ \[([^\]]+)\] "([^\t\n\f\r ]+) ([^"]*?) [^"]*" ([0-9]{3}) ([^\t\n\f\r ]+) "([^"]*)" "([^"]*)"'
NGINX_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"

BLANK = " \t\r\n\x0b\x0c"


def status_class(status: Column) -> Column:
    """1 to 5, or 0 for what is none of them."""
    k = F.floor(status / 100).cast("int")
    return F.when(k.between(1, 5), k).otherwise(0)


def first_forwarded(header: Column) -> Column:
    """The client in front of a chain of proxies; null where there is none."""
    one = F.btrim(F.split(header, ",")[0], F.lit(BLANK))
    return F.when((F.coalesce(header, F.lit("")) == "") | (header == "-") | (one == ""), None).otherwise(one)


def client_ip(real: Column, forwarded: Column, peer: Column) -> Column:
    """The client of a request: X-Real-IP, else the first of X-Forwarded-For, else the host of the peer's ``host:port``.

    Headers that are null or empty count as absent; one of blanks alone gives an empty text. A peer without a port stays.
    """
    host = F.regexp_extract(peer, r"\A(?:\[([^\[\]]*)\]|([^:\[\]]*)):[^:]*\z", 1)
    plain = F.regexp_extract(peer, r"\A([^:\[\]]*):[^:\[\]]*\z", 1)
    by_peer = F.when(peer.rlike(r"\A\[[^\[\]]*\]:[^:\[\]]*\z"), host).when(peer.rlike(r"\A[^:\[\]]*:[^:\[\]]*\z"), plain).otherwise(peer)
    first = F.btrim(F.split(forwarded, ",")[0], F.lit(BLANK))
    return F.when(F.coalesce(real, F.lit("")) != "", F.btrim(real, F.lit(BLANK))).when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(by_peer)


# The layouts of a time argument in the order in which they are tried, the first three with a zone.
SINCE = ("dd/MM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd/MM/yyyy:HH:mm:ss", "dd/MM/yyyy", "dd/MMM/yyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def since(text: Column) -> Column:
    """The time that an argument names in one of SINCE, null where it is none; without a zone in the session's."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in SINCE])


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def query_of(target: Column) -> Column:
    at = F.instr(target, "?")
    return F.when(at > 0, target.substr(at + 1, F.length(target))).otherwise(F.lit(""))


def _offset(zone: Column) -> Column:
    """Seconds east of UTC of ``+hhmm``, ``+hh:mm`` or ``Z``."""
    z = F.replace(zone, F.lit(":"), F.lit(""))
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    return F.when(z.rlike(r"\A[+-][0-9]{4}\z"), sign * (F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 4, 2).try_cast("int") * 60)).otherwise(0)


def parse_lines(lines: DataFrame, ingest_ts: Column) -> DataFrame:
    """Records of the lines (columns value and site) that parse, as RECORD; further columns of ``lines`` are kept behind.

    A line whose first visible character is ``{`` is read as JSON, and as combined if that fails. A time that can't be
    read becomes ``ingest_ts``; bytes that can't be become 0.
    """
    value = F.col("value")
    more = [c for c in lines.columns if c not in ("value", "site")]
    trimmed = F.btrim(value, F.lit(BLANK))
    looks = trimmed.startswith("{") & trimmed.endswith("}")
    options = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    # The pattern runs once a line: a line that it doesn't match comes back as it was.
    replaced = F.regexp_replace(value, f"(?s){COMBINED}.*", "$1\n$2\n$3\n$4\n$5\n$6\n$7\n$8")
    fields = F.transform(F.array(replaced), lambda r: F.when(r != value, F.split(r, "\n")))[0]
    both = F.struct(F.when(looks, F.from_json(value, f"{JSON_LINE}, _bad string", options)).alias("j"), fields.alias("c"))
    rows = lines.select("*", F.inline(F.array(both)))  # a generator, so that a line is parsed once and not for each field
    json_ok = F.coalesce(F.col("j").isNotNull() & F.col("j._bad").isNull() & (F.coalesce("j.uri", F.lit("")) != "") & (F.coalesce("j.status", F.lit(0)) != 0), F.lit(False))
    rows = rows.withColumn("json_ok", json_ok).filter(F.col("json_ok") | F.col("c").isNotNull())
    ok, j, c = F.col("json_ok"), F.col("j"), F.col("c")

    def pick(json: Column, combined: Column) -> Column:
        return F.when(ok, json).otherwise(combined)

    def text(name: str) -> Column:
        return F.coalesce(j[name], F.lit(""))

    target = pick(text("uri"), c[3])
    json_ts = F.when(text("time").rlike(RFC3339), F.try_to_timestamp(j["time"]))
    when = pick(json_ts, F.try_to_timestamp(c[1], F.lit(NGINX_TIME)))
    zone = pick(F.regexp_extract(text("time"), r"(Z|[+-][0-9]{2}:[0-9]{2})\z", 1), F.regexp_extract(c[1], r" ([+-][0-9]{4})\z", 1))
    rows = rows.withColumn("when", when)
    return rows.select(
        F.coalesce("when", ingest_ts).alias("ts"),
        F.when(F.col("when").isNull(), 0).otherwise(_offset(zone)).cast("int").alias("tz_offset_s"),
        "site",
        pick(F.coalesce(first_forwarded(text("forwarded_for")), text("remote_addr")), c[0]).alias("ip"),
        pick(text("method"), c[2]).alias("method"),
        path_of(target).alias("path"),
        query_of(target).alias("query"),
        pick(j["status"], c[4].try_cast("int")).alias("status"),
        F.coalesce(pick(j["bytes_sent"], c[5].try_cast("long")), F.lit(0).cast("long")).alias("bytes"),
        pick(text("referer"), c[6]).alias("referer"),
        pick(text("user_agent"), c[7]).alias("ua"),
        *more,
    ).select(*RECORD_NAMES, *more)
