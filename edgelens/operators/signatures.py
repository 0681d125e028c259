"""Request signatures: canonical requests, keywords, rules and scores, as one expression for each rule."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("path", "query", "ua", "referer", "cookie", "body")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int
    targets: tuple[str, ...] = ("any",)
    keywords: tuple[str, ...] = ()
    regex: str = ""
    action: str = "score"
    enabled: bool | None = None
    name: str = ""
    tags: tuple[str, ...] = ()


# The shipped rules.
RULES = (
    Rule("SQLI-001", 10, ("query", "uri", "body"), ("union", "select"), r"union[\s\S]{0,40}select"),
    Rule("SQLI-002", 6, ("query", "uri", "body"), ("or ", "and "), r"""(or|and)\s+['"]?\w+['"]?\s*=\s*['"]?\w+"""),
    Rule("SQLI-003", 8, ("query", "uri", "body"), ("sleep(", "benchmark(", "waitfor delay", "information_schema", "load_file(", "pg_sleep(")),
    Rule("XSS-001", 6, ("query", "uri", "body", "referer"), ("<script", "javascript:", "onerror=", "onload=", "onmouseover="), r"<script|javascript:|on(error|load|mouseover|focus)\s*="),
    Rule("XSS-002", 5, ("query", "uri", "body"), ("<img", "<svg", "<iframe", "<body"), r"<(img|svg|iframe|body)[^>]{0,60}on\w+\s*="),
    Rule("TRAV-001", 6, ("path", "query", "uri"), ("../", "..\\"), r"\.\./|\.\.\\"),
    Rule("FILE-001", 8, ("path", "uri", "query"), ("/etc/passwd", "/etc/shadow", "wp-config.php", "/.env", "/.git/", "web.config", "id_rsa")),
    Rule("CMDI-001", 8, ("query", "uri", "body"), ("/bin/bash", "/bin/sh", ";cat ", "|nc ", "$(", "&&curl", "&&wget", "wget http", "curl http")),
    Rule("RFI-001", 8, ("query", "uri", "body"), ("php://", "data://", "file://", "expect://", "phar://")),
    Rule("LOG4J-001", 10, ("any",), ("${jndi:", "jndi:ldap", "jndi:rmi", "jndi:dns"), action="block"),
    Rule("SCAN-001", 10, ("user_agent",), ("sqlmap", "nikto", "nessus", "masscan", "nmap", "dirbuster", "gobuster", "wpscan", "acunetix", "fimap", "havij", "arachni", "zgrab"), action="block"),
)


def load_rules(path: str) -> list[Rule]:
    """Rules of a JSON file (a list, or an object with a list ``rules``); raises on a rule that can't work."""
    with open(path) as f:
        raw = json.load(f)
    out: list[Rule] = []
    for r in raw["rules"] if isinstance(raw, dict) else raw:
        rule = Rule(r.get("id", ""), r.get("severity", 0), tuple(r.get("targets") or ("any",)), tuple(k.lower() for k in r.get("keywords") or ()), r.get("regex", ""), r.get("action", "score"), r.get("enabled"), r.get("name", ""), tuple(r.get("tags") or ()))
        if not rule.id or not (rule.regex or rule.keywords):
            raise ValueError(f"a rule needs an id, and a regex or keywords: {r}")
        re.compile(rule.regex)
        if rule.id in {x.id for x in out}:
            raise ValueError(f"rule {rule.id} is there twice")
        out.append(rule if rule.severity > 0 else Rule(**{**rule.__dict__, "severity": 5}))
    return out


def rule_count(rules: tuple[Rule, ...] | list[Rule] = RULES) -> int:
    """How many of the rules are on."""
    return sum(r.enabled is not False for r in rules)


def canonical(requests: DataFrame) -> DataFrame:
    """Adds r_path, r_query, r_ua, r_referer, r_cookie, r_body, r_uri and r_any: decoded once, in lower case.

    Missing columns of FIELDS count as empty, and so do nulls. What can't be decoded stays as it is.
    """

    def raw(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in requests.columns else F.lit("")

    def decoded(name: str) -> Column:
        value = raw(name)
        return F.lower(F.when(value.rlike("%(?![0-9A-Fa-f]{2})"), value).otherwise(F.coalesce(F.try_url_decode(value), value)))

    rows = requests.withColumns({f"r_{n}": F.lower(raw(n)) if n == "ua" else decoded(n) for n in FIELDS})
    uri = F.when(F.col("r_query") == "", F.col("r_path")).otherwise(F.concat("r_path", F.lit("?"), "r_query"))
    return rows.withColumns({"r_uri": uri, "r_any": F.concat_ws("\n", *[f"r_{n}" for n in FIELDS])})


def target(name: str) -> Column:
    return F.col({"user_agent": "r_ua", "": "r_any"}.get(name, f"r_{name}")) if name in ("", "user_agent", "uri", "any", *FIELDS) else F.lit("")


def present(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text holds, overlapping or not, in the order given."""
    return F.filter(F.array(*[F.lit(k) for k in keywords if k]).cast("array<string>"), lambda k: F.contains(text, k))


def any_present(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords if k], F.lit(False))


#: Bytes of a gram, least buckets of the table of grams, and bytes of a text that are looked at together.
GRAM, LEAST_BUCKETS, PIECE = 4, 1024, 1 << 16


def gram_table(keywords: list[str]) -> list[list[int]]:
    """By bucket the numbers of the keywords of GRAM bytes and more: each stands in the bucket of its gram that fewest keywords have.

    There are 16 buckets a keyword at least, a power of two; a gram's bucket is its CRC-32 modulo that.
    """
    grams = {i: {b[j : j + GRAM] for j in range(len(b) - GRAM + 1)} for i, k in enumerate(keywords) if len(b := k.encode()) >= GRAM}
    shared = Counter(g for own in grams.values() for g in own)
    size = max(LEAST_BUCKETS, 1 << max(0, 16 * len(grams) - 1).bit_length())
    out: list[list[int]] = [[] for _ in range(size)]
    for i, own in grams.items():
        out[zlib.crc32(min(own, key=lambda g: (shared[g], g))) % size].append(i)
    return out


def present_many(text: Column, keywords: list[str]) -> Column:
    """As ``present``, for thousands of keywords: one pass over the text's grams picks the few that ``contains`` then confirms.

    The work is that of the text's length and of the keywords whose gram it holds, not of their product. The table is a
    constant of the expression: some hundred bytes a keyword. Keywords of fewer bytes than a gram are tried one by one.
    """
    known = [k for k in dict.fromkeys(keywords) if k]
    few = [(i, k) for i, k in enumerate(known) if len(k.encode()) < GRAM]
    table = gram_table(known)
    buckets, names = F.from_json(F.lit(json.dumps(table)), "array<array<int>>"), F.from_json(F.lit(json.dumps(known)), "array<string>")

    def hit(piece: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(piece) - (GRAM - 1), F.lit(1)))
        slots = F.array_distinct(F.transform(places, lambda i: (F.crc32(F.substring(piece, i, F.lit(GRAM))) % len(table) + 1).cast("int")))
        return F.filter(slots, lambda s: F.size(F.element_at(buckets, s)) > 0)

    def found(whole: Column, data: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(data) / PIECE)), lambda p: F.substring(data, (p * PIECE + 1).cast("int"), F.lit(PIECE + GRAM - 1)))
        slots = F.array_distinct(F.flatten(F.transform(pieces, hit)))
        many = F.filter(F.flatten(F.transform(slots, lambda s: F.element_at(buckets, s))), lambda i: F.contains(whole, F.element_at(names, i + 1)))
        short = F.filter(F.array(*[F.lit(i) for i, _ in few]).cast("array<int>"), lambda i: F.contains(whole, F.element_at(names, i + 1)))
        return F.transform(F.array_sort(F.concat(many, short)), lambda i: F.element_at(names, i + 1))

    # The text is a lambda's variable, so that it is made once and not for each keyword.
    return F.transform(F.array(F.struct(text.alias("t"), text.cast("binary").alias("b"))), lambda x: found(x["t"], x["b"]))[0]


def fires(rule: Rule) -> Column:
    """Keywords are looked for in the whole request first, which spares most requests the rest."""

    def hit(name: str) -> Column:
        text = target(name)
        return (text != "") & (text.rlike(rule.regex) if rule.regex else any_present(text, list(rule.keywords)))

    confirmed = reduce(lambda a, b: a | b, [hit(t) for t in rule.targets])
    if not rule.keywords:
        return confirmed
    return F.when(any_present(F.col("r_any"), list(rule.keywords)), confirmed).otherwise(False)


def verdicts(requests: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, threshold: int = 10) -> DataFrame:
    """Adds matches (ids in the order of the rules), score and block to each request."""
    on = [r for r in rules if r.enabled is not False]
    if not on:
        return requests.withColumns({"matches": F.array().cast("array<string>"), "score": F.lit(0), "block": F.lit(False)})
    found = F.filter(F.array(*[F.when(fires(r), F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), F.lit(r.action == "block").alias("block"))) for r in on]), lambda m: m.isNotNull())
    rows = canonical(requests).withColumn("_m", found)
    score = F.aggregate("_m", F.lit(0), lambda s, m: s + m["severity"])
    block = F.exists("_m", lambda m: m["block"])
    rows = rows.withColumns({"matches": F.transform("_m", lambda m: m["id"]), "score": score})
    return rows.withColumn("block", block | (F.lit(threshold > 0) & (F.col("score") >= threshold))).select(*requests.columns, "matches", "score", "block")
