"""URL rules by a Bloom filter cascade (operator 1, DataFrame functions only).

A rule is a host and a path prefix with a verdict. It fits its host and all
subdomains; the longest that fits wins. Every url has a few candidate keys
(each suffix of its host with each prefix of its path that has the length of
some rule's path), and a rule fits exactly where its key is among them. So
filtering is membership of candidate keys in the listed keys.

Membership comes from a cascade of Bloom filters over the corpus's complete
key universe (all candidate keys of all urls). Level 1 encodes the listed keys
of the universe; level 2 the universe's unlisted keys that level 1 lets pass;
level 3 the listed keys that level 2 lets pass, and so on until none pass. A
key's place is decided by the first level that rejects it: exact for every key
of the universe, without a join. A second, small cascade over the listed keys
tells the blocked ones.

Size: level 1 lets about as many unlisted keys pass as there are listed ones
(its rate is listed / universe), every further level an eighth of what it
meets. So a cascade takes about listed * (1.44 * log2(universe / listed) + 7)
bits whatever the corpus: 4 MB for 10**6 rules over 10**12 keys. Levels go out
as arrays of 64-bit words inside the expressions, MAX_BYTES at a time: more
rules are dealt by a hash of their keys to several cascades, which are applied
one after the other, the table written between.

Defined cases: null urls and urls without ``://`` have empty host and path and
no rule. A url that no rule fits gets ``default`` as its verdict: it is not
listed. Rules given twice count once; a key under both verdicts is blocked.
Empty tables of urls or rules are allowed. Extra columns pass through under
any name, except ``host``, ``path``, ``rule`` and ``verdict``, which the
operator's own replace, and names that begin with ``__``, which are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import col, written

ALLOW, BLOCK = "allow", "block"
#: Rules of the query op1: verdict, host, path.
RULES = (
    (BLOCK, "com", "/en/"),
    (ALLOW, "example.com", "/en/7"),
    (ALLOW, "net", "/de/"),
    (BLOCK, "example.net", "/de/8"),
    (BLOCK, "org", "/es/"),
)
#: Bytes of the cascades that one pass sends along.
MAX_BYTES = 16 << 20
#: Hashes of the levels after the first, and at most of the first.
HASHES, MOST_HASHES = 3, 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Candidate keys, longest first: host suffixes with the path's prefixes of ``lengths``."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    keys = F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))
    return F.transform(F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k), k.alias("key"))), asc=False), lambda x: x["key"])


def _positions(key: Column, bits: int, level: int, hashes: int) -> list[Column]:
    a, b = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [(a + b * i) % bits for i in range(hashes)]


class Level:
    """One Bloom filter as an array of 64-bit words."""

    def __init__(self, level: int, hashes: int, words: list[int]):
        self.level, self.hashes, self.bits = level, hashes, 64 * len(words)
        self.words = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")

    def passes(self, key: Column) -> Column:
        tests = []
        for at in _positions(key, self.bits, self.level, self.hashes):
            word = F.get(self.words, F.floor(at / 64).cast("int"))
            tests.append(F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return reduce(lambda x, y: x & y, tests)


def level_bits(n: int, hashes: int) -> int:
    """Bits of a filter of ``n`` keys that lets one in 2 ** hashes pass."""
    return max(64, -(-int(1.4427 * n * hashes) // 64) * 64)


def first_hashes(listed: int, universe: int) -> int:
    """Hashes of level 1: it lets about listed of the universe's other keys pass."""
    return min(MOST_HASHES, max(HASHES, math.ceil(math.log2(max(universe, 2) / max(listed, 1)))))


def build_level(keys: DataFrame, n: int, level: int, hashes: int) -> Level | None:
    """A filter over the column ``key`` of ``keys`` (about ``n`` rows); None if there are none."""
    bits = level_bits(n, hashes)
    at = F.explode(F.array(*_positions(F.col("key"), bits, level, hashes)))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("bits"))
    held = {r.word: r.bits for r in words.collect()}  # bits / 64 rows at most
    return Level(level, hashes, [held.get(i, 0) for i in range(bits // 64)]) if held else None


class Cascade:
    """Exact membership for the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def member(self, key: Column) -> Column:
        # the first level that rejects decides: an odd one says no, an even one yes
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: str, sizes: tuple[int, int] | None = None) -> Cascade:
    """Cascade for the rows of ``universe`` (key, distinct) whose column ``listed`` is true.

    One pass over the keys builds a level. Level sizes come from the numbers
    of listed and unlisted keys (counted here unless given) and the rates of
    the levels before: a wrong guess changes the number of levels, not the result.
    """
    if sizes is None:
        row = universe.agg(F.coalesce(F.sum(F.col(listed).cast("long")), F.lit(0)).alias("n"), F.count("*").alias("all")).first()
        sizes = row["n"], row["all"] - row["n"]
    sides = [universe.where(F.col(listed)).select("key"), universe.where(~F.col(listed)).select("key")]
    left, levels = [float(x) for x in sizes], []
    while True:
        side, hashes = len(levels) % 2, HASHES if levels else first_hashes(sizes[0], sum(sizes))
        # some more than expected: a level too small would let too many pass
        level = build_level(sides[side], math.ceil(left[side] + 2 * math.sqrt(left[side])), len(levels), hashes)
        if level is None:
            return Cascade(levels)
        levels.append(level)
        # the other side's keys that come through every level so far, in turn
        sides[1 - side] = sides[1 - side].where(level.passes(F.col("key")))
        left[1 - side] /= 1 << hashes


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """The rules (verdict, host, path) as a table of constants."""
    rows = F.array(*(F.struct(*(F.lit(x).cast("string").alias(c) for c, x in zip(("verdict", "host", "path"), r, strict=True))) for r in rules))
    return spark.range(1).select(F.explode(rows.cast("array<struct<verdict:string,host:string,path:string>>")).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has verdict, host, path."""
    keys = rules.where("host is not null and path is not null").groupBy(F.concat(F.translate("host", _UPPER, _LOWER), F.col("path")).alias("key")).agg(F.max(F.col("verdict") == BLOCK).alias("block"))
    keys = written(keys, "url-rules")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).where("path is not null").distinct().collect())  # lengths, not rules
    keep = [col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict") and not c.startswith("__")]
    host, path = split_url(col(url_col).cast("string"))
    split = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("__keys", candidates(F.col("host"), F.col("path"), lengths))
    # the universe: every candidate key of the corpus, marked by what the rules say of it
    universe = split.select(F.explode("__keys").alias("key")).distinct().join(keys, "key", "left")
    universe = written(universe.select("key", F.col("block").isNotNull().alias("listed"), F.coalesce("block", F.lit(False)).alias("blocked")), "url-keys")
    row = universe.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0)).alias("listed")).first()
    n, others = row["listed"], row["all"] - row["listed"]
    parts = max(1, -(-(level_bits(n, first_hashes(n, n + others)) + 8 * n) // (8 * max_bytes)))
    part = lambda k: F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))
    none = F.array().cast("array<struct<key:string,block:boolean>>")
    out = split.withColumn("__hits", none)
    for p in range(parts):
        own = universe.where(part(F.col("key")) == p) if parts > 1 else universe
        listed, blocked = build_cascade(own, "listed", (n, others) if parts == 1 else None), build_cascade(own.where("listed"), "blocked")
        mine = F.filter("__keys", lambda k: (part(k) == p) & listed.member(k)) if parts > 1 else F.filter("__keys", listed.member)  # noqa: B023
        hits = F.transform(mine, lambda k: F.struct(k.alias("key"), blocked.member(k).alias("block")))  # noqa: B023
        out = out.withColumn("__hits", hits if p == 0 else F.concat("__hits", hits))
        if p < parts - 1:
            out = written(out, "urls")
    # keys come longest first within a part
    best = F.get("__hits", F.lit(0)) if parts == 1 else F.reduce("__hits", F.get("__hits", F.lit(0)), lambda x, y: F.when(F.length(y["key"]) > F.length(x["key"]), y).otherwise(x))
    out = out.withColumn("__best", best).withColumn("rule", F.col("__best.key"))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("__best.block"), BLOCK).otherwise(ALLOW)).otherwise(F.lit(default))
    return out.withColumn("verdict", verdict).drop("__keys", "__hits", "__best")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under RULES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE_SQL = rf"""
WITH r(v, h, p) AS (VALUES {_RULES_SQL}),
a AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
m AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN m ON b.rid = m.rid
"""
