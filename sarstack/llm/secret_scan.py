"""Secret scan with corpus-wide ownership (operator 8, DataFrame functions only).

Patterns find candidates with their spans in code points. Each candidate's
hash is then counted over the whole corpus by distinct owners and distinct
repositories: a value that many owners share is an example that people copy; a
value that one owner has is live-looking. The owner is ``source`` and the
repository is ``source`` with ``lang`` in these tables; both are parameters.

Base kinds (assign, access, hex) are always kept. The method adds two kinds:

* ``key``: other credentials by shape (vendor prefixes, JSON web tokens, private
  key headers, passwords in connection strings, upper-case hex of 24 or more,
  and runs of 32 or more of ``[A-Za-z0-9_-]`` with upper-case, lower-case and
  digit), where the value is live-looking.
* ``live``: the value of a base candidate that is live-looking, so that a reader
  of the spans can tell it from an example. It lies within its base span.

A value is live-looking if at most ``max_owners`` owners have it in the corpus;
case is folded, so a shouted copy counts as a copy.

Spans: Spark has no function for the positions of all matches, so the text is
cut into (gap, match) pairs by ``(?s)\\G(.*?)(pattern)`` and lengths are summed,
in runs of RUN matches, so that long texts cost in proportion to their matches.
Only texts in which a plain search finds something take that path.

Scale: a hash is first made distinct with its owner and repository, then
counted, so a value that a third of all documents hold meets nowhere as rows.
Where the verdicts go back to the documents, the few values with a thousandth
of all candidates or more are sent to them; others are joined. Documents
without candidates pass every join by.

Defined cases: a null or empty text has no spans (empty string and its hash).
Repeated rows are counted as rows of their owner. Null owner or repository
count as one of their own. Extra columns are ignored by the result, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import col, join_hot, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = "|".join((
    r"(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
    r"(?<=://)[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{1,256}(?=@)",
    r"[0-9A-F]{24,}+(?![A-Za-z0-9_-])",
    r"[A-Za-z0-9_-]{32,}",
))
KINDS = ("assign", "access", "hex", "key", "live")
#: Matches whose spans are put together at a time.
RUN = 256


def _cut(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""
    whole = rf"(?s)\G(.*?)({pattern})"  # \G: what follows the last match is read once, not from every offset
    gaps, hits = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    none = F.array().cast(_NONE)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), x["m"].alias("m")))).alias("out"))

    def run(acc: Column, k: Column) -> Column:
        begin = F.struct(F.coalesce(F.try_element_at(F.transform(acc, lambda r: r["at"]), F.lit(-1)), F.lit(0).cast("long")).alias("at"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(F.slice(pairs, k * RUN + 1, F.lit(RUN)), begin, step)))

    pairs = F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("m")), lambda x: F.struct(x["g"].alias("g"), x["m"].alias("m")))
    runs = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int"))
    return F.flatten(F.transform(F.aggregate(runs, F.array().cast(f"array<struct<at:bigint,out:{_NONE}>>"), run), lambda r: r["out"]))


_NONE = "array<struct<s:bigint,e:bigint,m:string>>"


def _spans(text: Column, pattern: str, ahead: str | None = None) -> Column:
    return F.when(F.rlike(text, F.lit(ahead or pattern)), _cut(text, pattern)).otherwise(F.array().cast(_NONE))


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row a document: its id, row key, owner, repository and all candidates (start, kind, end, value)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = lambda c: F.coalesce(col(c).cast("string"), F.lit("\0")) if c in docs.columns else F.lit("\0")
    src = docs.select("doc_id", has(owner_col).alias("owner"), F.concat_ws("\1", *(has(c) for c in repo_cols)).alias("repo"), text.alias("text"))
    src = src.withColumn("a", _spans(F.col("text"), ASSIGN + VALUE)).withColumn("k", _spans(F.col("text"), ACCESS)).withColumn("h", _spans(F.col("text"), HEX)).withColumn("b", _spans(F.col("text"), KEY))
    value = lambda m: F.regexp_extract(m, f"(?s)^{ASSIGN}({VALUE})$", 1)
    as_kind = lambda c, o, v: F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), v(x["m"]).alias("v")))
    same = lambda m: m
    # a run of letters and digits alone is a key only if it is mixed
    run = lambda v: F.rlike(v, F.lit(r"^[A-Za-z0-9_-]+$")) & ~F.rlike(v, F.lit(r"^(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|npm_|hf_|[0-9A-F]{24,}$|-----B)"))
    mixed = lambda v: F.rlike(v, F.lit("[A-Z]")) & F.rlike(v, F.lit("[a-z]")) & F.rlike(v, F.lit("[0-9]"))
    more = F.filter(as_kind("b", 3, same), lambda x: ~run(x["v"]) | mixed(x["v"]))
    every = F.concat(F.filter(as_kind("a", 0, value), lambda x: F.length(x["v"]) >= 6), as_kind("k", 1, same), as_kind("h", 2, same), more)
    return src.select("doc_id", "owner", "repo", every.alias("spans")).withColumn("row", F.monotonically_increasing_id())


def _each(found: DataFrame) -> DataFrame:
    return found.where(F.size("spans") > 0).select("row", "doc_id", "owner", "repo", F.explode("spans").alias("x")).withColumn("hash", F.sha2(F.lower("x.v"), 256))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos and n_found of every candidate value in the corpus."""
    one = _each(found).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = one.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def scan_secrets(docs: DataFrame, max_owners: int = 1, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Spans of every document, base and added, and how many candidates are live-looking or examples."""
    found = written(find_secrets(docs, owner_col, repo_cols), "secrets")  # from here the rows' keys hold
    own = written(ownership(found), "secret-owners")
    judged = join_hot(_each(found).select("row", "doc_id", "x", "hash"), own, ["hash"], "n_found")
    live, span = F.col("n_owners") <= max_owners, lambda s, o: F.struct(s.alias("s"), o.alias("o"), F.col("x.e").alias("e"))
    as_found = F.when((F.col("x.o") < 3) | live, span(F.col("x.s"), F.col("x.o")))
    as_live = F.when((F.col("x.o") < 3) & live, span(F.col("x.e") - F.length("x.v"), F.lit(4)))
    per = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.concat(F.collect_list(as_found), F.array_distinct(F.collect_list(as_live)))).alias("all"),
        F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example"), F.max("n_owners").alias("max_owners"),
    )
    none = F.array().cast("array<struct<s:bigint,o:int,e:bigint>>")
    zero = F.lit(0).cast("long")
    clean = found.where(F.size("spans") == 0).select("doc_id", none.alias("all"), zero.alias("n_live"), zero.alias("n_example"), zero.alias("max_owners"))
    out = per.drop("row").unionByName(clean).withColumn("base", F.filter("all", lambda x: x["o"] < 3))
    names = F.array(*map(F.lit, KINDS))
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda o: F.size(F.filter("all", lambda x: x["o"] == o)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(join(F.col("base")), 256).alias("base_sha256"), join(F.col("all")).alias("spans"), "n_live", "n_example", "max_owners")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; a value is live-looking while one source alone has it."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
