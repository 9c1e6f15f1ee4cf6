"""Mixing sources to target weights by Pareto order sampling (operator 7).

A source's target is its share by weight of all words, at most ``max_ratio``
times its own; what is cut off goes to the others by weight until none is
above. Within a source, documents of ``long_words`` words or more are worth
twice a shorter one (None: all alike), times ``priority_col`` if given. The
expected copies of a document are c times its worth, at most ``max_ratio``, c
such that the source's expected words are its target. The whole part of that
is certain, its fraction is the inclusion probability p of one more copy.
Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), u fixed by seed, id and text, and the first of
the ranking get that copy, as many as bring the source's words closest to its
target: a fixed-size sample of unequal probabilities, the size counted in words.

Worths are rounded to powers of two, 2**-8 to 2**8, so that a source has few
tiers of equal p.

Scale: sizes are computed once and written. Sources are met through a table of
one row a source; their order comes from range partitions, the level of the
weights from repeated sums over that table, so none of it is one task. The cut
is found in steps: from word sums by (source, slot of the ranking), inside the
one slot where the sum crosses, and, where equal rows are cut through, inside
them by slots of their row numbers. A source with a third of all rows is never
sorted by one task.

Defined cases: null and empty texts have size 0, get copies like others of
their source, and take 0 words. Null sources form one source, last in order.
Null priorities, and those not above 0, count as 1. Rows with equal ids and
texts share u and follow one another; any of them may be the last to be taken.
A source without words has target 0 and no copies. An empty table gives an
empty result. Extra columns pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import col, columns, written

WORDS = r"[^\x20\x09-\x0D]+"
SLOTS = 4096
#: Sources up to which their table is broadcast (under 100 bytes a row).
BROADCAST_SOURCES = 10_000


def ordinals(per: DataFrame) -> DataFrame:
    """``per`` with ``at``: the place of its ``source`` in code-point order, null last, from 0."""
    spark = per.sparkSession
    order = F.col("source").asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(per.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r.part, r["count"]) for r in dealt.groupBy("part").count().collect())  # one row a partition
    begins = [(p, sum(c for q, c in sizes if q < p)) for p, _ in sizes]
    begin = F.broadcast(spark.createDataFrame(begins, "part int, begin bigint"))
    return dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(order))).join(begin, "part").withColumn("at", F.col("begin") + F.col("own") - 1).drop("part", "own", "begin")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_ratio: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, size) rows; weights repeat in code-point order.

    The level (words for each unit of weight) rises as sources are capped; it
    is summed anew until no further source is above its cap.
    """
    per = ordinals(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    per = written(per.select("source", "source_size", w.alias("w"), (F.lit(max_ratio) * F.col("source_size")).alias("cap")), "weights")
    level, capped = 0.0, 0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        row = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("cut"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.sum(over.cast("int")).alias("n")).first()
        if not row["w"] or (level and row["n"] == capped):
            break
        level, capped = (row["total"] - (row["cut"] or 0)) / row["w"], row["n"]
    return per.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def uniform(seed: int, *cols: str):
    """A number in (0, 1) from the MD5 of seed and columns: the same in every run and engine."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def tiers(sizes: DataFrame, per: DataFrame, max_ratio: float) -> DataFrame:
    """source, worth, whole, p of each tier, and need: the words that the ranking still gives its source."""
    words = sizes.groupBy("source", "worth").agg(F.sum("size").alias("words"))
    words = words.withColumnRenamed("source", "src").join(per, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    down = Window.partitionBy("source").orderBy(F.desc("worth"))  # 17 tiers of a source at most, twice that with lengths
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # with all tiers above at the most copies, c for this tier and those below
    c = (F.col("target") - max_ratio * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.sum(F.col("worth") * F.col("words")).over(below)
    words = words.withColumn("c", F.when(F.sum(F.col("worth") * F.col("words")).over(below) > 0, c))
    fits = F.when(F.col("c") * F.col("worth") <= max_ratio, F.col("c"))
    words = words.withColumn("c", F.first(fits, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    most = F.col("target") >= max_ratio * F.col("source_size")
    expected = F.when(F.col("source_size") == 0, 0.0).when(most | F.col("c").isNull(), F.lit(float(max_ratio))).otherwise(F.least(F.lit(float(max_ratio)), F.round(F.col("c") * F.col("worth"), 9)))
    words = words.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    whole = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return words.select("source", "worth", "source_size", "target", "whole", "p", (F.col("target") - whole).alias("need"))


def copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_ratio: float = 3.0, seed: int = 7, long_words: int | None = 50, priority_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, tie, source, size, source_size, target, p, copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pr = col(priority_col).cast("double") if priority_col else F.lit(1.0)
    pr = F.when(pr > 0, F.pow(F.lit(2.0), F.greatest(F.lit(-8), F.least(F.lit(8), F.round(F.log2(pr)))))).otherwise(1.0)
    src = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("tie"), pr.alias("worth"))
    if long_words is not None:
        src = src.withColumn("worth", F.when(F.col("size") >= long_words, 2 * F.col("worth")).otherwise(F.col("worth")))
    sizes = written(src.withColumn("rid", F.monotonically_increasing_id()), "sizes")  # row numbers hold once they are written
    per = written(targets(sizes.select("source", "size"), weights, max_ratio), "targets")
    tier = written(tiers(sizes, per, max_ratio), "tiers")
    small = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    mark = F.broadcast if small else (lambda d: d)
    to = tier.withColumnsRenamed({"source": "t_source", "worth": "t_worth"})
    keyed = sizes.join(mark(to), F.col("source").eqNullSafe(F.col("t_source")) & (F.col("worth") == F.col("t_worth"))).drop("t_source", "t_worth")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    keyed = keyed.withColumn("u", uniform(seed, "doc_id", "tie")).withColumn("q", F.when(F.col("p") > 0, odds)).drop("u")
    # q / (1 + q) lies in (0, 1) and keeps the order; its slot of SLOTS is the coarse rank
    keyed = written(keyed.withColumn("slot", F.when(F.col("q").isNotNull(), F.least(F.floor(F.col("q") / (1 + F.col("q")) * SLOTS), F.lit(SLOTS - 1)))), "ranked")
    by_slot = keyed.where("slot is not null").groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    run = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most SLOTS rows
    crosses = (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))
    cut = written(by_slot.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).where(crosses).select(F.col("source").alias("c_source"), F.col("slot").alias("c_slot"), "before"), "cuts")
    at_cut = F.col("source").eqNullSafe(F.col("c_source"))
    edge = keyed.join(mark(cut), at_cut & (F.col("slot") == F.col("c_slot")))
    # equal rows are one group; the group where the sum crosses gives as many rows as bring it closest
    key = ["q", "doc_id", "tie"]
    groups = edge.groupBy("source", *key, "before", "need", "size").agg(F.sum("size").alias("words"))
    inner = Window.partitionBy("source").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(inner), F.lit(0))).where(crosses)
    last = written(groups.select(F.col("source").alias("l_source"), F.struct(*key).alias("last"), F.ceil((F.col("need") - F.col("before")) / F.col("size") - 0.5).alias("some")), "last-groups")
    here = edge.select("source", "rid", F.struct(*key).alias("key")).join(mark(last), F.col("source").eqNullSafe(F.col("l_source")) & (F.col("key") == F.col("last")))
    firsts = first_rows(here.select("l_source", "rid", "some"))
    limit = cut.join(last, F.col("c_source").eqNullSafe(F.col("l_source")), "left").select("c_source", "c_slot", "last")
    out = keyed.join(mark(limit), at_cut, "left").join(firsts.withColumnRenamed("rid", "f_rid"), F.col("rid") == F.col("f_rid"), "left")
    before = F.coalesce(F.col("slot") < F.col("c_slot"), F.lit(True)) | F.coalesce((F.col("slot") == F.col("c_slot")) & (F.struct(*key) < F.col("last")), F.lit(False))
    more = F.col("slot").isNotNull() & (before | F.col("f_rid").isNotNull())
    return out.select("doc_id", "tie", "source", "size", "source_size", "target", "p", (F.col("whole") + more.cast("long")).alias("copies"))


def first_rows(rows: DataFrame) -> DataFrame:
    """rid of the first ``some`` rows of each source, in the order of a hash of rid; by slots, since they may be many."""
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("rid"), F.lit(SLOTS)))
    by_slot = rows.groupBy("l_source", "slot").agg(F.count("*").alias("n"), F.first("some").alias("some"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l_source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_slot = by_slot.select(F.col("l_source").alias("s"), F.col("slot").alias("k"), (F.col("some") - before).alias("room"))
    ranked = rows.join(by_slot, F.col("l_source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).where("room > 0")
    return ranked.withColumn("at", F.row_number().over(Window.partitionBy("l_source", "slot").orderBy("rid"))).where("at <= room").select("rid")


def mix(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    n = copies(docs, **kw).groupBy("doc_id", "tie").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    n = written(n.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"}), "copies")  # numbers only: read twice below, planned and computed once
    tie = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    joined = docs.join(n, F.col("doc_id").eqNullSafe(F.col("__id")) & (tie == F.col("__tie")))
    times = lambda c: F.explode(F.sequence(F.lit(1).cast("long"), c))
    even = joined.where("__copies % __rows = 0").withColumn("__copy", times(F.expr("__copies div __rows"))).select(*columns(docs))
    # equal rows of which some are taken once more: all their copies from one of them
    uneven = joined.where("__copies % __rows <> 0").groupBy("__id", "__tie").agg(F.any_value(F.struct(*columns(docs))).alias("__row"), F.first("__copies").alias("__copies"))
    return even.unionByName(uneven.withColumn("__copy", times(F.col("__copies"))).select("__row.*"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to weights 1, 2, 3, repeating."""
    got = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
c AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(i - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(cap) OVER r, 0) AS cb, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS wl FROM c
  WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (SELECT arg_min((total - cb) / wl, cap / w) FROM l WHERE (total - cb) / wl * w <= cap) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM v),
r AS (SELECT d.*, source_size, target, CASE WHEN size >= 50 THEN 2.0::DOUBLE ELSE 1.0 END AS worth FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, worth, any_value(target) AS target, any_value(source_size) AS source_size, sum(size)::DOUBLE AS words FROM r GROUP BY source, worth),
x AS (SELECT *, (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY worth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(worth * words) OVER (PARTITION BY source ORDER BY worth DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c0 FROM k),
y AS (SELECT source, arg_max(c0, worth) FILTER (WHERE c0 * worth <= 3) AS c FROM x GROUP BY source),
z AS (SELECT k.source, k.worth, words, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN target >= 3.0::DOUBLE * source_size OR c IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, round(c * k.worth, 9)) END AS e
    FROM k JOIN y ON k.source IS NOT DISTINCT FROM y.source),
n AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY source) AS need FROM z),
u AS (SELECT r.*, whole, p, need, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source AND r.worth = n.worth),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
m AS (SELECT source, max(upto) FILTER (WHERE p > 0 AND abs(upto - need) < abs(upto - size - need)) AS last FROM o GROUP BY source)
SELECT o.doc_id, o.size, o.source_size, o.target, ((o.whole + CASE WHEN o.p > 0 AND o.upto <= m.last THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o JOIN m ON o.source IS NOT DISTINCT FROM m.source
"""
