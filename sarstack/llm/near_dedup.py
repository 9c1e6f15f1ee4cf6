"""MinHash near-duplicate detection with tensored banding (operator 3).

Two small collections of m minhash groups are computed for a document's set of
word shingles. The m x m table keys combine a group of the first collection
with one of the second, so L = m*m tables cost 2 m groups of hashes: roughly a
square root. Documents that share a table key are candidates; each candidate
pair is confirmed on the full sets, and components of confirmed links give the
classes.

Steps
1. Each document becomes its set's size, a 128-bit digest of the set, and the
   2 m group keys. Documents with equal sets form a class (similarity 1) with a
   number of its own: thousands of exact copies are one row from here on.
2. Only groups that two classes share can be part of a shared table key, so
   table keys are formed from shared groups only. Buckets (table keys) with the
   same members count once: two near copies share a hundred keys but are
   compared once.
3. Each class is first compared with one other, the smallest set of its largest
   bucket (its hub): families of near copies become components by one
   comparison a member. From here on only buckets of several components
   matter. NEAR times, each set apart from its hub is compared with the nearest,
   by parities, of the smallest sets of the components in its largest bucket. Then what is still apart
   is compared exhaustively. In such a bucket the members outside the component that most of it
   is in are its odd ones. Where they are at most ODD, each is compared with
   all other members of other components: a bounded number for each member.
   Otherwise the smallest set is the leader, and members are compared with
   their leader, not with one another.
4. Two members of a large bucket that differ in component must still be
   compared if they can link. At least one of them, y, missed its leader l, and
   l is no larger than either; so what x and y share cannot lie within l: a link
   (x, y) needs a common shingle outside l. By the prefix principle it is enough
   to look at the first p shingles of y without l in one order of all shingles,
   p = |y| - need + 1, about a ninth of the set. The order is rarest first, as a
   bounded sample of the texts has it; the sample only decides how much work is
   left, any order gives the same links. Members of a leader that share such a
   shingle form new, smaller buckets, which go through steps 3 and 4 again. A
   new leader is larger than the one before, so this ends; no candidate is
   capped and no pair list is formed.
5. Comparisons are exact integers (100 * common >= 80 * union) on 64-bit
   shingle hashes of the texts involved, which are computed once; a broadcast
   map of their ids (bits, so a few others pass and are dropped by their digest)
   finds them without a shuffle of texts. Pairs that
   BITS parity bits of each set prove to differ too much are not compared:
   every shingle flips one bit, so two sets differ in at least as many shingles
   as their bits do. A leader's
   set goes to SALTS parts of its members (a hub's to one for each HUB_SPLIT), and a bucket's odd members to one
   part of it for each SPLIT members, so no key is one task's work.
6. Components by minimum labels with contraction, a written table each round.
   A written table is deleted when its successors are written. Every plan costs
   the driver memory, so rounds that the comparisons to come make needless
   (NEAR with FEW_APART sets or fewer, step 4 without large buckets) are left out.

Recall of the candidate search at similarity s, with g hashes a group:
(1 - (1 - s**g)**m)**2, i.e. 0.9988 at 0.8 and 0.9999993 at 0.9 for g = 4, m = 14.
It is also measured against brute force (README, ``tests/llm``).

Defined cases: null texts and texts without words have an empty set and link
with nothing. Texts shorter than a shingle are one shingle. Rows with a null
id are given back with n_shingles, no component and kept true. Rows of one id
belong together: if their texts differ, the classes of all of them are linked.
``deduplicate`` keeps one row of each component, the one with the least text
where its id is repeated, and every row with a null id. Other columns may have
any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import ready
from ._bytes import MULT, Block, blocks, distinct, mix, owner, shingles
from ._store import Scratch, columns

U = np.uint64
GROUPS, PER_GROUP = 14, 4
#: Odd members of a bucket up to which they are compared with all of it.
ODD = 512
#: Parts into which a leader's members are dealt; members of a bucket that one part of it holds about.
SALTS, SPLIT = 64, 1_024
#: Members of a hub that one part of it holds about.
HUB_SPLIT = 256
#: Rounds of comparisons with the nearest of other components.
NEAR = 2
#: Sets apart from their hubs up to which there are none of these: the exhaustive comparisons take them at once.
FEW_APART = 256
#: Bits of the map of ids that is broadcast, as a power of two; ids up to which a list of them is.
MAP_BITS, FEW_IDS = 25, 1 << 20
#: Edges up to which components are found on the driver (16 bytes each).
FEW_EDGES = 1 << 18
#: Parity bits of a set (a multiple of 64).
BITS = 1024
#: Texts whose shingles are counted for the order, and shingles that the order ranks.
ORDER_SAMPLE, ORDER_SHINGLES = 16_000, 400_000
_SEEDS = mix(np.arange(1, 2 * GROUPS * PER_GROUP + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, ascending, and first indices."""
    words, first = block.word_hashes()
    w, f = shingles(words, first, k)
    return distinct(w, f)


def group_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * GROUPS keys of each document with a non-empty set (others: zeros)."""
    n = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((n, 2 * GROUPS), U)
    if not len(full):
        return out
    at = first[full]
    for g in range(2 * GROUPS):
        key = np.full(len(full), MULT[g], U)
        for j in range(PER_GROUP):
            h = (sets ^ _SEEDS[g * PER_GROUP + j]) * MULT[(g * PER_GROUP + j) % 61]
            h ^= h >> U(32)
            h *= MULT[61]
            key = mix(key + np.minimum.reduceat(h, at))
        out[full, g] = key
    return out


def digests(sets: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits of each document's set, as two signed words."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(sets * MULT[60 - s]))]) for s in range(2)]
    return [(c[first[1:]] - c[first[:-1]]).view(np.int64) for c in sums]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs) and group keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch):
                sets, first = shingle_sets(block, k)
                keys = group_keys(sets, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), *map(pa.array, digests(sets, first)), lists], names=["doc_id", "n", "a", "b", "keys"])

    ready(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id bigint, n bigint, a bigint, b bigint, keys array<bigint>")


def common_shingles(texts: DataFrame, k: int, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met twice or more in ORDER_SAMPLE texts, ascending, and their counts (at most ORDER_SHINGLES)."""
    some = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDER_SAMPLE))  # ORDER_SAMPLE ids
    own = full_sets(texts.join(some, "doc_id", "left_semi"), k)
    top = own.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(ORDER_SHINGLES).toArrow()
    known = top.column("s").to_numpy().astype(np.int64).view(U)
    at = np.argsort(known)
    return known[at], top.column("c").to_numpy().astype(np.int64)[at]


def parities(sets: np.ndarray, first: np.ndarray) -> pa.Array:
    """BITS bits of each document's set: how often, modulo 2, a shingle falls on each."""
    n = len(first) - 1
    at = owner(first) * BITS + (sets & U(BITS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(bool)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.packbits(odd).view(np.int64)))


def full_sets(texts: DataFrame, k: int, order: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Digest, parities and distinct shingle hashes of each text, the rarest first by ``order``."""
    send = texts.sparkSession.sparkContext.broadcast(order) if order is not None and len(order[0]) else None  # ORDER_SHINGLES pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch):
                sets, first = shingle_sets(block, k)
                a, b = digests(sets, first)
                bits = parities(sets, first)
                if send is not None:
                    known, counts = send.value
                    at = np.minimum(np.searchsorted(known, sets), len(known) - 1)
                    seen = np.where(known[at] == sets, counts[at], 0)
                    sets = sets[np.lexsort((sets, seen, owner(first)))]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), bits, lists], names=["a", "b", "bits", "s"])

    return texts.select("text").mapInArrow(run, "a bigint, b bigint, bits array<bigint>, s array<bigint>")


def apart(x: Column, y: Column) -> Column:
    """Shingles, at least, that only one of two sets has, by their parities."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)


def fits(percent: int) -> Callable[[Column], Column]:
    """Whether a member (n, label, bits) can link with the row's and join two components by it."""
    n = F.col("n")
    return lambda y: (y["label"] != F.col("label")) & (F.least(y["n"], n) * 100 >= F.greatest(y["n"], n) * percent) & (apart(y["bits"], F.col("bits")) * (100 + percent) <= (y["n"] + n) * (100 - percent))


def marks() -> list[Column]:
    """128 bits of a set of members."""
    return [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in range(2)]


def led(scratch: Scratch, rows: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(leader, id, big) to compare, from rows of (keys, n, id, label, odd).

    Buckets with few odd members give the pairs of those with all others, the
    smaller set first, that by sizes and parities can reach the similarity and
    differ in label; the rest give each member with its leader. Buckets of one
    component or without a row marked ``odd`` are left out, and of those with
    the same members one is taken.
    """
    by_label = rows.groupBy(*keys, "label").agg(F.count("*").alias("c"), F.min(F.struct("n", "id")).alias("l"), F.max("odd").alias("odd"), *marks())
    per = by_label.groupBy(*keys).agg(F.sum("c").alias("size"), F.min("l").alias("l"), F.max(F.struct("c", "label")).alias("m"), F.max("odd").alias("odd"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"))
    per = per.where("odd and size > m.c").select(*keys, "size", "l", F.col("m.label").alias("main"), (F.col("size") - F.col("m.c")).alias("n_odd"), "h0", "h1")
    once = per.groupBy("h0", "h1", "size", "l", "main", "n_odd").agg(F.min(F.struct(*keys)).alias("k")).select("k.*", "size", F.col("l.id").alias("leader"), "main", "n_odd")
    all_ = scratch.write(rows.select(*keys, "id", "n", "label").join(once, keys), "open-members")
    big = all_.where((F.col("n_odd") > ODD) & (F.col("id") != F.col("leader"))).select("leader", "id", F.lit(True).alias("big"))
    parts = F.ceil(F.col("size") / SPLIT)
    few = all_.where(F.col("n_odd") <= ODD).join(sets.select("id", "bits"), "id").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    odd = few.where(F.col("label") != F.col("main")).groupBy(*keys).agg(F.collect_list(F.struct("n", "id", "label", "bits")).alias("odd"), F.max(parts).alias("parts"))  # ODD members at most
    odd = odd.select(*keys, "odd", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    mine = F.transform(F.filter("odd", fits(percent)), lambda y: F.struct(y["n"].alias("n"), y["id"].alias("id")))
    pair = few.join(odd, [*keys, "part"]).select(F.struct("n", "id").alias("x"), F.explode(mine).alias("y"))
    pair = pair.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    both = big.unionByName(pair.select(F.col("x.id").alias("leader"), F.col("y.id").alias("id"), F.lit(False).alias("big")))
    return both.groupBy("leader", "id").agg(F.max("big").alias("big"))


def buckets(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """bucket, id, n, size and leader (the smallest set) of the table keys that two classes or more share; one of those with the same members."""
    own = classes.select("id", "n", F.posexplode("keys").alias("g", "key")).select("id", "n", F.col("g").cast("byte").alias("g"), F.xxhash64("g", "key").alias("key"))
    shared = own.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    alive = scratch.write(own.join(shared, "key").groupBy("id", "n").agg(F.collect_list(F.struct("g", "key")).alias("gs")), "shared-groups")
    side = lambda lo: F.transform(F.filter("gs", (lambda x: x["g"] < GROUPS) if lo else (lambda x: x["g"] >= GROUPS)), lambda x: x["key"])
    table = F.flatten(F.transform(side(True), lambda x: F.transform(side(False), lambda y: F.xxhash64(x, y))))
    rows = alive.select("id", "n", F.explode(table).alias("bucket"))
    per = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("n", "id")).alias("l"), *marks()).where("size > 1")
    once = per.groupBy("h0", "h1", "size", "l").agg(F.min("bucket").alias("bucket")).select("bucket", "size", F.col("l.id").alias("leader"))
    return scratch.write(rows.join(once, "bucket"), "members")


def hubs(members: DataFrame) -> DataFrame:
    """id, n, hub (the leader of its largest bucket) and that bucket, parts of the hub's members, heads (parts of its own members, if it is a hub)."""
    of = members.groupBy("id", "n").agg(F.max(F.when(F.col("id") != F.col("leader"), F.struct("size", "leader", "bucket"))).alias("m"))
    of = of.select("id", "n", F.col("m.leader").alias("hub"), F.col("m.bucket").alias("bucket"))
    parts = of.where("hub is not null").groupBy("hub").agg(F.ceil(F.count("*") / HUB_SPLIT).alias("parts"))
    return of.join(parts, "hub", "left").join(parts.toDF("id", "heads"), "id", "left")


def hub_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) of each set with its hub's: one comparison a set."""
    heads = sets.where("heads is not null").select(F.col("id").alias("hub"), F.col("s").alias("ls"), F.col("bits").alias("lbits"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("heads") - 1)).alias("part"))
    own = sets.where("hub is not null").select("hub", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "s", "bits")
    both = own.join(heads, ["hub", "part"])
    n = F.size("s") + F.size("ls")
    can = apart(F.col("bits"), F.col("lbits")) * (100 + percent) <= n * (100 - percent)
    common = F.size(F.array_intersect("s", "ls"))
    return both.where(can & (common * 100 >= (n - common) * percent)).select(F.col("hub").alias("x"), F.col("id").alias("y"))


def nearest(scratch: Scratch, members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """(leader, id, big) with one pair a set that is apart from its hub: the nearest, by parities, of the other components in that bucket; None if FEW_APART sets or fewer are.

    A set brings one row, however many buckets it is in. These pairs only join
    components early; ``led`` takes what is still apart, in every bucket.
    """
    of = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label"))
    lost = sets.where("hub is not null").select("id", "n", "bits", "hub", "bucket").join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    lost = lost.withColumn("label", F.coalesce("id_label", "id")).where(F.col("label") != F.coalesce("hub_label", "hub"))
    lost = scratch.write(lost.select("bucket", "id", "n", "label", "bits"), "apart")
    if lost.count() <= FEW_APART:
        return None
    rows = members.join(lost.select("bucket").distinct(), "bucket", "left_semi").join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
    by = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.min(F.struct("n", "id")).alias("l"))
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("c"), "l"))).where(F.col("r") <= ODD)
    reps = ranked.select("bucket", "label", "l.n", "l.id").join(sets.select("id", "bits"), "id").groupBy("bucket").agg(F.collect_list(F.struct("n", "id", "label", "bits")).alias("reps"))  # ODD at most
    near = F.array_min(F.transform(F.filter("reps", fits(percent)), lambda y: F.struct(apart(y["bits"], F.col("bits")).alias("d"), y["id"].alias("leader"))))["leader"]
    one = lost.join(reps, "bucket").select("id", near.alias("leader")).where("leader is not null")
    return one.select(F.least("leader", "id").alias("leader"), F.greatest("leader", "id").alias("id"), F.lit(False).alias("big")).distinct()


def marked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose id has its bit in a broadcast map of ``ids``: all of these, and few others."""
    bits = 1 << min(max(16 * ids.count(), 1 << 10).bit_length(), MAP_BITS)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.floor(at / 64).alias("__w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))")
    have = ids.select(word, bit.alias("b")).groupBy("__w").agg(F.bit_or("b").alias("__b"))
    return texts.withColumn("__w", word).join(F.broadcast(have), "__w").where(F.col("__b").bitwiseAND(bit) != 0).select("doc_id", "text")  # 2 ** MAP_BITS / 64 rows at most


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """leader, id, big, n, whether they link, and for big buckets the prefix of id's set without the leader's."""
    left = sets.select(F.col("id").alias("leader"), F.col("s").alias("ls"))
    few = pairs.where(~F.col("big")).join(left, "leader")
    many = pairs.where("big").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    heads = many.select("leader", "salt").distinct().join(left, "leader")
    many = many.join(heads, ["leader", "salt"]).drop("salt")
    both = few.unionByName(many).join(sets.select("id", "s"), "id").withColumn("n", F.size("s").cast("long")).withColumn("ln", F.size("ls").cast("long"))
    both = both.withColumn("rest", F.array_except("s", "ls"))
    common = F.col("n") - F.size("rest")
    hit = common * 100 >= (F.col("n") + F.col("ln") - common) * percent
    # a partner has at least max(ln, percent of n) shingles, so it shares at least ``need``
    partner = F.greatest(F.col("ln"), F.floor((F.col("n") * percent + 99) / 100))
    need = F.floor(((F.col("n") + partner) * percent + 99 + percent) / (100 + percent))
    prefix = F.slice("rest", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(0)).cast("int"))
    return both.select("leader", "id", "big", "n", hit.alias("hit"), F.when(F.col("big"), prefix).alias("prefix"))


def needed(scratch: Scratch, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of both sides of ``pairs``."""
    need = scratch.write(pairs.select(F.explode(F.array("leader", "id")).alias("id")).distinct(), "needed")
    less = F.broadcast(need) if need.count() <= FEW_IDS else need  # FEW_IDS ids at most
    return sets.join(less, "id", "left_semi").select("id", "s", "bits")


def refine(scratch: Scratch, star: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(leader, id, big) of the next buckets: members of one leader in different components that share a prefix shingle."""
    of = star.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of = of.join(labels.select(F.col("id").alias("leader"), F.col("label").alias("ll")), "leader", "left").withColumn("ll", F.coalesce("ll", "leader"))
    open_ = of.where("label <> ll").select("leader").distinct()
    # only shingles of members outside the leader's component can matter: these are the odd rows
    rows = of.join(open_, "leader", "left_semi").select(F.col("leader").alias("under"), "id", "n", "label", (F.col("label") != F.col("ll")).alias("odd"), F.explode("prefix").alias("s"))
    return led(scratch, rows, sets, ["under", "s"], percent)


def joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the edges (x, y), ascending, and the smallest id reachable from it."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    top = np.arange(len(ids))
    while (two := top[a] != top[b]).any():
        p, q = top[a[two]], top[b[two]]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))  # roots hook to smaller ones
        while (top[top] != top).any():
            top = top[top]
    return ids, ids[top]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """id and label (smallest id reachable) of every id in ``edges`` (x, y); None without edges.

    By contraction: each vertex hooks to its smallest neighbour, chains of
    hooks are shortened, edges are renamed by it and those within one vertex
    go. Every round leaves fewer vertices and edges; the hooks composed are the
    labels. Vertices hook to smaller ones only, so the root of a component is
    its smallest id. Edges are joined on the driver once FEW_EDGES or fewer are
    left: each round here costs the driver more than they do.
    """
    left = scratch.write(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    labels = None
    while n_edges := left.count():
        if n_edges <= FEW_EDGES:
            got = left.toArrow()  # FEW_EDGES rows at most
            v, to = joined(got.column("x").to_numpy(), got.column("y").to_numpy())
            hook = scratch.write(edges.sparkSession.createDataFrame(pa.table({"id": v, "label": to})), "labels")
            if labels is None:
                scratch.drop(left)
                return hook
            hook = hook.toDF("v", "to")
            labels, was = scratch.write(labels.join(hook, labels.label == hook.v, "left").select("id", F.coalesce("to", "label").alias("label")), "labels"), labels
            scratch.drop(left, was)
            return labels
        ends = left.select(F.explode(F.array(F.struct(F.col("y").alias("v"), F.col("x").alias("to")), F.struct(F.col("x").alias("v"), F.col("x").alias("to")))).alias("e"))
        hook = ends.groupBy("e.v").agg(F.min("e.to").alias("to"))
        for _ in range(2):  # a chain of four hooks becomes one
            nxt = hook.select(F.col("v").alias("to"), F.col("to").alias("far"))
            hook = hook.join(nxt, "to").select("v", F.col("far").alias("to"))
        hook = scratch.write(hook, "hooks")
        to = lambda k: hook.select(F.col("v").alias(k), F.col("to").alias(f"{k}2"))  # noqa: B023, E731
        moved = left.join(to("x"), "x").join(to("y"), "y").select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y"))
        before, was = left, labels
        left = scratch.write(moved.where("x <> y").distinct(), "edges")
        if labels is None:
            labels = hook.select(F.col("v").alias("id"), F.col("to").alias("label"))
            scratch.drop(before)
        else:
            labels = scratch.write(labels.join(hook, labels.label == hook.v, "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            scratch.drop(before, was, hook)
    return labels


def relabel(scratch: Scratch, labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after further ``edges`` (x, y): only those between different labels count."""
    if labels is None:
        found = components(scratch, edges)
        if found is None:
            found = edges.sparkSession.createDataFrame([], "id bigint, label bigint")
        return found if id(found) in scratch.paths else scratch.write(found, "labels")
    of = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"{k}2"))
    e = edges.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y")).where("x <> y")
    found = components(scratch, e)
    if found is None:
        return labels
    new = found.withColumnsRenamed({"id": "was", "label": "now"})
    old = labels.join(new, labels.label == new.was, "left").select("id", F.coalesce("now", "label").alias("label"))
    fresh = new.join(labels, new.was == labels.id, "left_anti").select(F.col("was").alias("id"), F.col("now").alias("label"))
    return scratch.write(old.unionByName(fresh), "labels")


def involved_sets(texts: DataFrame, k: int, involved: DataFrame) -> DataFrame:
    """``involved`` with each class's set, the rarest shingles first, and its parities."""
    ids = involved.select("doc_id").distinct()
    own = full_sets(marked(texts, ids), k, common_shingles(texts, k, ids)).groupBy("a", "b").agg(F.first("s").alias("s"), F.first("bits").alias("bits"))
    return own.join(involved.drop("doc_id"), ["a", "b"]).drop("a", "b")


def same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (x, y) between the classes of each id that has texts of several."""
    twice = rows.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi")).where("lo <> hi").select("doc_id")
    of = rows.join(twice, "doc_id", "left_semi").join(classes.select("a", "b", "id"), ["a", "b"]).select("doc_id", "id").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("x")), "doc_id").select("x", F.col("id").alias("y"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = scratch.write(sketches(texts, k), "sketches")
    some = sk.where("n > 0 and doc_id is not null")
    classes = some.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers hold once they are written
    members = buckets(scratch, classes)
    involved = scratch.write(hubs(members).join(classes.select("id", "a", "b", "doc_id"), "id"), "involved")
    sets = scratch.write(involved_sets(texts, k, involved), "sets")
    scratch.keep(sk, classes, members, sets)
    labels = relabel(scratch, None, hub_links(sets, percent).unionByName(same_id(some, classes)))
    named = lambda: members.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"), F.lit(True).alias("odd"))
    for _ in range(NEAR):
        group = nearest(scratch, members, sets, labels, percent)
        if group is None or (group := scratch.write(group, "nearest")).isEmpty():
            break
        star = scratch.write(compare(group, needed(scratch, sets, group), percent), "stars")
        labels = relabel(scratch, labels, star.where("hit").select(F.col("leader").alias("x"), F.col("id").alias("y")))
        scratch.keep(sk, classes, members, sets, labels)
    rows = named()
    group = scratch.write(led(scratch, rows, sets, ["bucket"], percent), "candidates")
    while not group.isEmpty():
        scratch.keep(sk, classes, sets, group, labels)
        sets = scratch.write(needed(scratch, sets, group), "sets")  # this and the next rounds' sets
        star = scratch.write(compare(group, sets, percent), "stars")
        labels = relabel(scratch, labels, star.where("hit").select(F.col("leader").alias("x"), F.col("id").alias("y")))
        scratch.keep(sk, classes, sets, star, labels)
        if star.where("big").isEmpty():
            break
        group = scratch.write(refine(scratch, star.where("big"), sets, labels, percent), "candidates")
    scratch.keep(sk, classes, labels)
    first = labels.join(classes.select("id", "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("first"))
    first = labels.join(first, "label").select("id", "first")
    of = classes.select("a", "b", "id", "doc_id").join(first, "id", "left").select("a", "b", F.coalesce("first", "doc_id").alias("component_id"))
    rest = sk.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), "doc_id")
    out = some.select("a", "b", "doc_id", F.col("n").alias("n_shingles")).join(of, ["a", "b"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rest.toDF("doc_id", "n_shingles", "component_id"))
    return out.select("*", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less every row that is not the first of its component."""
    got = near_duplicates(docs, k, percent).where("doc_id is not null")
    per = got.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    out_ = Scratch(docs.sparkSession).write(per.where("not kept or rows > 1").select(F.col("doc_id").alias("__id"), "kept"), "not-alone")
    here = F.col("doc_id").cast("long") == F.col("__id")
    alone = docs.join(out_.select("__id"), here, "left_anti").select(*columns(docs))
    twice = out_.where("kept").select("__id")
    if not twice.limit(1).count():  # the usual case: no text is read for repeated ids
        return alone
    again = docs.join(twice, here, "left_semi")
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*columns(docs)), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__row"))
    return alone.unionByName(one.select("__row.*"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by four-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, percent=80)


ORACLE_SQL = None
