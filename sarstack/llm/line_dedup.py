"""Drop lines that many documents share (operator 9).

Distinct line hashes are counted by document, then sharded. Each shard gets a
minimal perfect hash whose slots index two arrays: a fingerprint and a document
count. Documents probe the arrays; no line is joined to anything.

What is stored: every distinct line of the corpus. A line is 128 bits: its own
bytes up to 15, a cryptographic digest beyond. Every line that is looked up is
one of the stored, so its slot is its own; the 32-bit fingerprint beside it
tells a table that is not of this corpus. Counts are exact and take as many
bytes as their shard's largest needs. A key costs about 5 bits of the function,
4 bytes of fingerprint and 1 to 8 of count.

Scale: a shard holds about ``shard_keys`` keys, so building is bounded by that
and not by any key's frequency (lines are counted by block before the shuffle).
A probing task collects the lines of ``probe_bytes`` of text, then visits each
shard that one of them lies in once, in order, through a cache of at most
``cache_bytes``.

Defined cases: a null or empty text is one empty line. Keys shorter than
``min_key`` code points are never dropped. A line counts once per row, so
repeated rows (even with the same id) are separate documents. An empty table
gives an empty result. Extra columns pass through ``drop_lines`` unless they
bear the names of its own outputs, which it replaces.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..workers import ready
from ._bytes import LOWER, Block, Ids, blocks, distinct, exact_codes, mix, owner
from ._store import Scratch, col, fresh_dir

U = np.uint64
_TRIM = np.zeros(256, bool)
_TRIM[[0x20, *range(0x09, 0x0E)]] = True


def line_keys(block: Block, min_key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (2, lines), whether each line may be dropped, line starts, ends, first lines."""
    starts, ends, first = block.lines()
    solid = np.flatnonzero(~_TRIM[block.buf])
    a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = z > a
    last = max(len(solid) - 1, 0)
    ks = np.where(some, solid[np.minimum(a, last)] if len(solid) else 0, starts)
    ke = np.where(some, solid[np.maximum(z - 1, 0)] + 1 if len(solid) else 0, starts)
    heads = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
    ids = Ids(LOWER[block.buf], ks, ke)
    hi = mix(ids.hi)
    return np.stack([mix(ids.lo ^ hi), hi]), heads[ke] - heads[ks] >= max(min_key, 0), starts, ends, first


def count_lines(docs: DataFrame, min_key: int = 1) -> DataFrame:
    """``a``, ``b`` (a line's 128 bits) and ``n`` (documents that hold it), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch):
                keys, may, _, _, first = line_keys(block, min_key)
                kept = np.concatenate([[0], np.cumsum(may)])[first]
                keys = keys[:, may]
                code, one = exact_codes(keys[0], *keys)
                n = np.bincount(distinct(code, kept)[0], minlength=len(one))
                yield pa.RecordBatch.from_arrays([*(pa.array(k[one].view(np.int64)) for k in keys), pa.array(n)], names=["a", "b", "n"])

    ready(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


# --- minimal perfect hash -------------------------------------------------

def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(mix(keys[0] + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + keys[1]) % U(size)).astype(np.int64)


def build_mph(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level and the slot of each distinct key (2, keys).

    Keys that meet no other in a level's bit array stay there; the others try
    the next level. A key's slot is the number of bits set before its own.
    """
    n = keys.shape[1]
    levels, slots = [], np.empty(n, np.int64)
    left, done = np.arange(n), 0
    while len(left):
        size = -(-max(64, int(len(left) * gamma)) // 64) * 64
        at = _slot(keys[:, left], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        slots[left[alone]] = done + np.cumsum(bits)[at[alone]] - 1
        levels.append(bits)
        done += int(alone.sum())
        left = left[~alone]
    return levels, slots


_HEAD = struct.Struct("<QQB")  # levels, keys, bytes of a count


class Shard:
    """One shard's function and arrays, as they lie in a file."""

    def __init__(self, raw: bytes):
        n_levels, n, width = _HEAD.unpack_from(raw)
        at = _HEAD.size
        words = np.frombuffer(raw, "<u8", n_levels, at)
        at += 8 * n_levels
        self.levels, before = [], 0
        for k in map(int, words):
            bits = np.frombuffer(raw, "<u8", k, at)
            at += 8 * k
            ones = np.bitwise_count(bits)
            ranks = (before + np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32)  # bits set before each word
            before += int(ones.sum())
            self.levels.append((bits, ranks))
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.counts = np.frombuffer(raw, f"<u{width}", n, at + 4 * n)
        self.nbytes = sum(12 * len(b) for b, _ in self.levels) + (4 + width) * n

    @staticmethod
    def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
        levels, slots = build_mph(keys)
        width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << 8 * w)
        prints, cs = np.empty(keys.shape[1], "<u4"), np.empty(keys.shape[1], f"<u{width}")
        prints[slots], cs[slots] = keys[1] >> U(32), counts
        bits = [np.packbits(b, bitorder="little").tobytes() for b in levels]
        return _HEAD.pack(len(levels), keys.shape[1], width) + np.array([len(b) // 64 for b in levels], "<u8").tobytes() + b"".join(bits) + prints.tobytes() + cs.tobytes()

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Document counts; 0 where the fingerprint is not the key's."""
        out, left = np.zeros(keys.shape[1], np.int64), np.arange(keys.shape[1])
        for k, (bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(keys[:, left], k, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(U)
            here = (word >> bit) & U(1) == 1
            slot = ranks[at[here] >> 6] + np.bitwise_count(word[here] & ((U(1) << bit[here]) - U(1)))
            mine = left[here]
            good = self.prints[slot] == keys[1][mine] >> U(32)
            out[mine[good]] = self.counts[slot[good]]
            left = left[~here]
        return out


def shard_of(a: np.ndarray, n_shards: int) -> np.ndarray:
    return ((a >> U(33)) % U(n_shards)).astype(np.int64)


class Shards:
    """Shards read on demand from the shared folder, at most ``cache_bytes`` held."""

    def __init__(self, uri: str, n_shards: int, present: frozenset[int], cache_bytes: int):
        self.uri, self.n, self.present, self.most = uri, n_shards, present, cache_bytes
        self.held: OrderedDict[int, Shard] = OrderedDict()
        self.fs, self.path = pafs.FileSystem.from_uri(uri)

    def shard(self, k: int) -> Shard:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        with self.fs.open_input_stream(f"{self.path}/{k:06d}.mph") as f:
            s = Shard(f.read())
        self.held[k] = s
        while len(self.held) > 1 and sum(x.nbytes for x in self.held.values()) > self.most:
            self.held.popitem(last=False)
        return s

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Document counts of keys (2, lines); each shard is visited once."""
        out = np.zeros(keys.shape[1], np.int64)
        if not keys.shape[1]:
            return out
        of = shard_of(keys[0], self.n)
        order = np.argsort(of, kind="stable")
        visited, cut = np.unique(of[order], return_index=True)
        for k, at in zip(visited.tolist(), np.split(order, cut[1:]), strict=True):
            if k in self.present:
                out[at] = self.shard(k).get(keys[:, at])
        return out


def build_table(counts: DataFrame, uri: str, shard_keys: int = 1 << 18) -> tuple[int, frozenset[int]]:
    """Write the shards of (a, b, n) under ``uri``; returns their number and which have keys.

    One task builds a shard; it writes under its own name and then renames, so
    a task that runs twice leaves the same file.
    """
    scratch = Scratch(counts.sparkSession)
    counts = scratch.write(counts, "line-counts")
    n = counts.count()
    n_shards = max(1, -(-n // shard_keys))
    shard = F.pmod(F.shiftrightunsigned("a", 33), F.lit(n_shards)).alias("shard")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        k = key[0].as_py()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64).view(U) for c in ("a", "b")])
        name = f"{path}/{k:06d}.mph"
        tmp = f"{name}.{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(tmp) as f:
            f.write(Shard.pack(keys, table.column("n").to_numpy()))
        fs.move(tmp, name)
        return pa.table({"shard": pa.array([k], pa.int64()), "keys": pa.array([keys.shape[1]], pa.int64())})

    made = counts.select(shard, "a", "b", "n").groupBy("shard").applyInArrow(pack, "shard bigint, keys bigint")
    present = frozenset(r.shard for r in made.select("shard").collect())  # one number a shard
    scratch.keep()
    return n_shards, present


def runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches of about ``limit`` bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def drop_lines(docs: DataFrame, min_docs: int = 10, min_key: int = 1, shard_keys: int = 1 << 18, probe_bytes: int = 32 << 20, cache_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``text`` less its widely shared lines, ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    uri = fresh_dir(spark, "line-table")
    n_shards, present = build_table(count_lines(docs, min_key), uri, shard_keys)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    plain = [f"c{i}" for i in range(len(rest))]  # Arrow functions resolve columns by name, and a dot would be a path
    src = docs.select(*map(col, rest), F.col("text").cast("string")).toDF(*plain, "text")
    schema = StructType([*src.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Shards(uri, n_shards, present, cache_bytes)
        for held in runs(batches, probe_bytes):
            parts = [(batch, i, j, block, *line_keys(block, min_key)) for batch in held for i, j, block in blocks(batch)]
            gone = [may.copy() for *_, may, _, _, _ in parts]
            counts = table.get(np.concatenate([keys[:, may] for _, _, _, _, keys, may, *_ in parts], axis=1)) if parts else []
            at = 0
            for g in gone:
                n = int(g.sum())
                g[g] = counts[at : at + n] >= min_docs
                at += n
            for (batch, i, j, block, _, _, starts, ends, first), g in zip(parts, gone, strict=True):
                text, dropped = without(block, starts, ends, first, g)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(rest))), text, pa.array(np.diff(first)), pa.array(dropped)], names=[*plain, "text", "n_lines", "n_dropped"])

    return src.mapInArrow(run, schema).toDF(*rest, "text", "n_lines", "n_dropped")


def without(block: Block, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts of a block less the lines ``gone``, and how many each loses."""
    cut = np.concatenate([[0], np.cumsum(gone)])
    dropped = cut[first[1:]] - cut[first[:-1]]
    # bytes that stay: each kept line, and a newline before it unless it is the first kept
    doc = owner(first)
    stay = np.flatnonzero(~gone)
    lead = np.ones(len(stay), bool)
    lead[1:] = doc[stay][1:] != doc[stay][:-1]
    mark = np.zeros(len(block.buf) + 1, np.int32)
    begin = starts[stay] - ~lead  # a kept line that is not the document's first kept takes the newline before it
    np.add.at(mark, begin, 1)
    np.add.at(mark, ends[stay], -1)
    keep = np.cumsum(mark[:-1]) > 0
    buf = block.buf[keep]
    size = np.concatenate([[0], np.cumsum(keep)])[block.offs].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), block.n, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(buf.tobytes())]).cast(pa.string()), dropped


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; lines of at least 10 documents go from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(x, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE f.key IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY rid, doc_id
"""
