"""Token ids in sorted-string-table files (operator 5).

A shard holds the documents of one key range in ascending order:

    magic b"SSTT", u16 version, u16 id width (2 or 4 bytes)
    blocks   entries, zstd-compressed as one frame
    index    for each block: first key, offset, length, entries
    bloom    bits of the Bloom filter over the keys
    footer   fixed size: offsets and lengths of index and filter, counts, magic

An entry is (shared, rest) lengths of the key against the previous one, the
key's rest, the payload's length and the payload: the ids in little-endian
order, the end id last. A key is the document's id, made unsigned by its sign
bit and big-endian (so that byte order is id order), after a byte 1; a null id
is the single byte 0. The first key of a block is stored whole, so a reader
needs one block for a lookup: filter, binary search of the index, then a scan
of that block.

Every task writes the shards of its own range under a temporary name and
renames them; a task that runs again leaves the same files. Memory is bounded
by one block, the index and the keys' filter of a shard; a shard is closed
beyond ``shard_bytes``.

Defined cases: null and empty texts hold the end id alone. Null ids come
first; documents with equal ids keep one entry each, in the order of their
texts. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready
from ._bytes import blocks
from ._pieces import encoder
from ._store import fresh_dir, written

MAGIC, VERSION = b"SSTT", 1
_FOOT = struct.Struct("<QQQQQQ4s")
_BLOOM_HASHES = 7
_MANIFEST = "shard string, part int, seq int, first_key binary, last_key binary, n_docs bigint, n_ids bigint, n_bytes bigint"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_at(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5EED) | 1
    return [(a + i * b) % bits for i in range(_BLOOM_HASHES)]


class Writer:
    """One shard, written front to back."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 16, level: int = 1):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.z = zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC + struct.pack("<HH", VERSION, width)) or 8
        self.at = 8
        self.buf, self.n, self.first, self.last = bytearray(), 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0

    def add(self, key: bytes, payload: bytes) -> None:
        if not self.n:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.buf += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(payload)) + payload
        self.last, self.n = key, self.n + 1
        self.n_ids += len(payload) // self.width
        self.keys.append(key)
        if len(self.buf) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            raw = self.z.compress(bytes(self.buf))
            self.out.write(raw)
            self.index.append((self.first, self.at, len(raw), self.n))
            self.at += len(raw)
            self.buf, self.n = bytearray(), 0

    def close(self) -> int:
        """Write index, filter and footer; returns the file's size."""
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(c) for k, o, n, c in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_at(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        foot = _FOOT.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.n_ids, MAGIC)
        self.out.write(index + packed + foot)
        return self.at + len(index) + len(packed) + len(foot)


class Reader:
    """A shard for lookups by key and for scans; ``f`` is a random-access file."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(0)
        head = f.read(8)
        self.width = struct.unpack("<HH", head[4:])[1]
        f.seek(size - _FOOT.size)
        i_at, i_len, b_at, self.bits, self.n_docs, self.n_ids, magic = _FOOT.unpack(f.read(_FOOT.size))
        if head[:4] != MAGIC or magic != MAGIC:
            raise ValueError("not a token shard")
        f.seek(i_at)
        raw = f.read(i_len)
        self.index, at = [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            k, at = raw[at : at + n], at + n
            o, at = _read_varint(raw, at)
            z, at = _read_varint(raw, at)
            c, at = _read_varint(raw, at)
            self.index.append((k, o, z, c))
        f.seek(b_at)
        self.bloom = np.unpackbits(np.frombuffer(f.read((self.bits + 7) // 8), np.uint8), count=self.bits)
        self.z = zstandard.ZstdDecompressor()

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, o, z, c = self.index[i]
        self.f.seek(o)
        raw, at, key = self.z.decompress(self.f.read(z)), 0, b""
        for _ in range(c):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + rest], at + rest
            n, at = _read_varint(raw, at)
            yield key, raw[at : at + n]
            at += n

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of every entry under ``key``."""
        if not all(self.bloom[j] for j in _bloom_at(key, self.bits)):
            return []
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:  # equal keys may begin in the block before
            i -= 1
        out = []
        for j in range(i, len(self.index)):
            if firsts[j] > key:
                break
            out += [np.frombuffer(p, f"<u{self.width}") for k, p in self.block(j) if k == key]
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)


def write_tokens(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 0, partitions: int | None = None, shard_bytes: int = 256 << 20, block_bytes: int = 1 << 16, task_bytes: int = 256 << 20) -> DataFrame:
    """Write all of ``docs`` under ``uri``; returns the manifest, one row a shard.

    There are as many tasks as the session has shuffle partitions, or more, so
    that each has about ``task_bytes`` of text; ``partitions`` overrides both.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // task_bytes))
    ranged = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        enc, fs, root, made = encoder(tokenizer), None, "", []
        width = int(enc.width[-1])
        end = np.array([end_id], enc.width).tobytes()
        w = None

        def close() -> None:
            size = w.close()
            w.out.close()
            name = f"{part:06d}-{len(made):04d}.sst"
            fs.move(tmp, f"{root}/{name}")
            made.append((name, part, len(made), w.keys[0], w.keys[-1], len(w.keys), w.n_ids, size))

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, block in blocks(batch):
                got, first = enc.encode_block(block)
                for k, a, z in zip(ids[i:j], first[:-1], first[1:], strict=True):
                    if w is None:
                        if fs is None:
                            fs, root = pafs.FileSystem.from_uri(uri)
                            fs.create_dir(root, recursive=True)
                        tmp = f"{root}/_{part:06d}-{len(made):04d}-{attempt}"
                        w = Writer(fs.open_output_stream(tmp), width, block_bytes)
                    w.add(key_of(k), got[a:z].tobytes() + end)
                    if w.at >= shard_bytes:
                        close()
                        w = None
        if w is not None:
            close()
        if made:
            cols = list(zip(*made, strict=True))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "part", "seq", "first_key", "last_key", "n_docs", "n_ids", "n_bytes"])

    return written(ranged.mapInArrow(run, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, uri: str, payload: bool = False) -> DataFrame:
    """Every entry of the shards in key order: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids of all documents before. With ``payload``
    the ids come along as an array.
    """
    spark = manifest.sparkSession
    # one row a shard: their running sums, not the documents', pass through one task
    before = F.expr("coalesce(sum(n_ids) over (order by part, seq rows between unbounded preceding and 1 preceding), 0)")
    ready(manifest.sparkSession)
    shards = manifest.select("shard", "n_bytes", before.alias("start"))
    shards = shards.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "n_bytes", "start")), strict=True):
                fs, root = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(f"{root}/{name}") as f:
                    r = Reader(f, size)
                    rows = []
                    for key, raw in r.scan():
                        ids = np.frombuffer(raw, f"<u{r.width}").astype("<u4")
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int64),) if payload else ()))
                        at += len(ids)
                        if len(rows) >= (64 if payload else 4096):
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * payload)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def lookup(manifest: DataFrame, uri: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of the entries of one document, from the shards whose range holds it."""
    key = key_of(doc_id)
    out = []
    for row in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("part", "seq").collect():
        fs, root = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(f"{root}/{row.shard}") as f:
            out += Reader(f, row.n_bytes).get(key)  # footer, index, filter and one block or two
    return out


def encode_and_read(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write ``docs`` to fresh shards and return what the files hold."""
    uri = fresh_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, uri), uri)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by byte_bpe_50k.json, end id 0, from the files."""
    return encode_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
