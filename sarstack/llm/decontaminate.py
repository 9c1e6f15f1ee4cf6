"""Benchmark decontamination by a BM25 index with block-max WAND (operator 4).

The test items form an inverted index: for each term the items that hold it,
in blocks of ``BLOCK_ITEMS`` items with the block's largest impact. Impacts are
BM25 term scores divided by the item's score against itself, so 1 means that
a passage holds all of an item's terms. Every passage of every document is a
query: windows of 2 s words, s words apart, s at least the longest item, so
that any item copied into a text lies whole in some window. All items that
score at least ``threshold`` are retrieved and verified exactly.

Block-max pruning comes first and runs over all passages of a batch at once:
for each (passage, block of items) the block maxima of the passage's terms are
summed, and pairs below the threshold are skipped. The passages that are left
go through WAND over the surviving blocks: pivot by term maxima, check by
block maxima, then score.

Verification: an item's five-word windows (its whole sequence if shorter) that
the document holds, as a share. The item is leaked if the share is ``overlap``
(0.8) or more, of the item or of its question (all but the last sentence) or its
answer (the last sentence) alone, the latter two if they have ``PART_WORDS``
words or more. Leaks of such parts are found by their windows, so that none
depends on the item's score; where no passage reaches ``threshold``, the score
is that of the whole document.

Words are lower-cased in A-Z and lose ASCII punctuation, so case and
punctuation do not hide a copy; a word of punctuation alone is no word.

The index goes out with the code, in shards of at most ``INDEX_BYTES`` of item
texts (a single longer item is a shard of its own), one after the other. Number
of items, document frequencies, mean length and the longest item are counted
over all items first and are the same for every shard: how items are dealt to
shards changes neither scores nor passages.

Defined cases: null or empty texts and items match nothing. Items with equal
texts match alike, each under its own id; null item ids are kept. Repeated
rows of items count once, repeated rows of documents match one by one. Empty tables give an empty result. Other
columns of documents or items may have any names; ``decontaminate`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready
from ._bytes import Block, blocks, distinct, shingles, unique
from ._store import written

U = np.uint64
K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK_ITEMS = 2
PART_WORDS = 8
INDEX_BYTES = 16 << 20
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def bare(block: Block) -> Block:
    """The block without ASCII punctuation."""
    keep = ~_PUNCT[block.buf]
    at = np.concatenate([[0], np.cumsum(keep)])
    return Block(block.buf[keep], at[block.offs].astype(np.int64))


def block_of(texts: list[str]) -> Block:
    raw = [t.encode() for t in texts]
    return Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a single sentence is both."""
    parts = re.split(r"(?<=[.?!])\s+|\n+", text.strip())
    return (text[: text.rstrip().rfind(parts[-1])], parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Stats:
    """Figures of all items; ``terms`` (ascending) with ``df`` hold a shard's words at least."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """BM25 postings of a shard's items, flat: built once on the driver, read-only after.

    ``stats`` are the figures of all items; without them these are all.
    """

    def __init__(self, ids: list[int | None], texts: list[str], stats: Stats | None = None):
        self.ids = ids
        block = bare(block_of(texts))
        words, first = block.word_hashes()
        self.longest = stats.longest if stats else int(np.diff(first).max(initial=0))
        self.sets = self._windows(texts)
        qa = [question_answer(t) for t in texts]
        self.questions, self.answers = self._windows([q for q, _ in qa]), self._windows([a for _, a in qa])
        self.long = list(zip([True] * len(qa), long_enough([q for q, _ in qa]), long_enough([a for _, a in qa]), strict=True))
        # windows of long questions and answers, each with the parts that have it
        parts = [(k, x[k]) for k in range(len(qa)) for x, long in zip((self.questions, self.answers), self.long[k][1:], strict=True) if long]
        self.part_item, self.part_size = np.array([k for k, _ in parts], np.int64), np.array([len(x) for _, x in parts], np.int64)
        flat = np.concatenate([x for _, x in parts]) if parts else np.empty(0, U)
        order = np.argsort(flat, kind="stable")
        self.part = np.repeat(np.arange(len(parts)), self.part_size)[order]
        self.window, at = np.unique(flat[order], return_index=True)
        self.part_at = np.append(at, len(flat))
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.vocab, term = np.unique(words, return_inverse=True)
        n, v = len(ids), len(self.vocab)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + doc, return_counts=True)
        self.term, self.item = pair // max(n, 1), pair % max(n, 1)  # by term, then item
        df = np.bincount(self.term, minlength=v)
        length = np.diff(first)
        if stats:
            df = stats.df[np.searchsorted(stats.terms, self.vocab)]
        total, mean = (stats.n, stats.mean) if stats else (n, length.mean() if n else 1)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        impact = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.item])
        own = np.bincount(self.item, impact, n)
        self.impact = impact / own[self.item] if len(impact) else impact
        self.at = np.searchsorted(self.term, np.arange(v + 1))
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if v else np.empty(0)
        # blocks of items: one entry for each (term, block) with the largest impact
        self.n_blocks = -(-n // BLOCK_ITEMS)
        key = self.term * max(self.n_blocks, 1) + self.item // BLOCK_ITEMS
        self.bkey, begin = np.unique(key, return_index=True)
        self.bmost = np.maximum.reduceat(self.impact, begin) if len(begin) else np.empty(0)
        self.bblock = self.bkey % max(self.n_blocks, 1)
        self.bat = np.searchsorted(self.bkey // max(self.n_blocks, 1), np.arange(v + 1))

    @staticmethod
    def _windows(texts: list[str]) -> list[np.ndarray]:
        block = bare(block_of(texts))
        words, first = block.word_hashes()
        w, f = shingles(words, first, SHINGLE)
        return [np.unique(w[a:z]) for a, z in zip(f[:-1], f[1:], strict=True)]

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term of each word hash, -1 if no item has it."""
        if not len(self.vocab):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def wand(self, terms: np.ndarray, threshold: float, allowed: set[int]) -> list[tuple[int, float]]:
        """Items scoring at least ``threshold`` for a set of distinct terms.

        Cursors walk the terms' postings in item order. The pivot is the first
        item that the term maxima can bring to the threshold; a block whose
        maxima cannot is jumped over as a whole.
        """
        eps = 1e-9
        cur = [[int(self.item[self.at[t]]), int(self.at[t]), int(self.at[t + 1]), int(t)] for t in terms]
        out = []
        while cur:
            cur.sort()
            total, pivot = 0.0, None
            for c in cur:
                total += self.most[c[3]]
                if total >= threshold - eps:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            blk = pivot // BLOCK_ITEMS
            ahead = [c for c in cur if c[0] <= pivot]
            fits = blk in allowed
            if fits:
                bound = 0.0
                for c in cur:
                    if c[0] // BLOCK_ITEMS <= blk:
                        k = int(np.searchsorted(self.bkey, c[3] * self.n_blocks + blk))
                        if k < len(self.bkey) and self.bkey[k] == c[3] * self.n_blocks + blk:
                            bound += self.bmost[k]
                fits = bound >= threshold - eps
            target = pivot if fits else (blk + 1) * BLOCK_ITEMS
            if fits and all(c[0] == pivot for c in ahead):
                score = sum(self.impact[c[1]] for c in ahead)
                if score >= threshold - eps:
                    out.append((pivot, float(score)))
                target = pivot + 1
            moved = []
            for c in cur:
                if c[0] < target:
                    c[1] += int(np.searchsorted(self.item[c[1] : c[2]], target))
                    if c[1] >= c[2]:
                        continue
                    c[0] = int(self.item[c[1]])
                moved.append(c)
            cur = moved
        return out


def retrieve(index: Index, block: Block, words: np.ndarray, first: np.ndarray, threshold: float, stride: int) -> list[tuple[int, int, float]]:
    """(document, item, best score) of all passages of a block's documents."""
    term = index.terms(words)
    per = np.diff(first)
    segs = -(-per // stride)
    seg_first = np.concatenate([[0], np.cumsum(segs)])
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return []
    doc = np.searchsorted(first, known, side="right") - 1
    seg = seg_first[doc] + (known - first[doc]) // stride
    t, v, nb = term[known], len(index.vocab), index.n_blocks
    back = seg > seg_first[doc]  # a word is also in the window that began one stride earlier
    pair = unique(np.concatenate([seg * v + t, (seg[back] - 1) * v + t[back]]))
    p, t = pair // v, pair % v
    size = index.bat[t + 1] - index.bat[t]
    at = np.repeat(index.bat[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    key = np.repeat(p, size) * nb + index.bblock[at]
    if seg_first[-1] * nb <= 1 << 22:
        bound = np.bincount(key, index.bmost[at])
        hits = np.flatnonzero(bound >= threshold - 1e-9)
    else:
        uniq, inv = np.unique(key, return_inverse=True)
        hits = uniq[np.bincount(inv, index.bmost[at]) >= threshold - 1e-9]
    best: dict[tuple[int, int], float] = {}
    for passage in np.unique(hits // nb):
        a, z = np.searchsorted(p, [passage, passage + 1])
        allowed = set((hits[(hits // nb) == passage] % nb).tolist())
        d = int(np.searchsorted(seg_first, passage, side="right") - 1)
        for item, score in index.wand(t[a:z], threshold, allowed):
            best[d, item] = max(best.get((d, item), 0.0), score)
    return [(d, i, s) for (d, i), s in sorted(best.items())]


def _share(want: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(want, have).mean()) if len(want) else 0.0


def item_words(items: DataFrame) -> DataFrame:
    """Number of words of each item of ``text``, and its distinct words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch):
                words, first = bare(block).word_hashes()
                own, at = distinct(words, first)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own.view(np.int64)))], names=["n", "words"])

    return items.select("text").mapInArrow(run, "n bigint, words array<bigint>")


def item_shards(items: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of at most ``limit`` bytes of text or one item."""
    items = written(items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null and text <> ''").distinct(), "items")
    size = F.octet_length("text").cast("long")
    total = items.agg(F.sum(size)).first()[0]
    if not total:
        return
    parts = 1
    while True:  # a hash deals items out evenly but for chance: more parts until each fits
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        worst = items.groupBy(part).agg(F.sum(size).alias("b"), F.min(F.struct("item_id", "text")).alias("lo"), F.max(F.struct("item_id", "text")).alias("hi")).where((F.col("b") > limit) & (F.col("lo") < F.col("hi")))
        if not worst.limit(1).count():
            break
        parts *= 2
    words = written(item_words(items), "item-words")
    row = words.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    df = words.select(F.explode("words").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    if parts > 1:
        df = written(df, "item-terms")
    for p in range(parts):
        own = items.where(part == p)
        rows = own.collect()  # ``limit`` bytes or one item
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        if rows:
            here = df if parts == 1 else df.join(item_words(own).select(F.explode("words").alias("t")).distinct(), "t")
            got = here.toArrow()  # the shard's words
            terms = got.column("t").to_numpy().astype(np.int64).view(U)
            order = np.argsort(terms)
            yield Index([r.item_id for r in rows], [r.text for r in rows], Stats(row[0], float(row[1]), row[2], terms[order], got.column("df").to_numpy()[order]))


def leaked_parts(index: Index, grams: np.ndarray, first: np.ndarray, overlap: float) -> set[tuple[int, int]]:
    """(document, item) where the document holds ``overlap`` of the windows of a long question or answer."""
    if not len(index.window):
        return set()
    at = np.searchsorted(index.window, grams)
    hit = np.flatnonzero(index.window[np.minimum(at, len(index.window) - 1)] == grams)
    doc = np.searchsorted(first, hit, side="right") - 1
    held = np.unique(doc * len(index.window) + at[hit])
    doc, at = held // len(index.window), held % len(index.window)
    size = index.part_at[at + 1] - index.part_at[at]
    part = index.part[np.repeat(index.part_at[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    pair, n = np.unique(np.repeat(doc, size) * len(index.part_size) + part, return_counts=True)
    doc, part = pair // len(index.part_size), pair % len(index.part_size)
    leak = n / index.part_size[part] >= overlap
    return set(zip(doc[leak].tolist(), index.part_item[part[leak]].tolist(), strict=True))


def long_enough(texts: list[str]) -> list[bool]:
    return (np.diff(bare(block_of(texts)).words()[2]) >= PART_WORDS).tolist() if texts else []


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Leaked items: doc_id, item_id, score and the overlaps of item, question and answer."""
    ready(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, score double, item_overlap double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in item_shards(items, index_bytes):
        handle = docs.sparkSession.sparkContext.broadcast(index)  # bounded by INDEX_BYTES of text
        out = out.unionByName(src.mapInArrow(_matcher(handle, threshold, overlap), schema))
    return out


def _matcher(handle, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        stride = max(64, index.longest)
        for batch in batches:
            for i, j, block in blocks(batch):
                block = bare(block)
                words, first = block.word_hashes()
                grams, g1 = shingles(words, first, SHINGLE)
                scores = {(d, k): score for d, k, score in retrieve(index, block, words, first, threshold, stride)}
                for d, k in leaked_parts(index, grams, g1, overlap) - scores.keys():
                    own = index.item == k
                    scores[d, k] = float(index.impact[own][np.isin(index.term[own], index.terms(words[first[d] : first[d + 1]]))].sum())
                found = [(*at, score) for at, score in sorted(scores.items())]
                if not found:
                    continue
                rows = []
                for d, k, score in found:
                    have = grams[g1[d] : g1[d + 1]]
                    short = words[first[d] : first[d + 1]]
                    shares = [_share(x[k], have) if len(x[k]) > 1 else _short(index, k, x, have, short) for x in (index.sets, index.questions, index.answers)]
                    if any(share >= overlap and long for share, long in zip(shares, index.long[k], strict=True)):
                        rows.append((i + d, index.ids[k], score, *shares))
                if rows:
                    at, ids, *nums = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in nums)], names=["doc_id", "item_id", "score", "item_overlap", "question_overlap", "answer_overlap"])

    return run


def _short(index: Index, k: int, sets: list[np.ndarray], have: np.ndarray, words: np.ndarray) -> float:
    """Share for a part with one window: the window itself, or its words in sequence if it is shorter."""
    want = sets[k]
    if not len(want):
        return 0.0
    for n in range(1, SHINGLE + 1):
        if len(words) >= n:
            got, _ = shingles(words, np.array([0, len(words)]), n) if n == SHINGLE else _windows_of(words, n)
            if np.isin(want, got).any():
                return 1.0
    return 0.0


def _windows_of(words: np.ndarray, n: int) -> tuple[np.ndarray, None]:
    """Hashes of n-word windows as ``shingles`` gives them to a text of n < SHINGLE words."""
    count = len(words) - n + 1
    flat = np.lib.stride_tricks.sliding_window_view(words, n).ravel()
    return shingles(flat, np.arange(count + 1) * n, SHINGLE)[0], None


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without those that hold a leaked item."""
    bad = matches(docs.select("doc_id", "text"), items, **kw).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of all ``documents`` against all of ``benchmark``: the leaked pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = None
