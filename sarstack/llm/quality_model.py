"""Quality classifier: histogram gradient-boosted trees (operator 2).

Statistics of a text (never its label, language, source or id) feed boosted
trees over quantile bins. The trees are flattened into arrays of complete
binary trees, so scoring a batch is numpy indexing, level by level.

The trees are fitted on at most ``train_rows`` labelled rows (a documented
bound, 20,000), the first by a hash of the id, so the same rows each time;
scoring covers every row. Only that bounded sample's statistics reach the
driver, and only the flat arrays go out.

Defined cases: null and empty texts have all statistics zero and are scored
like others. Null labels are not learnt. Without labels of both kinds every
score is the share of label 1, or 0.5 without labels. Repeated rows are scored
one by one; of the texts of one labelled id the least is learnt, and the lesser
of two labels. Extra columns pass through ``classify``, except ``score``,
``predicted`` and names that begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..workers import ready
from ._bytes import Block, blocks, distinct
from ._store import col
from .quality_rules import measure

TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeat_words", "adjacent_words", "dup_lines", "symbols", "capitals",
    "digits", "marks", "bars", "line_length", "non_ascii", "stops", "quotes",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_DIGITS, _MARKS, _BARS, _STOPS, _QUOTES = _table(b"0123456789"), _table(b"!?;:"), _table(b"|"), _table(b".,"), _table(b"\"'()[]{}=")
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True


def statistics(block: Block) -> np.ndarray:
    """One row of FEATURES for each document of a block."""
    m = measure(block)
    words, first = block.word_hashes()
    _, own = distinct(words, first)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[2:] = np.cumsum(words[1:] == words[:-1])
    n = np.maximum(m["n_words"], 1).astype(float)
    size = np.maximum(block.lens, 1).astype(float)
    # words equal to the one before, not counting each document's first
    adjacent = same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]
    letters = np.maximum(m["n_upper"] + m["n_lower"], 1)
    cols = [
        np.log1p(m["n_words"]), m["word_chars"] / n, np.diff(own) / n, m["n_repeat_words"] / n, adjacent / n, m["n_dup_lines"] / m["n_lines"],
        m["n_symbols"] / n, m["n_upper"] / letters, block.count(_DIGITS) / size, block.count(_MARKS) / n, block.count(_BARS) / n, m["n_words"] / m["n_lines"],
        block.count(_HIGH) / size, block.count(_STOPS) / n, block.count(_QUOTES) / n,
    ]
    return np.stack(cols, axis=1)


@dataclass
class Trees:
    """``depth`` levels of splits and 2**depth leaves for each tree, flattened."""

    prior: float
    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss over per-feature quantile bins."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(prior, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin <= k: value <= edge k
    n_feat = x.shape[1]
    flat = binned + np.arange(n_feat) * bins
    raw = np.full(len(y), prior)
    features, cuts, leaves = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for d in range(depth):
            base = (1 << d) - 1
            for node in range(base, 2 * base + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                k = flat[rows].ravel()
                gs = np.bincount(k, np.repeat(g[rows], n_feat), n_feat * bins).reshape(n_feat, bins).cumsum(1)
                hs = np.bincount(k, np.repeat(h[rows], n_feat), n_feat * bins).reshape(n_feat, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, -1] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-9 and b < len(edges[j]):
                    f[node], c[node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        leaf_of = at - inner
        gl, hl = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        value = -rate * gl / (hl + l2)
        raw += value[leaf_of]
        features.append(f)
        cuts.append(c)
        leaves.append(value)
    return Trees(prior, depth, np.array(features), np.array(cuts), np.array(leaves))


def _features(texts: DataFrame) -> DataFrame:
    """FEATURES as an array beside each row's ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch):
                x = statistics(block)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), lists], names=["y", "x"])

    return texts.select("y", "text").mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label_col: str = "quality") -> Trees:
    """Trees from at most ``train_rows`` rows of ``labels`` (doc_id and label), held-out rows already gone."""
    ready(docs.sparkSession)
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # train_rows rows of two numbers
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = sorted((r.y, tuple(r.x)) for r in _features(texts).collect())  # train_rows at most
    y = np.array([r[0] for r in rows], float)
    return fit(np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES)), y)


def classify(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted") and not c.startswith("__")]
    src = docs.select(*map(col, keep), F.col("text").cast("string")).toDF(*(plain := [f"c{i}" for i in range(len(keep))]), "__text")
    schema = StructType([*src.schema.fields[:-1], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch, "__text"):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(trees.score(statistics(block)))], names=[*plain, "score"])

    return src.mapInArrow(run, schema).toDF(*keep, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Trees:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return train(docs, labels)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fitted(spark, docs, sf_dir)
    scored = classify(docs.select("doc_id", "text", held_out().alias("held_out")), trees)
    return scored.select("doc_id", "held_out", "score", "predicted")


ORACLE_SQL = None
