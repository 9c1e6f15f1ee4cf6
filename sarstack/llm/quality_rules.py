"""Quality rules kept as a bitmask ledger (operator 6).

Every rule is evaluated once for each document. The ledger stores one failure
bit a rule beside the measurements; policies are versioned masks over those
bits, so a new policy or an ablation is bit arithmetic on the ledger and never
reads a text again.

Defined cases: a null or empty text has no words, measures zero everywhere and
fails ``few_words``. Rows are judged one by one, so repeated rows and null ids
come out as often as they went in. Columns other than the id and the text are
ignored by the ledger, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ready
from ._bytes import Block, Ids, blocks, owner, repeated, windows
from ._store import written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_WORD_HEAD = _HEAD.copy()
_WORD_HEAD[[0x20, *range(0x09, 0x0E)]] = False
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rule name and SQL condition of failure over the measurements; bit i is rule i.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "n_upper > n_lower"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(r for r, _ in RULES)}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = [r for r, _ in RULES]
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(block: Block) -> dict[str, np.ndarray]:
    """All measurements of each document of a block."""
    ids, first = block.word_ids(lower=False)
    code, _ = ids.codes()
    per = np.diff(first)
    w3, at = windows(code, first, 3)
    again, _ = repeated(w3, np.searchsorted(first, at, side="right") - 1)
    covered = np.zeros(len(code) + 3, bool)
    hit = at[again]
    for j in range(3):
        covered[hit + j] = True
    c = np.concatenate([[0], np.cumsum(covered)])
    ls, le, lf = block.lines()
    held = np.searchsorted(ids.starts, le) > np.searchsorted(ids.starts, ls)  # the line holds a word
    _, before = repeated(Ids(block.buf, ls, le).codes()[0], owner(lf))
    dup = np.concatenate([[0], np.cumsum(before & held)])
    return {
        "n_words": per,
        "word_chars": block.count(_WORD_HEAD),
        "n_symbols": block.count(SYMBOLS),
        "n_dup_lines": dup[lf[1:]] - dup[lf[:-1]],
        "n_repeat_words": c[first[1:]] - c[first[:-1]],
        "n_lines": np.diff(lf),
        "n_upper": block.count(_UPPER),
        "n_lower": block.count(_LOWER),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, every measurement and ``fail_bits``."""
    ready(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch):
                got = measure(block)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], names=["doc_id", *MEASURES])

    measured = src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = " | ".join(f"if({cond}, {1 << i}L, 0L)" for i, (_, cond) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(led: DataFrame, policy: str | tuple[str, ...], column: str = "kept") -> DataFrame:
    """Add ``column``: no rule of the policy failed."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and that only it drops.

    One pass of bitwise sums over the ledger; an empty ledger gives zeros.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    aggs = []
    for r in names:
        bit = F.lit(mask((r,)))
        aggs += [F.coalesce(F.sum((whole.bitwiseAND(bit) != 0).cast("long")), F.lit(0)).alias(f"f_{r}"), F.coalesce(F.sum((whole == bit).cast("long")), F.lit(0)).alias(f"o_{r}")]
    row = led.agg(F.coalesce(F.bit_or(whole), F.lit(0)).alias("seen_bits"), *aggs)
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"o_{r}").alias("only_this")) for r in names))
    return row.select(F.explode(pairs).alias("x"), "seen_bits").select("x.rule", "x.failed", "x.only_this", "seen_bits")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all ``documents`` in the shared folder, judged by policies base and v1."""
    led = written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger")
    out = apply_policy(apply_policy(led, "base", "base_ok"), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")


_WS = r"[^ \t\n\x0B\f\r]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WS}') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(ls) AS x FROM w) WHERE regexp_matches(x, '{_WS}') GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN r ON w.rid = r.rid LEFT JOIN l ON w.rid = l.rid),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
