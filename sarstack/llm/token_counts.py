"""Token counts through a digest cache (operator 10).

A count depends on the text's content and the tokenizer's file alone. Counts
are stored under both digests: texts are joined to the cache by digest, only
distinct contents that it lacks are encoded, and those are appended.

The content digest is the SHA-256 of the UTF-8 bytes; the normalised content
is the text itself with null as empty, since any stronger folding could change
what a tokenizer yields. One row of each distinct missing digest is encoded: the
one of the least id. Texts are dealt out by digest and id, so that thousands of
copies of one text neither meet in one task with their texts nor are encoded
twice. Where counts go back to the rows, the few digests with a thousandth of
all rows or more are sent to them; others are joined.

The query op10 counts with a cache of its own that starts empty, so that its
figures are those of encoding everything; ``count_tokens`` takes any cache, and
what it holds already is not encoded again.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Repeated rows
and null ids are returned as they came. A cache that does not exist is empty.
Extra columns of ``docs`` are ignored by the counts table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import counter, version
from ._store import fresh_dir, join_hot, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    return table.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; misses are appended to ``cache``."""
    spark = docs.sparkSession
    ver = version(tokenizer)
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(src.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    wanted = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("x"), F.count("*").alias("n_rows"))
    wanted = written(wanted.select("digest", F.col("x.doc_id").alias("doc_id"), "n_rows"), "wanted")
    known = read_cache(spark, cache, ver)
    missing = wanted.join(known, "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = counter(tokenizer), set()  # rows of one id and content meet in one task
        for batch in batches:
            digests, texts = batch.column("digest"), batch.column("text")
            for i in range(0, batch.num_rows, 256):
                part = {d: t for d, t in zip(digests.slice(i, 256).to_pylist(), texts.slice(i, 256).to_pylist(), strict=True) if d not in done}
                done.update(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(enc.count(list(part.values())), pa.int64())], names=["digest", "n_tokens"])

    one = src.join(missing.hint("merge"), (src.digest == missing.digest) & src.doc_id.eqNullSafe(missing.doc_id), "left_semi")
    new = one.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")
    new.select(F.lit(ver).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = wanted.select("digest", "n_rows").join(read_cache(spark, cache, ver), "digest")
    return join_hot(rows, written(counts, "counts"), ["digest"], "n_rows").select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Counts of all ``documents``, with a cache of this call's own that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = count_tokens(docs, tokenizer, fresh_dir(spark, "token-counts"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


ORACLE_SQL = None
