"""Token counts through a digest cache.

A stored table holds (content digest, tokenizer version, n_tokens). Documents
are digested after normalisation, digests are made distinct before anything is
encoded, those that the cache holds for this version are joined, and only the
rest is encoded, once each, and appended. The version is a digest of the
tokenizer's file, so another vocabulary never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens, wordhash
from .memory import released
from .scratch import Scratch

STEP = 1 << 20
SCHEMA = "digest binary, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """A null text counts as empty; nothing else is changed, so equal digests mean equal counts with any tokenizer."""
    return F.coalesce(text, F.lit(""))


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _count(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.encoder(path).count
        for batch in batches:
            text = batch.column("text")
            _, offsets = wordhash.buffers(text)
            found: list[int] = []
            for a, b in wordhash.slices(offsets, STEP):
                found += count(text.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(found), pa.string()), pa.array(found, pa.int64())], names=["digest", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_bytes, n_tokens), a row for each row of docs.

    ``tokenizer``: path of a tokenizers .json file, used without added special
    tokens, truncation or padding. ``cache``: folder of the stored counts, made if it is
    missing; None: a new one in the shared folder. New counts are appended as
    one write. A null text counts as empty. Rows that repeat a doc_id, or have
    none, come out as they are. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = cache or scratch.path("cache")
    version = version_of(tokenizer)
    text = normalised(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    known = _stored(docs, cache)
    if known is not None:
        distinct = distinct.join(known.where(F.col("version") == version).select("digest"), "digest", "left_anti")
    distinct.mapInArrow(released(_count(tokenizer, version)), SCHEMA).write.mode("append").parquet(cache)
    # written, so that the join may split the partition of a digest that very many documents have
    stored = scratch.save(_stored(docs, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "stored")
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


def _stored(docs: DataFrame, cache: str) -> DataFrame | None:
    """The cache, or None where nothing was written yet."""
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(SCHEMA).parquet(cache)
