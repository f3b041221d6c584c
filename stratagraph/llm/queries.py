"""The registered queries of the operators, on the tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    out = contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matrices import token_matrices

    return token_matrices(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    out = token_counts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import RECALL, near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), recall=RECALL)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "report.n_lines", "report.n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(_table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), stored=None)
    return out.drop("ids").withColumn("length", F.col("length").cast("long")).withColumn("offset", F.col("offset").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_substrings": op2_substrings,
        "op3_decontamination": op3_decontamination,
        "op4_matrices": op4_matrices,
        "op5_token_counts": op5_token_counts,
        "op6_embeddings": op6_embeddings,
        "op7_lines": op7_lines,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
