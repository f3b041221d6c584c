"""The corpus pipeline: documents in, packed token sequences out.

Each stage calls one operator, takes what its predecessor kept, and returns the
columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import decontamination, lines, minhash, packing, toxicity
from stratagraph.llm.scratch import Scratch

#: Documents that score this or more are rejected.
TOXIC = 0.3
#: Documents whose Jaccard similarity over 5-word shingles is this or more (a fraction) are near copies.
SIMILAR = (80, 100)
#: Words that a worker keeps the ids of; workers live on through the other stages.
KEPT_WORDS = 150_000
#: Not expressible in SQL: fitted scores, tokenizer ids.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC``, unchanged.

    Null and empty texts have the score of no terms, so they stay unless most labelled texts are toxic; a score
    of ``TOXIC`` itself is rejected. Rows that repeat a doc_id, or have none, are scored by their own texts, whole
    however long. An empty table gives an empty one. Other columns pass through, whatever their names.
    """
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored_rows(docs, machine).where(F.col("score") < TOXIC).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, be it a single one; one that consists of such lines goes.

    Null, empty and blank texts have no lines and stay as they are. The first of equal lines stays, by doc_id and
    place; a null doc_id counts as the least. Rows that repeat a doc_id are one document, so equal ones keep the
    same lines (the next stage keeps one of them). n_chars, if there is such a column, follows a changed text. An
    empty table gives an empty one. Other columns pass through, whatever their names.
    """
    found = lines.deduped(docs, gram=1, window=1).where("report.n_lines = 0 or report.n_removed < report.n_lines")
    changed = F.col("report.n_removed") > 0
    made = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in made:
        made["n_chars"] = F.when(changed, F.char_length(made["text"])).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(v.alias(c) for c, v in made.items()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id, one without an id only if none has one.

    Null, empty and blank texts have no words, are near copies of nothing, and all stay. Pairs at ``SIMILAR`` itself
    are near copies. Where rows repeat a doc_id or have none, each row is a document of its own, so of equal rows
    one stays. Whole texts count, however long. An empty table gives an empty one. Other columns pass through, whatever their names.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        near = minhash.near_duplicates(docs, num=SIMILAR[0], den=SIMILAR[1])
        return docs.join(near.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*_columns(docs))
    place = "place"
    while place in docs.columns:
        place += "_"
    # written, so that a row's number is the same for all that read it
    rows = Scratch(spark, "row-numbers").save(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    near = minhash.near_duplicates(rows.select(F.col(place).alias("doc_id"), "text"), num=SIMILAR[0], den=SIMILAR[1])
    near = near.select(F.col("doc_id").alias(place), "component_id").join(rows.select(place, F.col("doc_id").alias("own_id")), place)
    first = F.struct(F.col("own_id").isNull().alias("unnamed"), "own_id", F.col(place).alias("kept_place"))
    kept = near.groupBy("component_id").agg(F.min(first)["kept_place"].alias(place)).select(place)
    return rows.join(kept, place, "left_semi").select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, unchanged.

    Null and empty texts hold none and stay. Items without words are not looked for; an empty benchmark rejects
    nothing. Rows that repeat a doc_id, or have none, are judged by their own texts, whole however long. An empty
    table gives an empty one. Other columns pass through, whatever their names.
    """
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select("row.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences, a row for each piece, with its ids.

    A document is its ids and the end id; null and empty texts are that id alone. Longer ones than a sequence are
    cut. Rows that repeat a doc_id, or have none, are documents of their own. An empty table gives an empty one.
    Other columns are left out.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), stored="<u2", words=KEPT_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
