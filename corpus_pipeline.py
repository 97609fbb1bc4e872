"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import bpe, decontam, icws, substring, toxicity
from pixelweave.llm.arrowtext import named
from pixelweave.llm.shared import small_side, stored

#: Documents of this toxicity or more are left out.
TOXIC = 0.3


def _renamed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list[Column]]:
    """doc_id, text and all columns under names of their own; those names; and the columns as they were.

    So no column's name can clash with one that a stage makes.
    """
    own = tuple(f"c{k}" for k in range(len(docs.columns)))
    rows = docs.select("doc_id", "text", *(named(c).alias(k) for k, c in zip(own, docs.columns)))
    return rows, own, [F.col(k).alias(c) for k, c in zip(own, docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC, unchanged.

    Each row is judged by its own text, so equal texts stay or go together whatever
    their keys; a null or empty text has the score of the bias. Repeated rows and null
    keys stay as they are; an empty table stays empty. Keys are of any type, as the
    labels' are; columns of any name and type are carried.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, own, back = _renamed(docs)
    scored = toxicity.score(rows, toxicity.train(docs, labels), carry=own, out="score")
    return scored.filter(F.col("score") < TOXIC).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, unchanged: that of the least doc_id.

    Rows are told apart by doc_id and text, so a row goes only if its own class keeps
    another. Null comes after all keys; of rows of one key in a class the one of the
    least hash of the text stays. Rows that repeat both doc_id and text give one row,
    that of the least hash over all columns as JSON. Null and empty texts are one text,
    alike to no other. An empty table stays empty. Keys are of any type that has an
    order; columns of any name and type, maps too, are carried.
    """
    rows, own, back = _renamed(docs)
    found = stored(icws.row_classes(rows))
    late = small_side(stored(found.filter("rid != kept").select(F.col("rid").alias("late")).distinct()))
    kept = rows.select(icws.row_id().alias("rid"), F.struct(*own).alias("row")).join(late, F.col("rid") == F.col("late"), "left_anti")
    if not found.groupBy("rid").count().filter("count > 1").isEmpty():
        kept = kept.groupBy("rid").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))  # of rows that repeat key and text
    return kept.select("row.*").select(*back)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that are also in an earlier one; n_chars follows.

    Untouched texts stay as they are; of others the kept words are joined by one
    space. Every row stays, be its text empty by now. A null text becomes an empty
    one; a null doc_id is later than all others, and rows of one doc_id take nothing
    from each other. An empty table stays empty. Keys are of any type that has an order;
    columns of any name and type are carried.
    """
    rows, own, _ = _renamed(docs)
    kept = tuple(k for k, c in zip(own, docs.columns) if c not in ("text", "n_chars"))
    found = substring.substring_dedup(rows, with_text=True, carry=kept)
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(made.get(c, F.col(k)).alias(c) for k, c in zip(own, docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, unchanged.

    Each row is judged by its own text, whatever its key; null and empty texts stay.
    Keys are of any type; columns of any name and type are carried. An empty table
    stays empty.
    """
    rows, own, back = _renamed(docs)
    found = decontam.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=own)
    return found.filter("not contaminated").select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their number (columns of these names are replaced); the text is what they decode to.

    One row for each row; a null text stays null and has no ids, as an empty one.
    Columns of any other name and of any type are carried.
    """
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the trained model nor the weighted sampling; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
