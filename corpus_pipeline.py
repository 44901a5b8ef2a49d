"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives the
columns of ``documents`` again; the last one gives token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from evenhand.llm.common import cut, drop, read
from evenhand.llm.queries import word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage scores reject go. Rows with null or empty texts stay, repeated rows fare alike; an empty table stays empty."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines stays; ``n_chars`` follows. Documents stay, also those left empty, null texts stay null."""
    left = line_dedup.dedup_lines(docs, whole=True)
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays; those without an id all do.

    Of rows with one id and one text one stays; rows with one id and different texts are one document, and all stay if it does.
    """
    kept = near_dedup.near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"))
    named = docs.join(kept, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; null and empty texts have no words and are not taken."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, in place of the text. Null and empty texts have none, repeated rows stay."""
    coded = bpe.encode_decode(docs, word_vocabulary())
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Fitted scores and merged ids are beyond SQL. Tests hold the operators against brute force or the library, and the stages against what their operators decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's table goes once its successor is written. An empty table gives no row."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
