"""Decisions as a stored table whose layout spares the shuffle by matched set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A set's records share these columns and the table's partition, so they share a bucket.
BUCKET = ["scaffold", "profile_id"]
PARTITION = ["model", "domain"]


def save(decisions: DataFrame, name: str, buckets: int = 200, mode: str = "overwrite") -> None:
    """A table in the warehouse: a folder a model and domain, and in it a file a bucket, sorted by set.

    A model's or domain's records are read without the others'. Rows are dealt by bucket before they are written, so that each
    bucket of a folder is one file and not one a task. ``mode`` may be ``append``: of a set's records the last by ``ord``
    counts, as everywhere.
    """
    dealt = decisions.repartition(buckets, *BUCKET)
    dealt.write.mode(mode).partitionBy(*PARTITION).bucketBy(buckets, *BUCKET).sortBy(*BUCKET).saveAsTable(name)


def load(spark: SparkSession, name: str) -> DataFrame:
    """The table; ``matched.last_wins(.., dealt=True)`` and what builds on it then need no shuffle by set.

    Joins of two such tables (a grid and a trace for replay) need none either, if the session allows keys beyond those of the
    buckets: ``spark.sql.requireAllClusterKeysForCoPartition`` false. Saved with the same number of buckets.
    """
    return spark.table(name)
