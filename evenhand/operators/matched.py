"""Matched sets: last-wins records, one summary row a set, and pairs with the reference group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REFERENCE, SET


def last_wins(decisions: DataFrame, dealt: bool = False) -> DataFrame:
    """One record of each (set, group): the last by ``ord``, ties to the larger score, then action; nulls lose.

    Rows are dealt by set alone, so that whatever groups by set next needs no second shuffle. ``dealt`` says that they
    are, as those of a ``sources.table``: then there is none at all.
    """
    kept = F.max(F.struct("ord", "score", "action", "tool_request")).alias("r")
    one = (decisions if dealt else decisions.repartition(*SET)).groupBy(*SET, "group").agg(kept)
    return one.select(*SET, "group", "r.ord", "r.score", "r.action", "r.tool_request")


def set_summary(members: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """What all disparity metrics need of a set: it takes each record's two values down to a few numbers."""
    ref = F.col("group") == reference
    return members.groupBy(*SET).agg(
        F.count("action").alias("n_act"),
        (F.bool_or("action") != F.bool_and("action")).alias("flip"),
        F.count("score").alias("n_score"),
        (F.max("score") - F.min("score")).alias("spread"),
        F.bool_or(F.when(ref, F.col("action"))).alias("ref_action"),
        F.max(F.when(ref, F.col("score"))).alias("ref_score"),
    )


def reference_pairs(members: DataFrame, reference: str = REFERENCE) -> DataFrame:
    """Every other group's record beside its set's reference record; nulls where that is missing."""
    one = members.groupBy(*SET).agg(F.collect_list(F.struct("group", "action", "score", "tool_request")).alias("all"))  # a record a group at most
    ref = F.get(F.filter("all", lambda m: m["group"] == reference), F.lit(0))
    return one.select(*SET, ref.alias("ref"), F.explode("all").alias("m")).where(F.col("m.group") != reference).select(
        *SET, "m.group", "m.action", "m.score", F.col("ref.action").alias("ref_action"), F.col("ref.score").alias("ref_score")
    )
