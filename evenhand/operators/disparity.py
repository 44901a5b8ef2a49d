"""Disparity metrics over matched sets and over all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CELL, REFERENCE
from . import tests


def flip_rate(summary: DataFrame) -> DataFrame:
    """CFR: of the sets with two known actions or more, the share in which they differ; null without such sets."""
    fine = F.col("n_act") >= 2
    return summary.groupBy(*CELL).agg(F.avg(F.when(fine, F.col("flip").cast("double"))).alias("cfr"), F.count(F.when(fine, 1)).alias("n_sets"))


def score_spread(summary: DataFrame) -> DataFrame:
    """MASD: mean of largest less smallest score over the sets with two known scores or more."""
    fine = F.col("n_score") >= 2
    return summary.groupBy(*CELL).agg(F.avg(F.when(fine, F.col("spread"))).alias("masd"), F.count(F.when(fine, 1)).alias("n_sets"))


def pairwise_flip(pairs: DataFrame) -> DataFrame:
    return pairs.where("action is not null and ref_action is not null").groupBy(*CELL, "group").agg(F.avg((F.col("action") != F.col("ref_action")).cast("double")).alias("flip_rate"), F.count(F.lit(1)).alias("n_pairs"))


def pairwise_difference(pairs: DataFrame) -> DataFrame:
    return pairs.where("score is not null and ref_score is not null").groupBy(*CELL, "group").agg(F.avg(F.abs(F.col("score") - F.col("ref_score"))).alias("mean_abs_diff"), F.count(F.lit(1)).alias("n_pairs"))


def rates(decisions: DataFrame, value: str = "action", name: str = "rate") -> DataFrame:
    """Share of true values by group, over every record: repeated ones count."""
    return decisions.where(F.col(value).isNotNull()).groupBy(*CELL, "group").agg(F.avg(F.col(value).cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def disparity(by_group: DataFrame, rate: str = "rate") -> DataFrame:
    return by_group.groupBy(*CELL).agg((F.max(rate) - F.min(rate)).alias("disparity"), F.count(F.lit(1)).alias("n_groups"))


def gaps(by_group: DataFrame, sign: int, rate: str = "rate", reference: str = REFERENCE) -> DataFrame:
    """``sign`` 1: reference less group, as for actions; -1: group less reference, as for tool use. None without a reference."""
    ref = by_group.where(F.col("group") == reference).select(*[F.col(c).alias(f"_{c}") for c in CELL], F.col(rate).alias("_ref"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL]
    return by_group.where(F.col("group") != reference).join(ref, on).select(*CELL, "group", (sign * (F.col("_ref") - F.col(rate))).alias("gap"))


def validity(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_records"), F.count("action").alias("n_action"), F.count("score").alias("n_score"), F.count("tool_request").alias("n_tool"))


def details(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row a (cell, group) beside the reference: the figures behind both tests, pairwise metrics, and gaps of both rates."""
    key = [*CELL, "group"]
    rows = tests.mcnemar(pairs).select(*key, "b", "c").join(tests.wilcoxon(pairs).select(*key, F.col("n").alias("n_nonzero"), "w", "z"), key)
    for more in (pairwise_flip(pairs).drop("n_pairs"), pairwise_difference(pairs).drop("n_pairs"), gaps(rates(decisions), 1).withColumnRenamed("gap", "action_gap"), gaps(rates(decisions, "tool_request"), -1).withColumnRenamed("gap", "tool_gap")):
        rows = rows.join(more, key, "left")
    return rows
