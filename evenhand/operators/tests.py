"""Paired tests against the reference group, and control of the false-discovery rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..schema import CELL, LEVEL
from ..shared import beside
from ..workers import ship
from . import ordered

KEY = [*CELL, "group"]


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts b (reference only) and c (group only) and their exact p; no discordant pair gives p = 1."""
    ship(pairs.sparkSession)
    counts = pairs.groupBy(*KEY).agg(F.count_if(F.expr("ref_action and not action")).alias("b"), F.count_if(F.expr("not ref_action and action")).alias("c"))
    return counts.withColumn("discordant", F.col("b") + F.col("c")).withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c")))


def _ranked_sizes(pairs: DataFrame) -> DataFrame:
    """``average_ranks``, and a row without a size for the key's other pairs."""
    d = F.when(F.col("score") != F.col("ref_score"), F.col("score") - F.col("ref_score"))
    sizes = pairs.select(*KEY, d.alias("d")).groupBy(*KEY, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("d") > 0).alias("ups"))
    ranked = ordered.running_sum(ordered.ranges(sizes, KEY, ["size"]), KEY, ["size"], F.when(F.col("size").isNotNull(), F.col("m")).otherwise(0), "_before")
    return ranked.select(*KEY, "size", "m", "ups", F.when(F.col("size").isNotNull(), F.col("_before") + (F.col("m") + 1) / 2.0).cast("double").alias("avg_rank"))


def average_ranks(pairs: DataFrame) -> DataFrame:
    """Non-zero differences with the mean rank of their size: one row for each size, sign and key, ``m`` of it.

    Equal sizes are counted before anything is ranked, and the distinct ones are ranked by ranges: a key with any number of
    different scores spans many tasks.
    """
    return _ranked_sizes(pairs).where("size is not null")


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test by the normal approximation with tie and continuity corrections.

    No non-zero difference: p = 1 and no W; no variance: p = 1 and no z. A W equal to its mean is corrected upwards.
    """
    n, known = F.col("n").cast("double"), F.col("size").isNotNull()
    cubes = F.col("m").cast("double") * F.col("m") * F.col("m") - F.col("m")
    got = _ranked_sizes(pairs).groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(known, F.col("m"))), F.lit(0)).alias("n"), F.sum(F.col("ups") * F.col("avg_rank")).alias("w"), F.sum(F.when(known, cubes)).alias("tie")
    )
    var = (n * (n + 1) * (2 * n + 1) - F.col("tie") / 2) / 24
    off = F.col("w") - n * (n + 1) / 4
    z = F.when(var > 0, (off - F.when(off < 0, -0.5).otherwise(0.5)) / F.sqrt(F.when(var > 0, var)))
    got = got.withColumn("z", z)
    return got.select(*KEY, "n", "w", "z", F.when(F.col("z").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * (1 - stats.norm_cdf(F.abs("z"))))).alias("p"))


def _numbered(ps: DataFrame, family: list[str], tie: list[str]) -> DataFrame:
    """Known p-values with their place ``_r`` in the family's order, and its size ``_m``: one row a family is summed up beside them."""
    rows = ordered.ranges(ps.where("p is not null and not isnan(p)"), family, ["p", *tie])
    placed = ordered.running_sum(rows, family, ["p", *tie], F.lit(1), "_r").withColumn("_r", F.col("_r") + 1)
    return beside(placed, rows.groupBy(*family).agg(F.count(F.lit(1)).alias("_m")), family)


def benjamini_hochberg(ps: DataFrame, family: list[str], tie: list[str], level: float = LEVEL) -> DataFrame:
    """Step-up q-values within each family, of any size; null and NaN p-values fall away."""
    numbered = _numbered(ps, family, tie).withColumn("_step", F.least(F.lit(1.0), F.col("p") * F.col("_m") / F.col("_r")))
    stepped = ordered.least_behind(numbered, family, ["p", *tie], F.col("_step"), "q")
    return stepped.withColumn("reject", F.col("q") <= level).drop("_step", "_r", "_m", "_range")


def bh_elementwise(ps: DataFrame, family: list[str], tie: list[str], level: float = LEVEL) -> DataFrame:
    """How many sorted p-values are at most their own threshold: not the step-up rule, kept for comparison."""
    ranked = _numbered(ps, family, tie)
    return ranked.groupBy(*family).agg(F.count_if(F.col("p") <= F.col("_r") / F.col("_m") * level).alias("n_survive"), F.count(F.lit(1)).alias("n_tests"))
