"""Replay of traces over the expected grid, test-retest reliability, cost and leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["domain", "scaffold", "profile_id", "group"]

# List prices in USD for a million tokens (in, out), tokens of a decision (in, out), score ranges.
PRICES = [("claude-haiku-4-5", 1.0, 5.0), ("claude-sonnet-4-6", 3.0, 15.0), ("claude-opus-4-8", 5.0, 25.0), ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6)]
TOKENS = [("C0", 350, 60), ("C2", 350, 300), ("C3", 400, 700)]
OTHER_PRICE, OTHER_TOKENS = (3.0, 15.0), (400, 300)
SCORE_RANGE = [("hiring", 100.0), ("lending", 4.0), ("triage", 4.0)]


def union_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both runs; ``source_ord`` says which, so that the later one wins."""
    return first.withColumn("source_ord", F.lit(0)).unionByName(second.withColumn("source_ord", F.lit(1)))


def latest(rows: DataFrame, key: list[str] = KEY, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    values = [c for c in rows.columns if c not in {*key, *order}]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *values)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in (*order, *values)])


def replay(grid: DataFrame, raw: DataFrame) -> DataFrame:
    """Every cell of the grid, with its decision or nulls; the name is the grid's, decisions outside the grid are ignored."""
    return grid.join(latest(raw.select(*KEY, "ord", "score", "action")), KEY, "left")


def missing(grid: DataFrame, raw: DataFrame) -> DataFrame:
    return grid.join(raw.select(*KEY), KEY, "left_anti")


def retest(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Agreement over all pairs, unknown actions included in the count, and mean absolute difference of known scores.

    Of a cell's records on either side the last by ``ord`` counts, where there is such a column.
    """
    last = lambda d: latest(d.select(*KEY, F.col("ord") if "ord" in d.columns else F.lit(0).alias("ord"), "score", "action"))
    both = last(first).join(last(second).select(*KEY, F.col("action").alias("action2"), F.col("score").alias("score2")), KEY)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (F.count_if(F.col("action") == F.col("action2")) / F.count(F.lit(1))).alias("agreement"),
        F.avg(F.abs(F.col("score") - F.col("score2"))).alias("mae"),
    )


def cost(plan: DataFrame) -> DataFrame:
    """(model, scaffold, n_calls) -> calls, tokens and USD of each model; unknown models and scaffolds have default prices and tokens."""
    spark = plan.sparkSession
    prices = F.broadcast(spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))
    sizes = F.broadcast(spark.createDataFrame(TOKENS, "scaffold string, t_in long, t_out long"))
    out = plan.join(prices, "model", "left").join(sizes, "scaffold", "left").na.fill({"price_in": OTHER_PRICE[0], "price_out": OTHER_PRICE[1], "t_in": OTHER_TOKENS[0], "t_out": OTHER_TOKENS[1]})
    sums = out.groupBy("model", "price_in", "price_out").agg(F.sum("n_calls").alias("n_calls"), F.sum(F.col("n_calls") * F.col("t_in")).alias("est_input_tokens"), F.sum(F.col("n_calls") * F.col("t_out")).alias("est_output_tokens"))
    usd = F.col("est_input_tokens") / 1e6 * F.col("price_in") + F.col("est_output_tokens") / 1e6 * F.col("price_out")
    return sums.select("model", "n_calls", "est_input_tokens", "est_output_tokens", F.round(usd, 4).alias("est_usd"))


def leaderboard(cells: DataFrame) -> DataFrame:
    """(model, domain, scaffold, cfr, masd, disparity) -> models by composite score, null last; incomplete cells are left out of it."""
    ranges = F.broadcast(cells.sparkSession.createDataFrame(SCORE_RANGE, "domain string, score_range double"))
    part = 1 - (F.col("cfr") + F.when(F.col("masd").isNotNull(), F.least(F.lit(1.0), F.col("masd") / F.coalesce("score_range", F.lit(100.0)))) + F.col("disparity")) / 3
    mean = lambda c: F.round(F.avg(c), 4)
    rows = cells.join(ranges, "domain", "left").groupBy("model").agg(mean(part).alias("composite_score"), mean("cfr").alias("mean_cfr"), mean("masd").alias("mean_masd"), mean("disparity").alias("mean_rate_disparity"), F.count(F.lit(1)).alias("n_cells"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("composite_score"), "model")))  # a row a model


def ladder(cells: DataFrame) -> DataFrame:
    """Mean spread by scaffold over the domains; cells without one are left out."""
    return cells.groupBy("scaffold", "model").agg(F.avg("masd").alias("mean_masd"), F.count("masd").alias("n_cells"))
