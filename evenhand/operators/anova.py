"""Two-way layout of profiles and groups without replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import f_survival
from ..schema import GROUPS
from ..workers import ship


def complete(decisions: DataFrame, n_groups: int = len(GROUPS)) -> DataFrame:
    """(domain, scaffold, profile_id, scores): scores in order of group, of the profiles that have one in each.

    Of repeated records of a group the last by ``ord`` counts, where there is such a column, then the larger score.
    """
    key = ["domain", "scaffold", "profile_id"]
    order = F.col("ord") if "ord" in decisions.columns else F.lit(0)
    # dealt by profile, so that what follows needs no second shuffle
    last = decisions.repartition(*key).groupBy(*key, "group").agg(F.max(F.struct(order.alias("ord"), "score")).alias("r")).select(*key, "group", F.col("r.score").alias("score"))
    got = last.where("score is not null").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("group", "score"))).alias("m"))
    return got.where(F.size("m") == n_groups).select("domain", "scaffold", "profile_id", F.transform("m", lambda s: s["score"]).alias("scores"))


def two_way(wide: DataFrame, n_groups: int = len(GROUPS)) -> DataFrame:
    """F of the group effect from residuals, with its degrees of freedom; NaN where the error is zero."""
    cell = ["domain", "scaffold"]
    columns = [F.col("scores")[i] for i in range(n_groups)]
    means = wide.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("col"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    means = means.withColumn("grand", total(F.col("col")) / n_groups)
    # a row a cell: always small enough to send to every task
    rest = F.zip_with("scores", "col", lambda x, m: F.pow(x - F.col("row") - m + F.col("grand"), F.lit(2.0)))
    errors = wide.withColumn("row", total(F.col("scores")) / n_groups).join(F.broadcast(means), cell).groupBy(*cell).agg(F.sum(total(rest)).alias("ss_error"))
    group = F.col("n") * total(F.transform("col", lambda m: F.pow(m - F.col("grand"), F.lit(2.0))))
    out = means.join(errors, cell).withColumn("ss_group", group).withColumn("df_group", F.lit(n_groups - 1)).withColumn("df_error", (F.col("n") - 1) * (n_groups - 1))
    fine = (F.col("ss_error") > 1e-9) & (F.col("df_error") > 0)
    f = F.when(fine, (F.col("ss_group") / F.col("df_group")) / (F.col("ss_error") / F.when(fine, F.col("df_error")))).otherwise(F.lit(float("nan")))
    return out.withColumn("f_group", f).select(*cell, F.col("n").alias("n_profiles"), "ss_group", "ss_error", "df_group", "df_error", "f_group")


def _scores(decisions: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(domain, scaffold, profile_id, scores): the last known score of each group in the given order, null where there is none."""
    key = ["domain", "scaffold", "profile_id"]
    order = F.col("ord") if "ord" in decisions.columns else F.lit(0)
    known = decisions.where("score is not null")
    last = [F.max(F.when(F.col("group") == g, F.struct(order.alias("ord"), "score")))["score"].alias(f"_{i}") for i, g in enumerate(groups)]
    return known.groupBy(*key).agg(*last).select(*key, F.array(*[f"_{i}" for i in range(len(groups))]).alias("scores"))


def incomplete(decisions: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(domain, scaffold, profile_id, n_known, missing): profiles that ``complete`` leaves out, with the groups they have no score in.

    A profile is any that has a record, with or without a score.
    """
    key = ["domain", "scaffold", "profile_id"]
    known = decisions.groupBy(*key).agg(F.collect_set(F.when(F.col("score").isNotNull(), F.col("group"))).alias("known"))  # a name a group
    missing = F.array_except(F.array(*map(F.lit, groups)), "known")
    return known.select(*key, (len(groups) - F.size(missing)).cast("long").alias("n_known"), missing.alias("missing")).where(F.size("missing") > 0)


def unbalanced(decisions: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """F of the group effect over all profiles, complete or not: ``two_way``'s columns, and ``n_scores``.

    Least squares of score = profile + group. Profiles are swept out: each adds its part to a small system of equations for
    the groups, so what is gathered is a matrix of groups a cell, and the sums of squares follow from its solution. Profiles
    with one score add nothing. On complete profiles this is ``two_way``. NaN where the error is zero or has no degree of freedom.
    """
    cell, n = ["domain", "scaffold"], len(groups)
    have = lambda i: F.col("scores")[i].isNotNull().cast("double")
    y = lambda i: F.coalesce(F.col("scores")[i], F.lit(0.0))
    total = lambda f: sum((f(i) for i in range(1, n)), f(0))
    rows = _scores(decisions, groups).withColumn("k", total(have)).withColumn("mean", total(y) / F.col("k"))
    rows = rows.where("k > 1")
    sums = {f"c{i}_{j}": F.sum(have(i) * have(j) / F.col("k")) for i in range(n) for j in range(i, n)}
    sums |= {f"n{i}": F.sum(have(i)) for i in range(n)} | {f"q{i}": F.sum(have(i) * (y(i) - F.col("mean"))) for i in range(n)}
    sums["within"] = F.sum(total(lambda i: have(i) * F.pow(y(i) - F.col("mean"), F.lit(2.0))))
    sums |= {"n_profiles": F.count(F.lit(1)), "n_scores": F.sum("k").cast("long")}
    parts = rows.groupBy(*cell).agg(*[c.alias(name) for name, c in sums.items()])
    ship(decisions.sparkSession)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                c = np.array([[-r[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + np.diag([r[f"n{i}"] for i in range(n)])
                q = np.array([r[f"q{i}"] for i in range(n)])
                rank = int(np.linalg.matrix_rank(c, tol=1e-9 * max(1.0, np.abs(c).max())))
                group = float(q @ np.linalg.lstsq(c, q, rcond=1e-9)[0])
                error, df = r["within"] - group, r["n_scores"] - r["n_profiles"] - rank
                fine = error > 1e-9 and df > 0 and rank > 0
                out.append((r["domain"], r["scaffold"], r["n_profiles"], r["n_scores"], group, error, rank, df, group / rank / (error / df) if fine else float("nan")))
            yield pd.DataFrame(out, columns=[*cell, "n_profiles", "n_scores", "ss_group", "ss_error", "df_group", "df_error", "f_group"])

    schema = "domain string, scaffold string, n_profiles long, n_scores long, ss_group double, ss_error double, df_group int, df_error long, f_group double"
    return parts.mapInPandas(solve, schema).withColumn("f_group", F.coalesce("f_group", F.lit(float("nan"))))  # Arrow hands a missing figure on as null


def with_p(table: DataFrame) -> DataFrame:
    ship(table.sparkSession)
    return table.withColumn("p_group", f_survival(F.col("f_group"), F.col("df_group").cast("double"), F.col("df_error").cast("double")))


def observed(wide: DataFrame) -> DataFrame:
    return wide.groupBy("domain", "scaffold").agg(F.avg(F.array_max("scores") - F.array_min("scores")).alias("obs"), F.count(F.lit(1)).alias("n_profiles"))
