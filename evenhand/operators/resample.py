"""Resampling: bootstrap intervals of any statistic of summed columns, and the arity-matched null.

Sets of a large cell with equal values are counted, as none is told from another. What a cell then has is dealt into blocks of
bounded size. For each replicate a binomial tree splits the cell's draws among its blocks, so a block draws from its own sets
alone, and its sums are added to those of the others in the shuffle. The null
draws from a table of the residuals' distribution, in as many tasks as its draws need.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..schema import CELL, GROUPS, REFERENCE, SEED
from ..shared import beside, settled
from ..workers import ship
from . import ordered

#: Numbers drawn at a time.
CHUNK = 4_000_000
#: Different sets that are drawn from in one task; a cell of no more sets than that is one block and has the draws of ``interval``.
BLOCK = 4096
#: Equal sets of which it is worked out at once how many are drawn.
EQUAL = 1024
#: Entries of a table of residuals. Cells of more residuals have a range of equal count in each.
TABLE = 1 << 16
#: Numbers that a task of the null draws.
TASK = 250_000_000
#: Ranges by which the spreads of a large cell's rows are counted, beside those of the tails.
BINS = 256

#: Summed columns by name -> a figure; null where it is not defined.
Statistic = Callable[[dict[str, Column]], Column]


def _draws(values: np.ndarray, n_boot: int, seed: int, mode: str) -> np.ndarray:
    """Means of the replicates. ``distinct``: over the sets drawn at least once; ``multiset``: as often as drawn."""
    n, known = len(values), ~np.isnan(values)
    filled = np.where(known, values, 0.0)
    rng, out = np.random.default_rng(seed), []
    step = max(1, CHUNK // max(1, n))
    for at in range(0, n_boot, step):
        rows = min(step, n_boot - at)
        times = np.zeros((rows, n))
        np.add.at(times, (np.arange(rows)[:, None], rng.integers(0, n, (rows, n))), 1)
        times = (times > 0 if mode == "distinct" else times) * known
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append((times @ filled) / times.sum(1))
    means = np.concatenate(out)
    return means[~np.isnan(means)]


def interval(values: np.ndarray, n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", level: float = 0.95, bca: bool = True) -> dict:
    """Point, bounds and method of a mean; BCa unless all replicates lie on one side of the point."""
    known = values[~np.isnan(values)]
    none = {"point": None, "lo": None, "hi": None, "method": "percentile", "z0": None, "a": None}
    if not len(known):
        return none
    point, boot = float(known.mean()), _draws(values, n_boot, seed, mode)
    if not len(boot):
        return none | {"point": point}
    lo, hi = (1 - level) / 2, (1 + level) / 2
    share = float((boot < point).mean())
    if not bca or not 0 < share < 1:
        return none | {"point": point, "lo": float(np.quantile(boot, lo)), "hi": float(np.quantile(boot, hi)), "method": "percentile-fallback" if bca else "percentile"}
    normal = NormalDist()
    z0 = normal.inv_cdf(share)
    left = (known.sum() - known) / (len(known) - 1) if len(known) > 1 else known
    left = np.r_[left, np.full(len(values) - len(known), point)]  # to leave out a set that has no value changes nothing
    d = left.mean() - left
    below = 6 * (d**2).sum() ** 1.5
    a = float((d**3).sum() / below) if below else 0.0
    at = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(lo), normal.inv_cdf(hi))]
    return {"point": point, "lo": float(np.quantile(boot, at[0])), "hi": float(np.quantile(boot, at[1])), "method": "BCa", "z0": z0, "a": a}


def _counts(rng: np.random.Generator, draws: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` sets is drawn in each replicate, if replicate i draws ``draws[i]`` times."""
    replicate = np.repeat(np.arange(len(draws)), draws)
    return np.bincount(replicate * n + rng.integers(0, n, len(replicate)), minlength=len(draws) * n).reshape(len(draws), n)


def _block_draws(n_boot: int, path: list[tuple[int, int]], seed: list[int], block: int, levels: int) -> np.ndarray:
    """Draws that fall into a block: at each node on the way to it a binomial share of those above.

    ``path`` has the sizes (of the node, of its first half) from the cell down. Blocks of a cell make the same draws at the
    nodes that they share, so their counts add up to the cell's sets in every replicate.
    """
    draws = np.full(n_boot, path[0][0], np.int64)
    for level, (size, first) in enumerate(path[:levels]):
        node = block >> (levels - level)
        left = np.random.default_rng([*seed, level, node]).binomial(draws, first / size if size else 0.0)
        draws = draws - left if block >> (levels - level - 1) & 1 else left
    return draws


def _reached(rng: np.random.Generator, draws: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` equal sets are drawn at least once by so many draws, for each number of ``draws``.

    After one more draw there are d of them if there were d before and it hit one of these, or d - 1 and it did not. So
    the distribution follows draw by draw, and each number is read off it by a uniform one.
    """
    flat = draws.ravel()
    order = np.argsort(flat, kind="stable")
    many, at = np.unique(flat[order], return_index=True)
    found, again = np.empty(len(flat), np.int64), np.arange(n + 1) / n
    share = np.r_[1.0, np.zeros(n)]
    done = 0
    for k, start, end in zip(many, at, [*at[1:], len(flat)], strict=True):
        for _ in range(k - done):
            share = share * again + np.r_[0.0, (share * (1 - again))[:-1]]
        done, upto = k, np.cumsum(share)
        found[order[start:end]] = np.searchsorted(upto, rng.random(end - start) * upto[-1], side="right")
    return np.minimum(found, n).reshape(draws.shape)


def _distinct(rng: np.random.Generator, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``times`` each class of ``sizes`` equal sets is drawn -> how many of its sets are; large classes in parts of EQUAL sets."""
    out = np.zeros(times.shape, np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        rest, parts = times[:, own], []
        for left in range(int(size), 0, -EQUAL):
            part = rest if left <= EQUAL else rng.binomial(rest, EQUAL / left)
            rest = rest - part
            if left > EQUAL:
                parts.append(part)
            if parts and (left <= 2 * EQUAL or len(parts) * part.size >= CHUNK):
                out[:, own] += _reached(rng, np.array(parts), EQUAL).sum(0)
                parts = []
        out[:, own] += _reached(rng, part, left) if left > 1 else part > 0
    return out


def counted(values: DataFrame, columns: list[str], by: list[str] = CELL, block: int = BLOCK) -> DataFrame:
    """(``by``, profile_id, columns) -> (``by``, large, profile_id, columns, n_equal), settled: what draws and sums are taken from.

    A cell of up to ``block`` sets keeps them with their profiles; a larger one has a row for each of its different values, with
    the number of sets that have them. So where values repeat, the work behind doesn't grow with the sets.
    """
    values = values.select(*by, "profile_id", *columns)
    sizes = settled(values.groupBy(*by).agg((F.count(F.lit(1)) > block).alias("large")))
    own = F.when(~F.col("large"), F.col("profile_id")).alias("profile_id")
    return settled(beside(values, sizes, by).groupBy(*by, "large", own, *columns).agg(F.count(F.lit(1)).alias("n_equal")))


def replicates(values: DataFrame, columns: list[str], n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", by: list[str] = CELL, block: int = BLOCK) -> DataFrame:
    """(``by``, profile_id, columns) -> (``by``, replicate, columns): sums over the sets that each replicate draws.

    As many sets are drawn as ``by`` has, with replacement; ``distinct`` counts a drawn set once, ``multiset`` as often as it
    is drawn. A cell of up to ``block`` sets draws them in order of profile as ``interval`` does. A larger one draws from its
    different values, each as likely as it has sets; these are dealt by a hash into blocks of about half that. Which rows
    share a partition changes nothing but the order in which blocks are added.
    """
    return _replicates(counted(values, columns, by, block), columns, n_boot, seed, mode, by, block)


def _replicates(sets: DataFrame, columns: list[str], n_boot: int, seed: int, mode: str, by: list[str], block: int) -> DataFrame:
    ship(sets.sparkSession)
    levels = F.when(F.count(F.lit(1)) <= block, 0).otherwise(F.ceil(F.log2(F.count(F.lit(1)) / block)) + 1).cast("int")
    rows = beside(sets, sets.groupBy(*by).agg(levels.alias("levels")), by)
    at = F.when(F.col("levels") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(_hash, 64 - levels)"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *columns)).withColumn("block", at.cast("long")).drop("_hash")

    # sizes of the tree's nodes: a row a block and level, each a sum over a few numbers
    steps = rows.groupBy(*by, "levels", "block").agg(F.sum("n_equal").alias("n")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels"))))
    steps = steps.withColumn("node", F.expr("shiftright(block, levels - level)"))
    left = F.expr("level < levels and (shiftright(block, levels - level - 1) & 1) = 0")
    nodes = steps.groupBy(*by, "level", "node").agg(F.sum("n").alias("whole"), F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("half"))
    paths = beside(steps, nodes, [*by, "level", "node"]).groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("level", "whole", "half"))).alias("path"))
    rows = beside(rows, paths.withColumn("path", F.transform("path", lambda x: F.array(x["whole"], x["half"]))), [*by, "block"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        large, levels, at = bool(frame.large.iloc[0]), int(frame.levels.iloc[0]), int(frame.block.iloc[0])
        frame = frame.sort_values(columns if large else "profile_id")
        x, sizes = np.nan_to_num(frame[columns].to_numpy(float, na_value=np.nan)), frame.n_equal.to_numpy(np.int64)
        key = [seed, *"|".join(str(frame[c].iloc[0]) for c in by).encode()] if large else [seed]
        draws = _block_draws(n_boot, [tuple(map(int, p)) for p in frame.path.iloc[0]], key, at, levels)
        rng = np.random.default_rng([*key, levels, at] if large else seed)
        each = sizes.sum() <= 2 * len(sizes)  # few are equal: sets are drawn one by one
        if each:
            x, sizes = np.repeat(x, sizes, 0), np.ones(sizes.sum(), np.int64)
        sums, step = np.empty((n_boot, len(columns))), max(1, CHUNK // max(1, len(x)))
        for i in range(0, n_boot, step):
            if each:
                times = _counts(rng, draws[i : i + step], len(x))
                times = times > 0 if mode == "distinct" else times
            else:
                times = rng.multinomial(draws[i : i + step], sizes / sizes.sum())
                times = _distinct(rng, times, sizes) if mode == "distinct" else times
            sums[i : i + step] = times @ x
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * n_boot for c in by}, "replicate": np.arange(n_boot), **dict(zip(columns, sums.T, strict=True))})

    kept = [sets.schema[c] for c in by]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "replicate int", *[f"`{c}` double" for c in columns]])
    sums = rows.groupBy(*by, "block").applyInPandas(run, schema)
    return sums.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in columns])


def _quantile(ordered_values: Column, share: Column) -> Column:
    """Of sorted values, by linear interpolation."""
    at = share * (F.size(ordered_values) - 1)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered_values, low), F.get(ordered_values, F.least(low + 1, F.size(ordered_values) - 1))
    return below + (above - below) * (at - low)


def intervals(
    values: DataFrame, columns: list[str], statistics: dict[str, Statistic], n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", by: list[str] = CELL, level: float = 0.95, bca: bool = True, block: int = BLOCK
) -> DataFrame:
    """(``by``, profile_id, columns) -> (``by``, statistic, point, lo, hi, method, z0, a, n_boot), a row a cell and statistic.

    A statistic is an expression of the columns' sums, such as a ratio, a difference of ratios or an effect size. All of them
    share a cell's draws. BCa, unless all replicates lie on one side of the point; replicates without the figure fall
    away. The jackknife leaves out one set at a time, in one pass over the counted sets: its moments are sums of powers.
    """
    return _intervals(_counted_sums(values, columns, by, block), columns, statistics, n_boot, seed, mode, by, level, bca, block)


def _counted_sums(values: DataFrame, columns: list[str], by: list[str], block: int) -> DataFrame:
    return counted(values.select(*by, "profile_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns, by, block)


def _intervals(sets: DataFrame, columns: list[str], statistics: dict[str, Statistic], n_boot: int, seed: int, mode: str, by: list[str], level: float, bca: bool, block: int) -> DataFrame:
    names = list(statistics)
    totals = sets.groupBy(*by).agg(*[F.sum(F.col(c) * F.col("n_equal")).alias(f"_{c}") for c in columns])
    points = totals.withColumns({f"_point{i}": f({c: F.col(f"_{c}") for c in columns}) for i, f in enumerate(statistics.values())})

    of_cell = [f"_point{i}" for i in range(len(names))]
    left_out = beside(sets, points.select(*by, *[f"_{c}" for c in columns], *of_cell), by)
    moments = []
    for i, f in enumerate(statistics.values()):
        d = f({c: F.col(f"_{c}") - F.col(c) for c in columns}) - F.col(f"_point{i}")
        left_out = left_out.withColumn(f"_d{i}", d)
        many = F.when(F.col(f"_d{i}").isNotNull(), F.col("n_equal"))
        moments += [F.coalesce(F.sum(many), F.lit(0)).alias(f"_s0{i}"), *[F.sum(many * F.pow(F.col(f"_d{i}"), F.lit(float(p)))).alias(f"_s{p}{i}") for p in (1, 2, 3)]]
    each = beside(left_out.groupBy(*by).agg(*moments), points.select(*by, *of_cell), by)
    fields = lambda i: F.struct(F.lit(names[i]).alias("statistic"), *[F.col(f"_{x}{i}").alias(x) for x in ("point", "s0", "s1", "s2", "s3")])
    jack = each.select(*by, F.explode(F.array(*[fields(i) for i in range(len(names))])).alias("j")).select(*by, "j.*")

    drawn = _replicates(sets, columns, n_boot, seed, mode, by, block)
    found = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), f({c: F.col(c) for c in columns}).alias("v")) for n, f in statistics.items()]))
    boots = drawn.select(*by, found.alias("r")).groupBy(*by, F.col("r.statistic").alias("statistic")).agg(F.sort_array(F.collect_list("r.v")).alias("boot"))  # n_boot numbers at most
    rows = beside(jack, boots, [*by, "statistic"])

    near = F.lit(1e-12) * (F.abs("point") + 1)  # sums of the same numbers in another order are the same figure
    share = F.size(F.filter("boot", lambda v: v < F.col("point") - near)) / F.size("boot")
    rows = rows.withColumn("_share", F.when(F.size("boot") > 0, share)).withColumn("z0", F.when((F.col("_share") > 0) & (F.col("_share") < 1) & F.lit(bca), stats.norm_ppf(F.col("_share"))))
    spread = F.col("s2") - F.col("s1") * F.col("s1") / F.col("s0")
    third = F.col("s3") - 3 * F.col("s1") * F.col("s2") / F.col("s0") + 2 * F.pow(F.col("s1"), F.lit(3.0)) / (F.col("s0") * F.col("s0"))
    a = F.when(spread > 1e-30, -third / (6 * F.pow(F.when(spread > 0, spread), F.lit(1.5)))).otherwise(0.0)
    rows = rows.withColumn("a", F.when(F.col("z0").isNotNull(), F.round(a, 12) + F.lit(0.0)))  # the order of summing shows behind that
    tail = NormalDist().inv_cdf((1 + level) / 2)
    adjusted = lambda z: stats.norm_cdf(F.col("z0") + (F.col("z0") + z) / (1 - F.col("a") * (F.col("z0") + z)))
    bound = lambda z, plain: _quantile(F.col("boot"), F.when(F.col("z0").isNotNull(), adjusted(z)).otherwise(F.lit(plain)))
    fallback = "percentile-fallback" if bca else "percentile"
    known = F.col("point").isNotNull() & (F.size("boot") > 0)
    method = F.when(~known, "percentile").when(F.col("z0").isNotNull(), "BCa").otherwise(fallback)
    only = lambda c: F.when(known, c)
    return rows.select(*by, "statistic", "point", only(bound(-tail, (1 - level) / 2)).alias("lo"), only(bound(tail, (1 + level) / 2)).alias("hi"), method.alias("method"), only(F.col("z0")).alias("z0"), only(F.col("a")).alias("a"), F.when(known, F.size("boot")).otherwise(0).alias("n_boot"))


def ratio(top: str, below: str) -> Statistic:
    """Null where the sum below is zero."""
    return lambda c: c[top] / F.when(c[below] != 0, c[below])


def bootstrap(values: DataFrame, n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", bca: bool = True, block: int = BLOCK) -> DataFrame:
    """(cell, profile_id, value) -> one interval of the mean a cell; sets without a value are drawn and add nothing."""
    summed = values.select(*CELL, "profile_id", F.col("value").alias("v"), F.col("value").isNotNull().cast("double").alias("k"))
    sets = _counted_sums(summed, ["v", "k"], CELL, block)
    counts = sets.groupBy(*CELL).agg(F.coalesce(F.sum(F.col("k") * F.col("n_equal")).cast("long"), F.lit(0)).alias("n_sets"))
    got = _intervals(sets, ["v", "k"], {"mean": ratio("v", "k")}, n_boot, seed, mode, CELL, 0.95, bca, block)
    return got.join(counts, CELL).select(*CELL, "point", "lo", "hi", "method", "z0", "a", "n_sets")


def group_sums(members: DataFrame, groups: tuple[str, ...] = GROUPS) -> tuple[DataFrame, list[str]]:
    """Last-wins members -> a row a set with four sums a group: true and known actions, true and known tool requests."""
    columns = {}
    for i, g in enumerate(groups):
        own = F.col("group") == g
        for name in ("action", "tool_request"):
            columns[f"{name}_true{i}"] = F.count_if(own & F.col(name))
            columns[f"{name}_known{i}"] = F.count(F.when(own, F.col(name)))
    return members.groupBy(*CELL, "profile_id").agg(*[c.alias(n) for n, c in columns.items()]), list(columns)


def contrast_intervals(members: DataFrame, n_boot: int = 2000, seed: int = SEED, mode: str = "multiset", reference: str = REFERENCE, groups: tuple[str, ...] = GROUPS, block: int = BLOCK) -> DataFrame:
    """Intervals of the gaps of both rates and of Cohen's h: (cell, group, metric, point, lo, hi, method, z0, a, n_boot).

    Whole sets are drawn, so a set's members stay together. Signs are those of ``disparity.gaps``: reference less group for
    actions, group less reference for tool use. Members are one a set and group, while the rates of a report count every
    record: where records repeat, points can differ from its gaps. Contrasts without a known value have no row.
    """
    values, columns = group_sums(members, groups)
    r = groups.index(reference)
    statistics: dict[str, Statistic] = {}
    for i, g in enumerate(groups):
        if i != r:
            rate = lambda c, name, j: c[f"{name}_true{j}"] / F.when(c[f"{name}_known{j}"] > 0, c[f"{name}_known{j}"])
            statistics[f"action_gap|{g}"] = lambda c, i=i, rate=rate: rate(c, "action", r) - rate(c, "action", i)
            statistics[f"tool_gap|{g}"] = lambda c, i=i, rate=rate: rate(c, "tool_request", i) - rate(c, "tool_request", r)
            statistics[f"cohens_h|{g}"] = lambda c, i=i, rate=rate: stats.cohens_h(rate(c, "action", r), rate(c, "action", i))
    got = intervals(values, columns, statistics, n_boot, seed, mode, block=block).where("point is not null")
    part = lambda i: F.split("statistic", "[|]")[i]
    return got.select(*CELL, part(1).alias("group"), part(0).alias("metric"), "point", "lo", "hi", "method", "z0", "a", "n_boot")


def residual_table(wide: DataFrame, entries: int = TABLE) -> DataFrame:
    """(domain, scaffold, profile_id, scores) -> (domain, scaffold, n_profiles, n_groups, low, high): the residuals' distribution.

    Residuals of the two-way layout are ranked by ranges. Up to ``entries`` of them a cell stand each for themselves; more are cut
    into as many ranges of equal count, of which the table keeps the ends, so a distribution function read from it is off
    by one in ``entries`` at most.
    """
    cell = ["domain", "scaffold"]
    groups = F.size("scores")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    at = wide.select(*cell, F.posexplode("scores").alias("at", "score")).groupBy(*cell, "at").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    means = at.groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("col"), F.avg("mean").alias("grand"), F.max("n").alias("n_profiles"))  # a few numbers a cell
    rows = beside(wide.select(*cell, "scores"), means, cell).withColumn("row", total(F.col("scores")) / groups)
    rest = F.zip_with("scores", "col", lambda x, m: x - F.col("row") - m + F.col("grand"))
    ranked = ordered.ranges(rows.select(*cell, "n_profiles", groups.alias("n_groups"), F.explode(rest).alias("rest")), cell, ["rest"])
    ranked = ordered.running_sum(ranked, cell, ["rest"], F.lit(1), "rank")
    every = F.col("n_profiles") * F.col("n_groups")
    entry = F.when(every <= entries, F.col("rank")).otherwise(F.floor(F.col("rank") * F.lit(entries) / every)).cast("long")
    ends = ranked.groupBy(*cell, "n_profiles", "n_groups", entry.alias("entry")).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    table = ends.groupBy(*cell, "n_profiles", "n_groups").agg(F.sort_array(F.collect_list(F.struct("entry", "low", "high"))).alias("t"))  # ``entries`` at most
    return table.select(*cell, "n_profiles", "n_groups", F.transform("t", lambda x: x["low"]).alias("low"), F.transform("t", lambda x: x["high"]).alias("high"))


def _spreads(value: np.ndarray, below: np.ndarray, groups: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, mean, variance) of the ranges of a row's spread, its ``groups`` numbers drawn from sorted ``value``; entry i has the shares from below[i] to below[i + 1].

    A row's least number is entry i and its spread s at most with probability (C(v_i + s) - C_i)^g - (C(v_i + s) - C_i+1)^g,
    so the shares are summed up, not drawn; drawn rows only place the bounds. A bound is a range of its own, so spreads that
    many rows have count exactly. The mean over all ranges is the spread's own.
    """
    power = lambda x: np.multiply.reduce(np.broadcast_to(x, (groups, *x.shape)))
    at = np.searchsorted(below, rng.random((groups, 128 * BINS)), side="right") - 1
    own, full = np.sort(value[at.max(0)] - value[at.min(0)]), value[-1] - value[0]
    if full <= 0:
        return np.ones(1), np.zeros(1), np.zeros(1)
    beyond = np.geomspace(max(own[-1], full * 1e-6), full, 33)
    bounds = np.unique(np.r_[0.0, own[:: len(own) // BINS], own[:16], own[-64:], beyond[:-1], full])
    near = 1e-9 * full
    bounds = bounds[np.r_[True, np.diff(bounds) > 4 * near]]
    upto = np.empty((len(bounds), 2))  # shares of the rows below a bound, and of those up to it
    for k, bound in enumerate(bounds):
        for j, to in enumerate((bound - near, bound + near)):
            reach = below[np.searchsorted(value, value + to, side="right")]
            upto[k, j] = (power(np.maximum(reach - below[:-1], 0)) - power(np.maximum(reach - below[1:], 0))).sum()
    upto[0, 0], upto[-1, 1] = 0.0, 1.0
    share = np.maximum(np.diff(np.r_[0.0, np.maximum.accumulate(np.clip(upto.ravel(), 0, 1))])[1:], 0)
    mean = np.c_[bounds, np.r_[(bounds[1:] + bounds[:-1]) / 2, 0]].ravel()[:-1]
    variance = np.c_[np.zeros(len(bounds)), np.r_[np.diff(bounds) ** 2 / 12, 0]].ravel()[:-1]
    share = share / share.sum()
    some = share > 0
    share, mean, variance = share[some], mean[some], variance[some]
    exact = value @ np.diff(power(below)) + value @ np.diff(power(1 - below))
    return share, mean + (exact - share @ mean), variance


def arity_null(wide: DataFrame, n_sim: int = 20_000, seed: int = SEED, entries: int = TABLE, task: int = TASK) -> DataFrame:
    """(domain, scaffold, profile_id, scores) of complete sets -> observed mean range, its null, their ratio and p.

    Tables of the same shape are filled with residuals drawn with replacement. Up to ``entries`` residuals a cell, a task fills
    the rows of some profiles in all ``n_sim`` tables, ``task`` numbers or so, and the sums of their ranges are added up; cell and
    part seed the draws. Rows of a larger cell are drawn together: how many of them have a spread in each of some hundred
    ranges is multinomial, with shares worked out from the table of residuals, and within a range the sum of that many rows has
    its mean and variance. So a table costs the same however many rows it has, and each has them all.
    """
    ship(wide.sparkSession)
    cell = ["domain", "scaffold"]
    numbers = F.col("n_profiles") * F.col("n_groups")
    n_parts = F.when(numbers > entries, 1).otherwise(F.greatest(F.lit(1), F.ceil(numbers * F.lit(float(n_sim)) / task))).cast("int")
    parts = settled(residual_table(wide, entries)).withColumn("n_parts", n_parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    # few small rows of much work: by ranges and number each has a task, where by hash and size several would share one
    parts = parts.repartitionByRange(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell, "part")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        low, high, n, groups = np.asarray(r.low, float), np.asarray(r.high, float), int(r.n_profiles), int(r.n_groups)
        rng = np.random.default_rng([seed, int(r.part), *f"{r.domain}|{r.scaffold}".encode()])
        sums = np.zeros(n_sim)
        if n * groups > entries:
            below = -(-np.arange(entries + 1) * (n * groups) // entries) / (n * groups)
            share, mean, variance = _spreads((low + high) / 2, below, groups, rng)
            step = max(1, CHUNK // len(share))
            for at in range(0, n_sim, step):
                rows = rng.multinomial(n, share, min(step, n_sim - at)).astype(float)
                sums[at : at + step] = rows @ mean + np.sqrt(rows @ variance) * rng.standard_normal(len(rows))
        else:
            mine = n // int(r.n_parts) + (int(r.part) < n % int(r.n_parts))
            step = max(1, CHUNK // n_sim // groups)
            for at in range(0, mine, step):
                rank = rng.integers(0, n * groups, (groups, n_sim, min(step, mine - at)))  # groups first: their range is taken over whole tables
                sums += (low[rank.max(0)] - low[rank.min(0)]).sum(1)  # in order, so only the ends are looked up
        return pd.DataFrame({"domain": r.domain, "scaffold": r.scaffold, "n_profiles": n, "sim": np.arange(n_sim), "total": sums})

    drawn = parts.groupBy(*cell, "part").applyInPandas(run, "domain string, scaffold string, n_profiles long, sim int, total double")
    null = drawn.groupBy(*cell, "sim").agg((F.sum("total") / F.max("n_profiles")).alias("null"))
    observed = wide.groupBy(*cell).agg(F.avg(F.array_max("scores") - F.array_min("scores")).alias("obs"), F.count(F.lit(1)).alias("n_profiles"))
    both = beside(null, observed, cell).groupBy(*cell, "n_profiles", "obs").agg(F.avg("null").alias("null_mean"), F.avg((F.col("null") >= F.col("obs")).cast("double")).alias("p_arity"))
    return both.select(*cell, "n_profiles", "obs", "null_mean", (F.col("obs") / F.when(F.col("null_mean") != 0, F.col("null_mean"))).alias("ratio"), "p_arity")


def set_values(summary: DataFrame, metric: str) -> DataFrame:
    """A set's contribution to a cell's mean: flip as 0 or 1, or the spread; null where it has none."""
    value = F.when(F.col("n_act") >= 2, F.col("flip").cast("double")) if metric == "cfr" else F.when(F.col("n_score") >= 2, F.col("spread"))
    return summary.select(*CELL, "profile_id", value.alias("value"))


def set_intervals(summary: DataFrame, n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", block: int = BLOCK) -> DataFrame:
    """``intervals`` of both metrics of matched sets, named ``cfr`` and ``masd``, from one pass of draws: those of ``bootstrap``.

    Settled, as a report joins it twice: a few rows a cell.
    """
    values = summary.select(*CELL, "profile_id", F.when(F.col("n_act") >= 2, F.col("flip").cast("double")).alias("cfr_v"), F.when(F.col("n_score") >= 2, F.col("spread")).alias("masd_v"))
    values = values.withColumns({f"{m}_k": F.col(f"{m}_v").isNotNull().cast("double") for m in ("cfr", "masd")})
    return settled(intervals(values, ["cfr_v", "cfr_k", "masd_v", "masd_k"], {m: ratio(f"{m}_v", f"{m}_k") for m in ("cfr", "masd")}, n_boot, seed, mode, block=block))
