"""Mergeable bootstrap, intervals of any statistic, the arity null in parts, and ranks by ranges, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import matched, ordered, panel, resample, tests
from evenhand.plans import catalog, report
from evenhand.schema import CELL, DECISION, GROUPS, REFERENCE

CELLS = "domain string, scaffold string, model string, profile_id string, value double"


def values_of(spark, n, seed=4, cells=1):
    rng = random.Random(seed)
    rows = [("hiring", "C0", f"m{c}", f"p{i:05}", None if rng.random() < 0.1 else round(rng.gauss(10, 4), 2)) for c in range(cells) for i in range(n)]
    return spark.createDataFrame(rows, CELLS), np.array([math.nan if r[4] is None else r[4] for r in rows[:n]])


@pytest.mark.parametrize(("metric", "mode"), [("cfr", "distinct"), ("masd", "multiset")])
def test_every_cell_has_the_interval_of_the_plain_loop(spark, sf_dir, metric, mode):
    sets = resample.set_values(catalog._summary(spark, sf_dir), metric)
    got = {tuple(r[c] for c in CELL): r for r in resample.bootstrap(sets, n_boot=400, mode=mode).collect()}
    frame = sets.toPandas()
    assert len(got) == frame[CELL].drop_duplicates().shape[0]
    for cell, own in frame.groupby(CELL):
        want = resample.interval(own.sort_values("profile_id").value.to_numpy(float, na_value=np.nan), n_boot=400, mode=mode)
        assert got[cell].method == want["method"]
        for name in ("point", "lo", "hi", "z0", "a"):
            assert got[cell][name] == (None if want[name] is None else pytest.approx(want[name], abs=1e-8))


@pytest.mark.parametrize("mode", ["distinct", "multiset"])
def test_a_cell_of_many_blocks(spark, mode):
    sets, plain = values_of(spark, 3000)
    want = resample.interval(plain, n_boot=2000, mode=mode)
    got = [resample.bootstrap(sets.repartition(n), n_boot=2000, mode=mode, block=100).first() for n in (1, 50)]
    for name in ("point", "lo", "hi", "z0", "a"):
        assert got[0][name] == pytest.approx(got[1][name], rel=1e-9)
    r, width = got[0], want["hi"] - want["lo"]
    assert r.point == pytest.approx(want["point"]) and r.a == pytest.approx(want["a"], abs=1e-8) and r.method == "BCa"
    assert abs(r.lo - want["lo"]) < 0.15 * width and abs(r.hi - want["hi"]) < 0.15 * width


def test_blocks_share_out_every_replicates_draws(spark):
    sets, plain = values_of(spark, 1000, cells=2)
    ones = sets.withColumn("one", F.lit(1.0)).withColumn("two", (F.crc32("profile_id") % 2).cast("double"))
    sums = resample.replicates(ones, ["one", "two"], n_boot=300, mode="multiset", block=64)
    got = sums.groupBy("model").agg(F.min("one"), F.max("one"), F.count("*"), F.var_samp("two"), F.avg("two")).collect()
    share = ones.agg(F.avg("two")).first()[0]
    assert len(got) == 2 and got[0][4:] != got[1][4:]  # cells have draws of their own
    for r in got:
        assert r[1:4] == (1000.0, 1000.0, 300)
        assert r[4] == pytest.approx(1000 * share * (1 - share), rel=0.35) and r[5] == pytest.approx(1000 * share, abs=3)
    distinct = resample.replicates(ones, ["one"], n_boot=300, mode="distinct", block=64).agg(F.avg("one")).first()[0]
    assert distinct == pytest.approx(1000 * (1 - (1 - 1 / 1000) ** 1000), abs=3)
    assert sums.rdd.getNumPartitions() >= 1 and resample.replicates(ones.limit(0), ["one"], n_boot=3).count() == 0


def contrast_records(spark, n=40):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        for g in GROUPS[:4]:
            if rng.random() < 0.9:
                action = None if rng.random() < 0.1 else rng.random() < (0.7 if g == REFERENCE else 0.45)
                tool = None if rng.random() < 0.2 else rng.random() < 0.5
                rows.append((len(rows), "hiring", "C4", "m", f"p{i:03}", g, "n", action, 1.0, tool, None))
    return spark.createDataFrame(rows, DECISION), rows


def test_effects_of_contrasts_against_a_plain_loop(spark):
    frame, rows = contrast_records(spark)
    sets = sorted({r[4] for r in rows})
    by_set = {s: {r[5]: (r[7], r[9]) for r in rows if r[4] == s} for s in sets}

    def rate(chosen, group, k):
        known = [by_set[s][group][k] for s in chosen if group in by_set[s] and by_set[s][group][k] is not None]
        return sum(known) / len(known) if known else None

    def figure(chosen, group, metric):
        k = 1 if metric == "tool_gap" else 0
        own, ref = rate(chosen, group, k), rate(chosen, REFERENCE, k)
        if own is None or ref is None:
            return None
        if metric == "cohens_h":
            return abs(2 * math.asin(math.sqrt(ref)) - 2 * math.asin(math.sqrt(own)))
        return own - ref if metric == "tool_gap" else ref - own

    draws = np.random.default_rng(5).integers(0, len(sets), (200, len(sets)))
    got = {(r["group"], r.metric): r for r in resample.contrast_intervals(matched.last_wins(frame), n_boot=200, seed=5).collect()}
    assert set(got) == {(g, m) for g in GROUPS[1:4] for m in ("action_gap", "tool_gap", "cohens_h")}
    for (group, metric), r in got.items():
        boot = sorted(v for d in draws if (v := figure([sets[i] for i in d], group, metric)) is not None)
        assert r.point == pytest.approx(figure(sets, group, metric)) and r.n_boot == len(boot)
        jack = np.array([figure(sets[:i] + sets[i + 1 :], group, metric) for i in range(len(sets))])
        d = jack.mean() - jack
        assert r.a == pytest.approx((d**3).sum() / (6 * (d**2).sum() ** 1.5), abs=1e-8)
        assert r.z0 == pytest.approx(resample.NormalDist().inv_cdf(np.mean([v < r.point - 1e-12 for v in boot])), abs=1e-6)
        assert boot[0] <= r.lo <= r.point <= r.hi <= boot[-1]
        z = [resample.NormalDist().inv_cdf(x) for x in (0.025, 0.975)]
        at = [resample.NormalDist().cdf(r.z0 + (r.z0 + q) / (1 - r.a * (r.z0 + q))) for q in z]
        assert (r.lo, r.hi) == (pytest.approx(np.quantile(boot, at[0]), abs=1e-7), pytest.approx(np.quantile(boot, at[1]), abs=1e-7))


def test_report_has_intervals_of_effects(spark):
    frame, _ = contrast_records(spark)
    doc = report.document(report.build(frame, n_boot=100))
    effects = doc["cells"]["hiring|C4|m"]["contrasts"][GROUPS[1]]["effects"]
    assert set(effects) == {"action_gap", "tool_gap", "cohens_h"} and effects["action_gap"]["lo"] <= effects["action_gap"]["point"] <= effects["action_gap"]["hi"]
    assert "| cell | group | action gap | tool gap | Cohen's h |" in report.markdown(doc)


def test_any_statistic_and_keys(spark):
    rows = spark.createDataFrame([(k, f"p{i}", float(i % 5), float(1 + i % 3)) for k in (None, "a") for i in range(50)], "k string, profile_id string, x double, y double")
    both = {"ratio": resample.ratio("x", "y"), "root": lambda c: F.sqrt(c["x"]), "never": lambda c: F.when(c["x"] < 0, c["x"])}
    got = resample.intervals(rows, ["x", "y"], both, n_boot=100, by=["k"], mode="multiset").collect()
    assert len(got) == 6 and {r.k for r in got} == {None, "a"}
    assert all((r.point is None and r.lo is None and r.n_boot == 0) if r.statistic == "never" else r.lo < r.point < r.hi for r in got)
    assert resample.intervals(rows.limit(0), ["x"], {"s": lambda c: c["x"]}, n_boot=10, by=["k"]).count() == 0


@pytest.mark.parametrize(("entries", "task"), [(1 << 16, 10**9), (1 << 16, 50_000), (64, 50_000)])
def test_arity_null_in_parts(spark, entries, task):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)).round(2)
    wide = spark.createDataFrame([("hiring", "C0", f"p{i}", [float(v) for v in row]) for i, row in enumerate(x)], "domain string, scaffold string, profile_id string, scores array<double>")
    rest = (x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()).ravel()
    table = resample.residual_table(wide, entries).first()
    assert len(table.low) == min(entries, 360) and table.low[0] == pytest.approx(rest.min()) and table.high[-1] == pytest.approx(rest.max())
    if entries > 360:
        assert table.low == pytest.approx(sorted(rest)) and table.low == table.high
    plain = np.array([np.ptp(rng.choice(rest, x.shape), axis=1).mean() for _ in range(2000)])
    got = resample.arity_null(wide, n_sim=1000, entries=entries, task=task).first()
    assert got == resample.arity_null(wide.repartition(7), n_sim=1000, entries=entries, task=task).first()
    assert got.obs == pytest.approx(np.ptp(x, axis=1).mean()) and got.n_profiles == 60
    assert got.null_mean == pytest.approx(plain.mean(), abs=5 * plain.std() / math.sqrt(1000) + (0.03 if entries == 64 else 0))
    assert got.p_arity == pytest.approx((plain >= got.obs).mean(), abs=0.08)


@pytest.mark.parametrize("kind", ["normal", "heavy", "lattice", "constant"])
def test_counted_rows_have_the_spread_of_drawn_ones(kind):
    rng = np.random.default_rng(3)
    make = {"normal": lambda: rng.normal(size=500), "heavy": lambda: rng.standard_t(3, size=500), "lattice": lambda: rng.integers(0, 60, 500) / 10, "constant": lambda: np.ones(500)}
    value, below = np.sort(make[kind]()), np.arange(501) / 500
    share, mean, variance = resample._spreads(value, below, 6, rng)
    one = np.ptp(value[rng.integers(0, 500, (6, 1_000_000))], axis=0)
    assert share.sum() == pytest.approx(1) and share @ mean == pytest.approx(one.mean(), abs=5 * one.std() / 1000)
    assert share @ (mean**2 + variance) - (share @ mean) ** 2 == pytest.approx(one.var(), rel=0.02, abs=1e-12)
    rows = rng.multinomial(2000, share, 20_000).astype(float)
    total = rows @ mean + np.sqrt(rows @ variance) * rng.standard_normal(20_000)
    plain = np.array([np.ptp(value[rng.integers(0, 500, (6, 2000))], axis=0).sum() for _ in range(2000)])
    for q in (0.05, 0.5, 0.95) if kind != "constant" else ():
        assert (plain <= np.quantile(total, q)).mean() == pytest.approx(q, abs=0.05)


def test_large_cells_cost_no_more_draws(spark):
    wide = spark.range(4000).selectExpr("'hiring' as domain", "'C0' as scaffold", "cast(id as string) as profile_id", "transform(sequence(1, 6), k -> (id * 7919 + k * 104729) % 1009 / 10D) as scores")
    plain, counted = (resample.arity_null(wide, n_sim=500, entries=n).first() for n in (1 << 16, 1 << 12))
    assert counted.n_profiles == 4000 and counted.obs == plain.obs
    assert counted.null_mean == pytest.approx(plain.null_mean, rel=1e-3) and counted.p_arity == pytest.approx(plain.p_arity, abs=0.1)


def test_summary_reads_one_report(spark):
    drawn = spark.range(3).selectExpr("concat('hir-C', id) as cell", "1D as obs", "1D as old_floor", "1D as old_ratio", "1D as null_mean", "1D + rand() as new_ratio", "0.5D as p_arity", "1D as f_group", "0.01D as p_group")
    plan = panel.arity_summary(drawn)._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in plan and panel.arity_summary(drawn).first().omnibus_survive == 3


def test_running_sums_span_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randint(0, 300), i, rng.randint(1, 9)) for i in range(4000)]
    dealt = ordered.ranges(spark.createDataFrame(rows, "k string, x int, i int, n int"), ["k"], ["x", "i"], parts=16)
    assert dealt.where("k = 'hot'").select("_range").distinct().count() > 8
    got = ordered.least_behind(ordered.running_sum(dealt, ["k"], ["x", "i"], F.col("n"), "before"), ["k"], ["x", "i"], F.col("n"), "least").collect()
    for k in ("hot", "b", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.x, r.i))
        sums = np.cumsum([0, *[r.n for r in own]])
        assert [r.before for r in own] == sums[:-1].tolist()
        assert [r.least for r in own] == np.minimum.accumulate([r.n for r in own][::-1])[::-1].tolist()
    assert len(got) == len(rows)


def test_ranks_and_step_up_of_one_large_key(spark):
    rng = random.Random(7)
    scores = [round(rng.gauss(0, 1), 4) for _ in range(3000)]
    pairs = spark.createDataFrame([("hiring", "C0", "m", "g", s, 0.0) for s in scores], "domain string, scaffold string, model string, `group` string, score double, ref_score double")
    sizes = sorted(abs(s) for s in scores if s)
    got = {r["size"]: r.avg_rank for r in tests.average_ranks(pairs).collect()}
    assert got == {s: (2 * sizes.index(s) + sizes.count(s) + 1) / 2 for s in set(sizes)}
    ps = [round(rng.random() ** 3, 5) for _ in range(3000)]
    found = {r.k: r.q for r in tests.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "k int, p double"), [], ["k"]).collect()}
    order, least = sorted(range(3000), key=lambda k: (ps[k], k)), 1.0
    for at in range(2999, -1, -1):
        least = min(least, ps[order[at]] * 3000 / (at + 1))
        assert found[order[at]] == pytest.approx(least)


def test_both_metrics_share_their_draws(spark, sf_dir):
    summary = catalog._summary(spark, sf_dir)
    both = {(r.statistic, *[r[c] for c in CELL]): r for r in resample.set_intervals(summary, n_boot=60).collect()}
    for metric in ("cfr", "masd"):
        for r in resample.bootstrap(resample.set_values(summary, metric), n_boot=60).collect():
            own = both[(metric, *[r[c] for c in CELL])]
            assert [own[c] for c in ("point", "lo", "hi", "method", "z0", "a")] == [r[c] for c in ("point", "lo", "hi", "method", "z0", "a")]


def test_equal_sets_of_a_large_cell_are_counted(spark):
    """However many sets a cell has, what is drawn from is a row for each of its different values."""
    rows = spark.range(30_000).select(*[F.lit("a").alias(c) for c in CELL], F.col("id").cast("string").alias("profile_id"), (F.col("id") % 3 == 0).cast("double").alias("value"))
    sets = resample.counted(rows, ["value"])
    assert sorted((r.value, r.n_equal, r.profile_id) for r in sets.collect()) == [(0.0, 20_000, None), (1.0, 10_000, None)]
    drawn = np.array([r.value for r in resample.replicates(rows, ["value"], mode="multiset").collect()])
    assert drawn.mean() == pytest.approx(10_000, abs=10) and drawn.std() == pytest.approx(math.sqrt(30_000 * 2 / 9), rel=0.1)
    drawn = np.array([r.value for r in resample.replicates(rows, ["value"]).collect()])
    plain = np.array([(np.unique(d) % 3 == 0).sum() for d in np.random.default_rng(3).integers(0, 30_000, (2000, 30_000))])
    assert drawn.mean() == pytest.approx(plain.mean(), abs=6 * plain.std() / math.sqrt(1000)) and drawn.std() == pytest.approx(plain.std(), rel=0.1)


def test_how_many_equal_sets_are_drawn():
    rng = np.random.default_rng(9)
    for n, k in ((1, 0), (1, 3), (2, 2), (7, 5), (40, 60)):
        want = np.bincount([len(set(d)) for d in rng.integers(0, n, (20_000, k)).tolist()], minlength=n + 1) / 20_000
        got = np.bincount(resample._reached(rng, np.full(20_000, k), n), minlength=n + 1) / 20_000
        assert abs(want - got).max() < 0.02
    sizes, times = np.array([1, 3, 1024, 1025, 2048, 5000]), np.array([[0, 0, 0, 0, 0, 0], [9, 1, 1, 1, 1, 1], [2, 900, 10**5, 10**5, 10**5, 10**6]])
    assert resample._distinct(rng, times, sizes).tolist() == [[0] * 6, [1] * 6, sizes.tolist()]
