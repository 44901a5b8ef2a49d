import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import stats
from evenhand.operators import anova, disparity, matched, replay, resample, tests
from evenhand.plans import catalog
from evenhand.schema import DECISION, REFERENCE

OTHER = "black_female"


def records(spark, sets, scaffold="C0"):
    """sets: (action, score, tool) of the reference and of another group; more rows of a group come later."""
    rows = []
    for i, members in enumerate(sets):
        for group, m in members:
            action, score, *tool = m
            rows.append((len(rows), "hiring", scaffold, "m", f"p{i:03}", group, "n", action, None if score is None else float(score), tool[0] if tool else None, None))
    return spark.createDataFrame(rows, DECISION)


def two(a, b):
    return [(REFERENCE, a), (OTHER, b)]


def frames(spark, sets, **k):
    d = records(spark, sets, **k)
    m = matched.last_wins(d).cache()
    return d, matched.set_summary(m), matched.reference_pairs(m)


@pytest.mark.parametrize(("sets", "cfr", "masd"), [([two((True, 80), (True, 78))], 0.0, 2.0), ([two((True, 80), (False, 40))], 1.0, 40.0), ([two((True, 80), (True, 70)), two((True, 60), (True, 60))], 0.0, 5.0), ([two((None, None), (None, 1))], None, None), ([[(OTHER, (True, 5))]], None, None)])
def test_flip_rate_and_spread(spark, sets, cfr, masd):
    _, s, _ = frames(spark, sets)
    assert disparity.flip_rate(s).first().cfr == cfr
    assert disparity.score_spread(s).first().masd == masd


def test_rates_count_repeats_and_sets_take_the_last(spark):
    d, s, _ = frames(spark, [[(REFERENCE, (True, 1)), (OTHER, (True, 1)), (OTHER, (False, 9))]])
    assert s.first().spread == 8.0 and s.first().flip
    assert {r["group"]: r.rate for r in disparity.rates(d).collect()} == {REFERENCE: 1.0, OTHER: 0.5}


def test_rate_gaps_have_opposite_signs(spark):
    d, *_ = frames(spark, [two((True, 1, False), (i < 3, 1, True)) for i in range(10)], scaffold="C4")
    action, tool = disparity.rates(d), disparity.rates(d, "tool_request")
    assert disparity.disparity(action).first().disparity == pytest.approx(0.7)
    assert disparity.gaps(action, 1).first().gap == pytest.approx(0.7)
    assert disparity.disparity(tool).first().disparity == 1.0 and disparity.gaps(tool, -1).first().gap == 1.0
    assert disparity.gaps(action.where(F.col("group") == OTHER), 1).count() == 0


def test_mcnemar_is_exact_for_small_counts(spark):
    pairs = [(b, c) for b in range(51) for c in range(51)]
    got = spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n = r.b + r.c
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n)
        assert r.p == pytest.approx(want, rel=1e-14)
    assert next(r.p for r in got if (r.b, r.c) == (1, 8)) == 0.0390625


def test_mcnemar_of_many_pairs_needs_no_long_arrays(spark):
    b, c = 5_000_000, 5_006_000
    p = spark.range(1).select(stats.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).first().p
    z = (abs(b - c) - 1) / math.sqrt(b + c)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_mcnemar(spark):
    r = tests.mcnemar(frames(spark, [two((True, 1), (False, 1))] * 20)[2]).first()
    assert (r.discordant, r.b) == (20, 20) and r.p == pytest.approx(2 / 2**20)
    assert tests.mcnemar(frames(spark, [two((True, 1), (True, 1))])[2]).first().p == 1.0
    assert tests.mcnemar(frames(spark, [two((True, 1), (False, 1)), two((False, 1), (True, 1))])[2]).first().p == 1.0
    many = spark.range(1).select(stats.mcnemar_p(F.lit(3000).cast("long"), F.lit(2800).cast("long")).alias("p")).first().p
    assert 0 < many < 0.01  # where powers of two would overflow


def test_wilcoxon(spark):
    r = tests.wilcoxon(frames(spark, [two((True, 80), (True, 70))] * 15)[2]).first()
    assert r.n == 15 and r.p < 0.01 and r.w == 0.0
    none = tests.wilcoxon(frames(spark, [two((True, 80), (True, 80))])[2]).first()
    assert none.n == 0 and none.p == 1.0 and none.w is None
    level = tests.wilcoxon(frames(spark, [two((True, 80), (True, 70)), two((True, 70), (True, 80))])[2]).first()
    assert level.z < 0 and level.p < 1.0  # a W equal to its mean is corrected upwards, so z is below 0


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.5), ("d", 0.9), ("e", None), ("f", float("nan"))], "k string, p double")
    got = {r.k: (r.q, r.reject) for r in tests.benjamini_hochberg(rows, [], ["k"]).collect()}
    assert set(got) == set("abcd") and got["a"] == (pytest.approx(0.004), True) and not got["d"][1]
    assert got["b"][0] == pytest.approx(0.08)
    assert tests.bh_elementwise(rows.withColumn("fam", F.lit(1)), ["fam"], ["k"]).first().n_survive == 1


def test_small_functions(spark):
    x = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.025, 0.3, 0.5, 0.975, 0.999)], "p double")
    for r in x.select("p", stats.norm_cdf(stats.norm_ppf(F.col("p"))).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=1e-8)
    one = spark.range(1).select(stats.norm_ppf(F.lit(0.0)).alias("lo"), stats.norm_ppf(F.lit(1.0)).alias("hi"), stats.cohens_h(F.lit(0.5), F.lit(0.5)).alias("h0"), stats.cohens_h(F.lit(1.0), F.lit(0.0)).alias("h1"), stats.clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("c")).first()
    assert (one.lo, one.hi, one.h0, one.c) == (-math.inf, math.inf, 0.0, None) and one.h1 == pytest.approx(math.pi)


@pytest.mark.parametrize(("f", "p"), [(0.21713147410358588, 0.95376), (1.1119, 0.3648), (2.0811, 0.0816)])
def test_published_f_tests(f, p):
    assert stats.beta_share(55 / 2, 5 / 2, 55 / (55 + 5 * f)) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize(("k", "lo", "hi", "modes"), [(1, 0, 0.143, ("distinct",)), (4, 0.125, 0.5, ("distinct",)), (2, 0, 0.333, ("distinct", "multiset"))])
def test_published_intervals_come_from_distinct_sets(k, lo, hi, modes):
    rng = random.Random(5)
    found = set()
    for mode in ("distinct", "multiset"):
        for _ in range(12):
            v = np.zeros(12)
            v[rng.sample(range(12), k)] = 1
            got = resample.interval(v, mode=mode)
            if float(f"{got['lo']:.3g}") == lo and float(f"{got['hi']:.3g}") == hi:
                found.add(mode)
    assert found <= set(modes)
    assert "distinct" in found


def test_bootstrap(spark):
    _, s, _ = frames(spark, [two((True, 80), (True, 70 - i % 5)) for i in range(30)])
    r = resample.bootstrap(resample.set_values(s, "masd"), n_boot=500, seed=1).first()
    assert r.lo <= r.point <= r.hi and r.method == "BCa" and r.n_sets == 30
    assert resample.bootstrap(resample.set_values(s.repartition(7), "masd"), n_boot=500, seed=1).first() == r
    assert resample.bootstrap(resample.set_values(s, "cfr"), n_boot=50).first().method == "percentile-fallback"


def test_two_way_layout(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 6)).round(3)
    from evenhand.schema import GROUPS

    rows = [("hiring", "C0", f"p{i:02}", g, float(x[i, j])) for i in range(12) for j, g in enumerate(sorted(GROUPS))]
    wide = anova.complete(spark.createDataFrame([*rows, ("hiring", "C0", "alone", GROUPS[0], 1.0)], "domain string, scaffold string, profile_id string, `group` string, score double"))
    r = anova.with_p(anova.two_way(wide)).first()
    rest = x - x.mean(1, keepdims=True) - x.mean(0) + x.mean()
    f = (12 * ((x.mean(0) - x.mean()) ** 2).sum() / 5) / ((rest**2).sum() / 55)
    assert r.n_profiles == 12 and r.f_group == pytest.approx(f) and 0 < r.p_group < 1
    null = resample.arity_null(wide, n_sim=300).first()
    assert null.obs == pytest.approx(np.ptp(x, axis=1).mean()) and null.ratio == pytest.approx(1, abs=0.3)
    flat = wide.withColumn("scores", F.transform("scores", lambda s: F.lit(1.0)))
    assert math.isnan(anova.two_way(flat).first().f_group)


def test_registered_null_has_all_the_draws_of_the_reference(spark, sf_dir):
    rows = catalog.QUERIES["arity_null"](spark, sf_dir).collect()
    of = lambda n: [abs(r.p_arity * n - round(r.p_arity * n)) < 1e-6 for r in rows]
    assert rows and all(of(20_000)) and not all(of(2_000))


def test_published_cost_and_composite(spark):
    plan = spark.createDataFrame([(m, s, 216) for m in ("claude-haiku-4-5", "claude-sonnet-4-6", "claude-opus-4-8") for s in ("C0", "C2", "C3")], "model string, scaffold string, n_calls long")
    assert {r.model: r.est_usd for r in replay.cost(plan).collect()} == {"claude-haiku-4-5": 1.3824, "claude-sonnet-4-6": 4.1472, "claude-opus-4-8": 6.912}
    cells = spark.createDataFrame([("m", "hiring", 0.1, 10.0, 0.2), ("m", "triage", 0.0, 8.0, None), ("n", "triage", None, 1.0, 0.0)], "model string, domain string, cfr double, masd double, disparity double")
    got = {r.model: (r.composite_score, r.position) for r in replay.leaderboard(cells).collect()}
    assert got == {"m": (0.8667, 1), "n": (None, 2)}


def test_retest_and_matrix_take_the_last_record(spark):
    row = "domain string, scaffold string, profile_id string, `group` string, ord int, action boolean, score double"
    first = spark.createDataFrame([("hiring", "C0", "p", "g", 0, True, 1.0), ("hiring", "C0", "p", "g", 1, False, 5.0)], row)
    second = spark.createDataFrame([("hiring", "C0", "p", "g", 0, True, 9.0), ("hiring", "C0", "p", "g", 1, False, 7.0)], row)
    r = replay.retest(first, second, ["domain"]).first()
    assert (r.n_pairs, r.agreement, r.mae) == (1, 1.0, 2.0)
    rows = [("hiring", "C0", "p", g, 0, True, float(i)) for i, g in enumerate("aab")] + [("hiring", "C0", "q", g, i, True, float(i)) for i, g in enumerate("abca")]
    got = anova.complete(spark.createDataFrame(rows, row), 3).collect()
    assert [(r.profile_id, list(r.scores)) for r in got] == [("q", [3.0, 1.0, 2.0])]
