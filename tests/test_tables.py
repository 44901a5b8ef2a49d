"""The stored decision table, layouts that are not balanced, mentions of labels, floors, effects, streaming order."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand import cli
from evenhand.functions import scenarios as S
from evenhand.operators import anova, disparity, matched, panel, replay
from evenhand.plans import report
from evenhand.schema import GROUPS
from evenhand.sources import decisions, mentions, table
from evenhand.streaming import replay as stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_a_stored_table_needs_no_shuffle_by_set(spark, sf_dir):
    rows = decisions.from_lineitem(spark, sf_dir)
    table.save(rows, "stored_decisions", buckets=4)
    grid = rows.select("model", *replay.KEY).distinct()
    table.save(grid, "stored_grid", buckets=4)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        stored = table.load(spark, "stored_decisions")
        summary = lambda d, dealt: disparity.flip_rate(matched.set_summary(matched.last_wins(d, dealt)))
        assert not [x for x in exchanges(summary(stored, True)) if "profile_id" in x] and [x for x in exchanges(summary(rows, False)) if "profile_id" in x]
        pairs = disparity.pairwise_flip(matched.reference_pairs(matched.last_wins(stored, True)))
        assert not [x for x in exchanges(pairs) if "profile_id" in x]
        replayed = replay.replay(table.load(spark, "stored_grid").where("model = 'm0'").select(*replay.KEY), stored.where("model = 'm0'"))
        assert not exchanges(replayed) and "model=m0" in plan(replayed).replace(" ", "") or "m0" in plan(replayed)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
        assert same(summary(rows, False), summary(stored, True))
        assert same(replay.replay(grid.where("model = 'm0'").select(*replay.KEY), rows.where("model = 'm0'")), replayed)
        table.save(rows.where("model = 'm0'").withColumns({"ord": F.col("ord") + 10**15, "score": F.lit(1.0)}), "stored_decisions", buckets=4, mode="append")
        last = matched.last_wins(table.load(spark, "stored_decisions"), True)
        assert last.where("model = 'm0' and score <> 1.0").count() == 0 and last.where("model = 'm1' and score > 1.0").count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("stored_decisions", "stored_grid"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def scores_of(spark, cells):
    rows = [("hiring", s, f"p{i:02}", g, float(y), n) for s, x in cells.items() for i, row in enumerate(x) for n, (g, y) in enumerate(zip(GROUPS, row, strict=True)) if not np.isnan(y)]
    return spark.createDataFrame(rows, "domain string, scaffold string, profile_id string, `group` string, score double, ord int")


def dense(x):
    """Sums of squares and degrees of freedom of profile + group by least squares over indicator columns."""
    at = np.argwhere(~np.isnan(x))
    y = np.array([x[i, j] for i, j in at])
    p = (at[:, :1] == np.unique(at[:, 0])).astype(float)
    full = np.hstack([p, (at[:, 1:] == np.arange(x.shape[1])).astype(float)])
    rest = lambda m: y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    few, more = (rest(p) ** 2).sum(), (rest(full) ** 2).sum()
    rank = np.linalg.matrix_rank(full)
    return few - more, more, rank - p.shape[1], len(y) - rank


def test_unbalanced_layouts_against_dense_least_squares(spark):
    rng = np.random.default_rng(1)
    whole = rng.normal(size=(9, 6)).round(2)
    holes = np.where(rng.random((30, 6)) < 0.4, np.nan, rng.normal(size=(30, 6)).round(2))
    holes[3] = np.nan  # no score at all
    apart = np.where(np.arange(6) < 3, np.where(np.arange(20)[:, None] < 10, 1, np.nan), np.where(np.arange(20)[:, None] < 10, np.nan, 1)) * rng.normal(size=(20, 6))
    cells = {"C0": whole, "C2": holes, "C3": apart}
    rows = scores_of(spark, cells)
    got = {r.scaffold: r for r in anova.with_p(anova.unbalanced(rows)).collect()}
    for s, x in cells.items():
        group, error, df_group, df_error = dense(x[(~np.isnan(x)).sum(1) > 1])
        assert (got[s].df_group, got[s].df_error) == (df_group, df_error)
        assert got[s].ss_group == pytest.approx(group) and got[s].ss_error == pytest.approx(error)
        assert got[s].f_group == pytest.approx(group / df_group / (error / df_error)) and 0 < got[s].p_group < 1
    assert got["C3"].df_group == 4  # the groups fall into two parts that no profile links
    balanced = anova.two_way(anova.complete(rows.where("scaffold = 'C0'"))).first()
    assert got["C0"].f_group == pytest.approx(balanced.f_group) and got["C0"].df_error == balanced.df_error
    flat = rows.withColumn("score", F.lit(2.0))
    assert all(np.isnan(r.f_group) for r in anova.unbalanced(flat).collect()) and anova.unbalanced(rows.limit(0)).count() == 0


def test_incomplete_profiles_are_told(spark):
    rows = spark.createDataFrame([("hiring", "C0", p, g, y) for p, gs in {"a": GROUPS, "b": GROUPS[:4], "c": GROUPS[:1]}.items() for g, y in zip(gs, [1.0, 2.0, None, 4.0, 5.0, 6.0], strict=False)], "domain string, scaffold string, profile_id string, `group` string, score double")
    got = {r.profile_id: (r.n_known, r.missing) for r in anova.incomplete(rows).collect()}
    assert got == {"a": (5, [GROUPS[2]]), "b": (3, [GROUPS[2], *GROUPS[4:]]), "c": (1, list(GROUPS[1:]))}


def test_mentions_of_thousands_of_labels(spark):
    rng = random.Random(4)
    labels = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(4000)} | {"a b", "é", "o'brien"})
    texts = [" ".join("".join(rng.choice("abcdE") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(30)] + ["", None, "O'BRIEN É A B", "ab" * 100_000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, content string, found string")
    got = {r.i: r.found for r in mentions.mentions(rows, [*labels, ""]).collect()}
    assert got == {i: [x for x in labels if x in (t or "").lower()] for i, t in enumerate(texts)}
    assert mentions.mentions(rows, []).where("size(found) > 0").count() == 0 and mentions.mentions(rows.limit(0), labels).count() == 0


def test_floors_come_from_two_traces(spark, sf_dir, tmp_path, capsys):
    base = decisions.profiles(spark, sf_dir).where("doc_id < 24")
    runs = [decisions.varied(base, s) for s in ("first", "second")]
    shaped = [r.withColumns({"model": F.lit("m"), "name": F.lit("n"), "tool_request": F.lit(None).cast("boolean")}) for r in runs]
    lacking = shaped[0].where(~((F.col("profile_id") == "3") & (F.col("group") == GROUPS[2])))
    for i, r in enumerate((lacking, shaped[1])):
        report.write_raw(r, f"{tmp_path}/raw{i}")
    cli.main(["arity", "--raw", f"{tmp_path}/raw0", "--retest", f"{tmp_path}/raw1", "--n-sim", "50", "--out", f"{tmp_path}/arity"])
    assert re.search(r"hiring C0: 1 profiles left out", capsys.readouterr().out)
    want = {panel_code(r): r.mae for r in replay.retest(lacking, shaped[1], ["domain", "scaffold"]).collect()}
    rows = json.loads((tmp_path / "arity.json").read_text())
    assert {r["cell"]: r["old_floor"] for r in rows} == pytest.approx(want) and all(r["old_ratio"] == pytest.approx(r["obs"] / r["old_floor"]) for r in rows)
    same = panel.arity_report(anova.complete(runs[0]), 20, panel.retest_floors(runs[0], runs[0])).collect()
    assert len(same) == 9 and all(r.old_floor is None and r.old_ratio is None for r in same)


def panel_code(r):
    return f"{r.domain[:3]}-{r.scaffold}"


def test_any_effect_can_be_planted(spark, sf_dir):
    base = decisions.profiles(spark, sf_dir)
    plain = decisions.mock(base, ("C0",))
    effect = F.when((F.col("group") == GROUPS[4]) & (F.col("domain") == "hiring"), -F.col("base") / 2)
    moved = decisions.mock(base, ("C0",), effect=effect)
    key = ["profile_id", "group"]
    both = plain.select(*key, "domain", F.col("score").alias("was")).join(moved.select(*key, "score"), key)
    hit = (F.col("group") == GROUPS[4]) & (F.col("domain") == "hiring")
    assert both.where(hit & (F.col("score") != F.col("was") / 2)).count() == 0 and both.where(~hit & (F.col("score") != F.col("was"))).count() == 0 and both.where(hit).count() > 0


def test_body_follows_the_marker(spark):
    rows = spark.createDataFrame([("hiring", "C0", f"a {S.MARKER} b", "x"), ("triage", "C0", "c", "y")], "domain string, scaffold string, content string, name string")
    full = S.with_domain(rows).join(S.scaffolds(spark), "scaffold")
    assert full.where(S.after_marker(S.prompt()) != S.prompt_body()).count() == 0
    assert spark.range(1).select(S.after_marker(F.lit("no mark"))).first()[0] == "no mark"


def test_a_batch_keeps_the_order_of_files_and_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda i, score: json.dumps({"model": "m", "domain": "hiring", "scaffold": "C0", "profile_id": f"p{i}", "group": GROUPS[0], "name": "n", "decision": {"advance": True, "score": score}})
    (source / "b.jsonl").write_text(line(0, 9))
    (source / "a.jsonl").write_text("\n".join(line(i % 7, i) for i in range(300)))
    stream.ingest(spark, str(source), f"{tmp_path}/sink", f"{tmp_path}/check").awaitTermination(60)
    (source / "c.jsonl").write_text(line(1, 77))
    stream.ingest(spark, str(source), f"{tmp_path}/sink", f"{tmp_path}/check").awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/sink").orderBy("ord").collect()
    assert [r.score for r in rows] == [*map(float, range(300)), 9.0, 77.0] and len({r.ord for r in rows}) == 302
    last = {r.profile_id: r.score for r in matched.last_wins(spark.read.parquet(f"{tmp_path}/sink")).collect()}
    assert last == {"p0": 9.0, "p1": 77.0, **{f"p{i % 7}": float(i) for i in range(293, 300) if i % 7 > 1}}
