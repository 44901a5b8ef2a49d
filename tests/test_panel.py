"""Sinks and command line of panel runs, against what they were written from."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

import evenhand
from evenhand import cli
from evenhand.functions import scenarios as S
from evenhand.operators import panel, textcheck
from evenhand.plans import report
from evenhand.schema import GROUPS
from evenhand.sources import decisions, files


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    path = tmp_path_factory.mktemp("panel") / "profiles.jsonl"
    path.write_text("\n".join(json.dumps({"id": f"{d}{i}", "domain": d, "content": f"Case {i} of {d}"}) for i in range(4) for d in ("hiring", "lending", "triage")))
    return str(path)


@pytest.fixture(scope="module")
def base(spark, split):
    return cli._profiles(spark, split)


def test_names_bias_and_summary_from_the_command_line(spark, split, tmp_path, capsys):
    pools = tmp_path / "pools.json"
    pools.write_text(json.dumps({"cells": {g: [f"Name {g[0]}{i}" for i in range(3)] for g in GROUPS if g != "black_female"}}))
    common = ["--profiles", split, "--names", str(pools), "--n-boot", "50"]
    cli.main(["run", *common, "--out", f"{tmp_path}/a", "--scaffolds", "C0", "C4", "--bias", '{"black_female": -20}', "--bias-by-prompt", "--model", "m1"])
    said = capsys.readouterr().out
    assert "hiring|C0|m1" in said and "MASD=20" in said
    doc = json.loads((tmp_path / "a_report.json").read_text())
    assert all(c["masd"] == 20 for c in doc["cells"].values())  # the pool is empty, so the prompt has the label
    one = doc["cells"]["hiring|C0|m1"]["contrasts"]["black_female"]
    assert one["mean_abs_diff"] == 20 and one["w"] == 0 and one["n_nonzero"] == 4 and doc["cells"]["hiring|C4|m1"]["contrasts"]["black_male"]["tool_gap"] == 0
    raw = [json.loads(x) for p in (tmp_path / "a_raw").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["name"] for r in raw if r["group"] == "black_female"} == {"black_female"} and all(r["name"].startswith("Name w") for r in raw if r["group"] == "white_male")
    cli.main(["report", *common, "--raw", f"{tmp_path}/a_raw", "--model", "m1", "--out", f"{tmp_path}/b", "--scaffolds", "C0", "C4"])
    assert json.loads((tmp_path / "b_report.json").read_text()) == doc

    cli.main(["board", "--reports", f"{tmp_path}/*_report.json", "--out", f"{tmp_path}/board"])
    rows = json.loads((tmp_path / "board.json").read_text())["rows"]
    assert [r["model"] for r in rows] == ["m1"] and rows[0]["n_records"] == 144 and len(rows[0]["per_cell"]) == 6 and rows[0]["mean_masd"] == 20
    assert "<td>m1</td>" in (tmp_path / "board.html").read_text()

    cli.main(["retest", "--raw", f"{tmp_path}/a_raw", f"{tmp_path}/a_raw", "--out", f"{tmp_path}/again"])
    assert "Over all: 1 of 144 decisions agree, scores differ by 0." in (tmp_path / "again.md").read_text()
    assert "hispanic-male:0.00" in report.tool_table(decisions.trace(spark, f"{tmp_path}/a_raw"))


def test_arity_files_and_figures(spark, base, tmp_path, capsys):
    made = decisions.varied(base).withColumn("model", F.lit("m")).withColumn("name", F.lit("n")).withColumn("tool_request", F.lit(None).cast("boolean"))
    report.write_raw(made, f"{tmp_path}/raw")
    cli.main(["arity", "--raw", f"{tmp_path}/raw", "--n-sim", "200", "--out", f"{tmp_path}/arity"])
    assert "of 9 cells" in capsys.readouterr().out
    rows = json.loads((tmp_path / "arity.json").read_text())
    assert len(rows) == 9 and all(abs(r["old_ratio"] - r["obs"] / r["old_floor"]) < 1e-12 and abs(r["new_ratio"] - r["obs"] / r["null_mean"]) < 1e-9 for r in rows)
    again = files.arity_rows(spark, f"{tmp_path}/arity.json")
    assert {r.cell: r.obs for r in again.collect()} == {r["cell"]: r["obs"] for r in rows}
    s = panel.arity_summary(again.select("cell", "obs", "old_floor", "old_ratio", "null_mean", "new_ratio", "p_arity", F.col("F_group").alias("f_group"), "p_group")).first()
    assert s.n_cells == 9 and s.old_highest == max(r["old_ratio"] for r in rows) and s.above_floor == sum(r["new_ratio"] > 1 for r in rows)
    bars, lines = panel.arity_bars(again).collect(), panel.arity_lines(again).collect()
    assert len(bars) == 18 and {(r.domain, r.scaffold) for r in lines} == {(d, c) for d in ("hir", "len", "tri") for c in ("C0", "C2", "C3")}


def test_tasks_profiles_pools_and_sections(spark, base, tmp_path):
    grid = decisions.grid(S.with_domain(base)).withColumn("name", decisions.hashed_name())
    report.write_lines(report.tasks(grid), f"{tmp_path}/tasks")
    rows = spark.read.json(f"{tmp_path}/tasks").collect()
    assert len(rows) == 12 * 3 * 6 and all(r["name"] in r.prompt and r.score_lo < r.score_hi for r in rows)

    drafted = spark.createDataFrame([("medical_triage", '{"id": "t1", "content": "Ä text"}'), ("other", '{"id": "o1", "title": "T", "content": ""}')], "domain string, profile string")
    report.write_lines(report.profile_records(drafted), f"{tmp_path}/profiles")
    got = {r.id: r for r in files.profiles(spark, f"{tmp_path}/profiles").collect()}
    assert got["t1"].domain == "triage" and got["t1"].difficulty == "unknown" and got["o1"].domain == "other" and not files.altered(files.profiles(spark, f"{tmp_path}/profiles")).count()

    pools = spark.createDataFrame([("g", 1, "b"), ("g", 0, "a"), ("empty", None, None)], "`group` string, pos int, name string")
    report.write_pools(pools, f"{tmp_path}/pools.json")
    assert json.loads((tmp_path / "pools.json").read_text()) == {"empty": [], "g": ["a", "b"]}

    sections = spark.createDataFrame([("ethics", "## Title\n\nBody\nmore"), ("unknown", "text"), ("bcf", "  ")], "key string, text string")
    report.write_sections(sections, f"{tmp_path}/sections")
    kept = spark.read.text(f"{tmp_path}/sections", wholetext=True).collect()
    assert [(r.section, r.value) for r in kept] == [("09_ethics", "Body\nmore\n")]


def test_committed_texts_and_the_clean_gate(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for key, text in (("a", "12 of 15 \\cite{x, y}"), ("b", "3.5 percent"), ("c", "\\cite{z}")):
        (tmp_path / key).write_text(text)
    git("add", ".")
    git("-c", "user.name=n", "-c", "user.email=e", "commit", "-qm", "first")
    first = files.committed(spark, str(tmp_path), {k: k for k in "abcd"})
    second = spark.createDataFrame([("a", "Of 15, 12 \\cite{y,x}"), ("b", "3.5 and 4"), ("c", "\\cite{w}"), ("d", "new")], "key string, text string")
    assert [r.key for r in textcheck.clean(first, second, "key").collect()] == ["a"]


def test_unknown_keys_fail_or_fall_back(spark, base):
    with pytest.raises(Exception, match="unknown domain other"):
        decisions.mock(base.withColumn("domain", F.lit("other"))).collect()
    with pytest.raises(ValueError, match="C9"):
        decisions.grid(base, ("C9",))
    payloads = spark.createDataFrame([('{"acuity": null, "apr_tier": 2}',), ('{"note": 1}',), (None,)], "raw string")
    assert [r[0] for r in payloads.select(panel.first_score(F.col("raw"), strict=False)).collect()] == [2.0, None, None]
    with pytest.raises(Exception, match="no score in"):
        payloads.select(panel.first_score(F.col("raw"))).collect()
    assert spark.range(1).select(panel.mapped(F.lit("opus"), panel.MODEL_IDS), panel.mapped(F.lit("x"), panel.MODEL_IDS)).first()[:] == ("claude-opus-4-8", "x")


def test_exports():
    assert all(getattr(evenhand, name) is not None for name in evenhand.__all__)
    with pytest.raises(AttributeError):
        evenhand.nothing
