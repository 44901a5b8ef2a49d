import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evenhand import cli
from evenhand.functions import scenarios as S
from evenhand.operators import textcheck
from evenhand.plans import report
from evenhand.schema import GROUPS
from evenhand.sources import adapters, decisions, files
from evenhand.streaming import replay as stream


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    path = tmp_path_factory.mktemp("split") / "profiles.jsonl"
    rows = [{"id": f"p{i}", "domain": d, "content": f"Profile {i} of {d}"} for i in range(8) for d in ("hiring", "lending", "triage")]
    rows[0]["content_sha256_16"] = hashlib.sha256(rows[0]["content"].encode()).hexdigest()[:16]
    rows[1]["content_sha256_16"] = "0" * 16
    rows = [r | {"id": r["domain"] + r["id"]} for r in rows]
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_profiles_have_defaults_and_order(spark, split):
    rows = files.profiles(spark, split, ordered=True).orderBy("line_no").collect()
    assert len(rows) == 24 and rows[0].title == "" and rows[0].difficulty == "unknown" and rows[3].id == "hiringp1"
    assert files.altered(files.profiles(spark, split)).count() == 1


def test_neutral_and_biased_reports(spark, split, tmp_path):
    cli.main(["run", "--profiles", split, "--out", f"{tmp_path}/a", "--n-boot", "100", "--scaffolds", "C0", "C4"])
    neutral = json.loads((tmp_path / "a_report.json").read_text())
    assert len(neutral["cells"]) == 6 and all(c["cfr"] == 0 and c["masd"] == 0 and c["rate_disparity"] == 0 for c in neutral["cells"].values())
    assert len(neutral["fdr"]) == 6 * 2 * 5 and not any(v["reject"] for v in neutral["fdr"].values())
    cli.main(["run", "--profiles", split, "--out", f"{tmp_path}/b", "--n-boot", "100", "--scaffolds", "C0", "--bias", "black_female=-25"])
    biased = json.loads((tmp_path / "b_report.json").read_text())
    assert all(c["masd"] == 25 for c in biased["cells"].values()) and "25" in (tmp_path / "b_report.md").read_text()
    raw = [json.loads(x) for p in (tmp_path / "a_raw").glob("part-*") for x in p.read_text().splitlines()]
    assert len(raw) == 24 * 2 * 6
    trace = tmp_path / "trace"
    trace.mkdir()
    held = [r for r in raw if r["scaffold"] == "C0" and r["profile_id"] != "hiringp0"]
    (trace / "t.jsonl").write_text("\n".join(map(json.dumps, held)))
    cli.main(["report", "--profiles", split, "--raw", str(trace), "--model", "mock", "--out", f"{tmp_path}/c", "--n-boot", "50", "--scaffolds", "C0"])
    again = json.loads((tmp_path / "c_report.json").read_text())
    assert again["n_records"] == 24 * 6 and again["cells"]["hiring|C0|mock"]["cfr_sets"] == 7

    cli.main(["report", "--profiles", split, "--raw", f"{tmp_path}/b_raw", "--model", "mock", "--out", f"{tmp_path}/d", "--n-boot", "100", "--scaffolds", "C0"])
    assert json.loads((tmp_path / "d_report.json").read_text()) == biased  # what a run writes gives its report again

    q = stream.ingest(spark, str(trace), f"{tmp_path}/sink", f"{tmp_path}/check")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/sink").where("score is not null").count() == len(held)


def test_adapter_failures_give_empty_decisions(spark):
    prompts = spark.createDataFrame([("say yes", "{}"), ("break", "{}")], "prompt string, schema string")

    def make():
        def call(prompt, schema):
            if prompt == "break":
                raise RuntimeError
            return {"advance": True, "score": 7}

        return call

    got = {r.prompt: r.decision for r in adapters.decide(prompts, make, 2).collect()}
    assert json.loads(got["say yes"]) == {"advance": True, "score": 7} and got["break"] == "{}"


def test_workflow_blobs_pools_and_reports(spark, tmp_path):
    record = {"domain": "hiring", "scaffold": "C0", "profile_id": "p", "group": GROUPS[0], "name": "n", "decision": {"advance": True}}
    for i, blob in enumerate([{"result": {"records": [record]}}, {"records": [record, record]}]):
        (tmp_path / f"w{i}.json").write_text(json.dumps(blob, indent=1))
    rows = files.decisions(files.workflow_records(spark, f"{tmp_path}/w*.json")).collect()
    assert len(rows) == 3 and json.loads(rows[0].decision) == {"advance": True}
    (tmp_path / "pools.json").write_text(json.dumps({"cells": {"a": ["x", "y"], "b": []}}))
    assert {(r.group, r.pos, r.name) for r in files.name_pools(spark, f"{tmp_path}/pools.json").collect()} == {("a", 0, "x"), ("a", 1, "y"), ("b", None, None)}
    cell = {"model": "m", "domain": "hiring", "scaffold": "C0", "CFR": {"CFR": 0.1}, "MASD": {"MASD": 10}, "rate_disparity": {"disparity": 0.2}}
    (tmp_path / "x_report.json").write_text(json.dumps({"n_records": 6, "cells": {"k": cell}}))
    board = report.board(files.reports(spark, f"{tmp_path}/*_report.json"))
    assert board.first().composite_score == pytest.approx(0.8667) and "<td>m</td>" in report.board_html(board)


def test_names_by_seed_are_in_their_pools(spark):
    got = decisions.seeded_names(["a", "b"], S.NAMES)
    assert len(got) == 12 and all(n in S.NAMES[g] for _, g, n in got) and got == decisions.seeded_names(["a", "b"], S.NAMES)
    assert decisions.seeded_names(["a"], {}) == [("a", g, g) for g in GROUPS]


def test_bibtex(spark):
    rows = spark.createDataFrame([("k", "T", "A", 2020, "V", "arXiv:1", "u"), ("l", "T", "A", 2020, None, "doi:10.1/x", None)], "key string, title string, authors string, year int, venue string, id string, url string")
    a, b = (r.e for r in rows.select(textcheck.bibtex(*map(F.col, rows.columns)).alias("e")).collect())
    assert a.startswith("@misc{k,") and "eprint = {1}" in a and b.startswith("@article{l,") and "doi = {10.1/x}" in b and "journal" not in b


def test_last_record_of_a_trace_wins_by_file_and_line(spark, tmp_path):
    line = lambda i, score: json.dumps({"model": "m", "domain": "hiring", "scaffold": "C0", "profile_id": f"p{i}", "group": GROUPS[0], "name": "n", "decision": {"advance": True, "score": score}})
    (tmp_path / "b.jsonl").write_text(line(0, 2))  # shorter files come later in a task
    (tmp_path / "a.jsonl").write_text("\n".join([*(line(i, 1) for i in range(300)), *(line(i, 3) for i in range(1, 300))]))
    rows = decisions.trace(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.score for r in rows] == [1.0] * 300 + [3.0] * 299 + [2.0]
