"""Asking a model so that a broken-off run can go on, and names as a seeded loop draws them."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from evenhand import cli
from evenhand.functions import scenarios as S
from evenhand.schema import GROUPS, SEED
from evenhand.sources import adapters, decisions, names


def prompts_of(spark, n, text="say {}"):
    return spark.createDataFrame([(f"p{i}", "g", text.format(i), '{"required": []}') for i in range(n)], "profile_id string, `group` string, prompt string, schema string")


def logging(path, fails=lambda prompt: False, dies=lambda prompt: False):
    """An adapter that notes each call in a file of its own name."""

    def make():
        def call(prompt, schema):
            with open(path, "a") as f:
                f.write(prompt + "\n")
            if dies(prompt):
                raise SystemExit("gone")  # takes the whole task with it, as a lost executor does
            if fails(prompt):
                raise RuntimeError("no answer")
            return {"score": int(prompt.split()[-1])}

        return call

    return make


def asked(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def test_a_run_that_is_broken_off_goes_on_where_it_was(spark, tmp_path):
    store, prompts = adapters.Store(f"{tmp_path}/store", ["profile_id", "group"]), prompts_of(spark, 40)
    dying = logging(f"{tmp_path}/first", dies=lambda p: p == "say 17")
    with pytest.raises(Exception, match="gone|SystemExit|exited|crashed"):
        store.fill(prompts, dying, parallel=1, wave=5)
    held = {r.profile_id for r in store.answers(spark).collect()}
    assert 0 < len(held) < 40 and "p17" not in held
    got = store.fill(prompts, logging(f"{tmp_path}/second"), parallel=2, wave=5).collect()
    assert sorted((int(r.profile_id[1:]), json.loads(r.decision)["score"], r.error) for r in got) == [(i, i, None) for i in range(40)]
    assert asked(tmp_path / "second") == sorted(f"say {i}" for i in range(40) if f"p{i}" not in held)
    store.fill(prompts, logging(f"{tmp_path}/third"))
    assert asked(tmp_path / "third") == []


def test_changed_prompts_and_failures_are_asked_again(spark, tmp_path):
    store = adapters.Store(f"{tmp_path}/store", ["profile_id", "group"])
    got = store.fill(prompts_of(spark, 6), logging(f"{tmp_path}/a", fails=lambda p: p == "say 3")).collect()
    assert {r.profile_id: r.decision for r in got}["p3"] == "{}" and [r.error for r in got if r.error] == ["RuntimeError: no answer"]
    got = store.fill(prompts_of(spark, 6), logging(f"{tmp_path}/b")).collect()
    assert asked(tmp_path / "b") == ["say 3"] and not [r for r in got if r.error or r.decision == "{}"]
    changed = prompts_of(spark, 6).withColumn("prompt", F.when(F.col("profile_id") == "p2", "say again 22").otherwise(F.col("prompt")))
    got = {r.profile_id: json.loads(r.decision)["score"] for r in store.fill(changed.unionByName(changed), logging(f"{tmp_path}/c")).collect()}
    assert asked(tmp_path / "c") == ["say again 22"] and got["p2"] == 22 and got["p5"] == 5
    assert adapters.Store(f"{tmp_path}/none", ["profile_id"]).fill(prompts_of(spark, 3).limit(0), logging(f"{tmp_path}/d")).count() == 0


def test_calls_are_made_again_and_at_the_same_time(spark, tmp_path):
    def flaky():
        seen, lock, both = {}, threading.Lock(), threading.Barrier(2, timeout=20)

        def call(prompt, schema):
            with lock:
                seen[prompt] = seen.get(prompt, 0) + 1
                times = seen[prompt]
            if times == 1:
                both.wait()  # passes only if two calls are under way
                raise OSError("busy")
            if prompt == "say 1":
                raise OSError("busy")
            return {"times": times}

        return call

    got = {r.prompt: (r.decision, r.error) for r in adapters.ask(prompts_of(spark, 2), flaky, parallel=1, in_flight=2, retries=2, wait=0.01).collect()}
    assert got == {"say 0": ('{"times": 2}', None), "say 1": ("{}", "OSError: busy")}


@pytest.mark.parametrize(("sizes", "n"), [((5,) * 6, 700), ((1, 5, 0, 8, 9, 33), 700), ((0,) * 6, 3), ((2, 0, 0, 0, 0, 0), 1), ((5,) * 6, 0)])
def test_names_are_those_of_a_seeded_loop(spark, sizes, n):
    pools = {g: [f"{g}{i}" for i in range(k)] for g, k in zip(GROUPS, sizes, strict=True)}
    ids = [f"p{i}" for i in range(n)]
    draw = random.Random(SEED)
    want = {(i, g): draw.choice(pools[g]) if pools[g] else g for i in ids for g in GROUPS}
    base = spark.createDataFrame(list(enumerate(ids)), "line_no int, profile_id string")
    got = names.seeded(base.repartition(7), ["line_no"], pools, words=256).collect()
    assert {(r.profile_id, r["group"]): r.name for r in got} == want and len(got) == len(want)


def test_the_command_line_draws_names_in_file_order_and_asks_once(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"id": f"q{i}", "domain": ("hiring", "lending", "triage")[i % 3], "content": f"Text {i}."}) for i in range(4)]
    (tmp_path / "profiles.jsonl").write_text("\n".join([lines[0], "", *lines[1:]]))
    (tmp_path / "pools.json").write_text(json.dumps({"cells": S.NAMES}))
    want = {(i, g): n for i, g, n in decisions.seeded_names([f"q{i}" for i in range(4)], S.NAMES, 11)}
    args = ["--profiles", f"{tmp_path}/profiles.jsonl", "--names", f"{tmp_path}/pools.json", "--scaffolds", "C0", "--seed", "11", "--n-boot", "20", "--out", f"{tmp_path}/out"]
    drawn = lambda: {(r.profile_id, r["group"]): r.name for r in decisions.trace(spark, f"{tmp_path}/out_raw").collect()}
    cli.main(["run", *args])
    assert drawn() == want

    def server(args):
        def make():
            def call(prompt, schema):
                with open(f"{tmp_path}/calls", "a") as f:
                    f.write("x")
                return {schema["required"][0]: True, schema["required"][1]: 3}

            return call

        return make

    monkeypatch.setattr(cli, "_server", server)
    for _ in range(2):
        cli.main(["run", *args, "--adapter", "chat", "--model", "m"])
        assert drawn() == want and (tmp_path / "calls").read_text() == "x" * 24
    assert json.loads((tmp_path / "out_report.json").read_text())["n_records"] == 24
