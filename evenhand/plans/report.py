"""The whole report: cells, contrasts with corrected p-values, and its documents."""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scenarios as S
from ..operators import disparity, matched, panel, replay, resample, tests
from ..schema import CELL, REFERENCE, SEED

TEST_KEY = [*CELL, "test", "group"]


@dataclass
class Report:
    """Tidy frames: a row a cell, a row a (cell, group) with its rates, a row a test, a row a contrast with the reference, and
    the intervals of each contrast's effects."""

    cells: DataFrame
    groups: DataFrame
    contrasts: DataFrame
    n_records: int
    details: DataFrame
    effects: DataFrame


def build(decisions: DataFrame, n_boot: int = 2000, seed: int = SEED, mode: str = "distinct", family: tuple[str, ...] = ()) -> Report:
    """From decision records. The matched-set summary is kept, as all set metrics and intervals read it."""
    members = matched.last_wins(decisions)
    summary = matched.set_summary(members).persist()
    pairs = matched.reference_pairs(members)
    cells = disparity.flip_rate(summary).withColumnRenamed("n_sets", "cfr_sets").join(disparity.score_spread(summary).withColumnRenamed("n_sets", "masd_sets"), CELL)
    ci = resample.set_intervals(summary, n_boot, seed, mode)
    for metric in ("cfr", "masd"):
        of = ci.where(F.col("statistic") == metric).select(*CELL, *[F.col(c).alias(f"{metric}_{c}") for c in ("lo", "hi", "method", "z0", "a")])
        cells = cells.join(of, CELL, "left")
    action, tool = disparity.rates(decisions), disparity.rates(decisions, "tool_request")
    cells = cells.join(disparity.disparity(action).select(*CELL, F.col("disparity").alias("rate_disparity")), CELL, "left")
    cells = cells.join(disparity.disparity(tool).select(*CELL, F.col("disparity").alias("tool_disparity")), CELL, "left")
    key = [*CELL, "group"]
    groups = action.select(*key, F.col("rate").alias("action_rate")).join(tool.select(*key, F.col("rate").alias("tool_rate")), key, "left")
    one = lambda t, name: t.select(*CELL, F.lit(name).alias("test"), "group", "p")
    ps = one(tests.mcnemar(pairs), "mcnemar").union(one(tests.wilcoxon(pairs), "wilcoxon"))
    return Report(cells, groups, tests.benjamini_hochberg(ps, list(family), TEST_KEY), decisions.count(), disparity.details(decisions, pairs), resample.contrast_intervals(members, n_boot, seed))


def document(report: Report) -> dict:
    """The nested report; only aggregated rows, a few a cell, come to the driver."""
    name = lambda r: "|".join(r[c] for c in CELL)
    cells = {name(r): r.asDict() for r in report.cells.orderBy(*CELL).collect()}
    for r in report.groups.orderBy(*CELL, "group").collect():
        cells[name(r)].setdefault("rates", {})[r["group"]] = {"action": r.action_rate, "tool": r.tool_rate}
    for r in report.details.orderBy(*CELL, "group").collect():
        cells[name(r)].setdefault("contrasts", {})[r["group"]] = {k: v for k, v in r.asDict().items() if k not in (*CELL, "group")}
    for r in report.effects.orderBy(*CELL, "group", "metric").collect():
        own = cells[name(r)].setdefault("contrasts", {}).setdefault(r["group"], {})
        own.setdefault("effects", {})[r.metric] = {k: r[k] for k in ("point", "lo", "hi", "method")}
    fdr = {f"{name(r)}|{r.test}|{r['group']}": {"p": r.p, "q": r.q, "reject": r.reject} for r in report.contrasts.orderBy(*TEST_KEY).collect()}
    return {"reference_group": REFERENCE, "n_records": report.n_records, "cells": cells, "fdr": fdr}


def _number(x: float | None) -> str:
    return "—" if x is None or math.isnan(x) else f"{x:.3g}"


def _effects(doc: dict) -> list[str]:
    """A table of the contrasts' effects with their intervals; empty without any."""
    names = {"action_gap": "action gap", "tool_gap": "tool gap", "cohens_h": "Cohen's h"}
    rows = [(key, g, c["effects"]) for key, cell in doc["cells"].items() for g, c in sorted(cell.get("contrasts", {}).items()) if c.get("effects")]
    shown = lambda e: f"{_number(e['point'])} [{_number(e['lo'])}, {_number(e['hi'])}]" if e else "—"
    head = ["", f"| cell | group | {' | '.join(names.values())} |", "|-|-|-|-|-|"]
    return [*head, *[f"| {key} | {g} | {' | '.join(shown(e.get(n)) for n in names)} |" for key, g, e in rows]] if rows else []


def markdown(doc: dict) -> str:
    """Cell table, mean spread by scaffold, effects with intervals, and the contrasts that stay significant, 25 at most."""
    out = [f"# Summary\n\n{doc['n_records']} records, reference group {doc['reference_group']}.\n", "| cell | CFR | interval | MASD | interval | rate disparity | tool disparity |", "|-|-|-|-|-|-|-|"]
    by: dict[str, list[float]] = {}
    for key, c in doc["cells"].items():
        out.append(f"| {key} | {_number(c['cfr'])} | [{_number(c['cfr_lo'])}, {_number(c['cfr_hi'])}] | {_number(c['masd'])} | [{_number(c['masd_lo'])}, {_number(c['masd_hi'])}] | {_number(c['rate_disparity'])} | {_number(c['tool_disparity'])} |")
        if c["masd"] is not None:
            by.setdefault(c["scaffold"], []).append(c["masd"])
    out += ["", "Mean MASD by scaffold: " + ", ".join(f"{s} {_number(sum(v) / len(v))}" for s, v in sorted(by.items())) + ".", ""]
    kept = sorted((v["q"], k) for k, v in doc["fdr"].items() if v["reject"])
    out.append(f"{len(kept)} of {len(doc['fdr'])} contrasts are significant after correction.")
    return "\n".join([*out, *[f"- {k}: q = {_number(q)}" for q, k in kept[:25]], *_effects(doc), ""])


def write(doc: dict, path: str) -> None:
    Path(path).write_text(json.dumps(doc, indent=2, default=str) + "\n")
    Path(path).with_suffix(".md").write_text(markdown(doc))


def write_raw(decisions: DataFrame, path: str) -> None:
    """JSONL traces, one line a decision, written in parallel. The payload has its domain's field names, or is the recorded one."""
    dims = F.broadcast(S.domains(decisions.sparkSession).select("domain", "action_name", "score_name"))
    field = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit('"'), name, F.lit('":'), v.cast("string")))
    made = F.concat(F.lit("{"), F.concat_ws(",", field(F.col("action_name"), F.col("action")), field(F.col("score_name"), F.col("score")), field(F.lit(S.TOOL_FIELD), F.col("tool_request"))), F.lit("}"))
    payload = F.coalesce("raw", made) if "raw" in decisions.columns else made
    head = F.to_json(F.struct(*CELL, "profile_id", "group", "name"))
    line = F.concat(F.expr("substr(_head, 1, length(_head) - 1)"), F.lit(',"decision":'), F.coalesce("_payload", F.lit("{}")), F.lit("}"))
    decisions.join(dims, "domain", "left").select(head.alias("_head"), payload.alias("_payload")).select(line.alias("value")).write.mode("overwrite").text(path)


def summary(doc: dict) -> str:
    """A line a cell, for the console."""
    shown = lambda c: f"CFR={_number(c['cfr'])} MASD={_number(c['masd'])} [{_number(c['masd_lo'])}..{_number(c['masd_hi'])}] rate disparity={_number(c['rate_disparity'])}"
    return "\n".join(f"  {key:38s} {shown(c)}" for key, c in doc["cells"].items())


def tool_table(decisions: DataFrame) -> str:
    """Markdown: tool use by group, and its spread, of the cells whose scaffold offers the tool."""
    rows = panel.tool_cells(disparity.rates(decisions, "tool_request")).orderBy(*CELL).collect()  # a row a domain and model
    head = ["# Tool use by group", "", f"Reference group {REFERENCE}.", "", "| domain | model | rate by group | largest less smallest |", "|-|-|-|-|"]
    return "\n".join([*head, *[f"| {r.domain} | {r.model} | {r.rates} | {_number(r.disparity)} |" for r in rows], ""])


def reliability(first: DataFrame, second: DataFrame) -> str:
    """Markdown: agreement and score difference of two runs by cell and over all: the floor that spreads have to exceed."""
    by = ["domain", "scaffold"]
    rows = replay.retest(first, second, by).orderBy(*by).collect()
    every = replay.retest(first, second, []).first()
    head = ["# Test-retest reliability", "", "| domain | scaffold | decisions agree | mean score difference | pairs |", "|-|-|-|-|-|"]
    out = [*head, *[f"| {r.domain} | {r.scaffold} | {_number(r.agreement)} | {_number(r.mae)} | {r.n_pairs} |" for r in rows], ""]
    return "\n".join([*out, f"Over all: {_number(every.agreement)} of {every.n_pairs} decisions agree, scores differ by {_number(every.mae)}.", ""])


def write_arity(report: DataFrame, path: str) -> str:
    """The arity report as a JSON array, a record a cell; returns its table for the console."""
    report = report.orderBy("cell").persist()
    rows = [r.asDict() for r in report.collect()]
    s = panel.arity_summary(report).first()
    report.unpersist()
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    Path(path).write_text(json.dumps([{k: clean(v) for k, v in r.items()} for r in rows], indent=2) + "\n")
    names = ("obs", "old_floor", "old_ratio", "null_mean", "new_ratio", "p_arity", "f_group", "p_group")
    table = [f"{'cell':<10}" + "".join(f"{n:>10}" for n in names), *[f"{r['cell']:<10}" + "".join(f"{_number(r[n]):>10}" for n in names) for r in rows]]
    table += [f"{kind} ratio: {_number(s[f'{kind}_lowest'])} to {_number(s[f'{kind}_highest'])}, mean {_number(s[f'{kind}_mean'])}" for kind in ("old", "new")]
    counts = f"above the floor {s.above_floor}, matched p < 0.05 {s.arity_significant}, omnibus p < 0.05 {s.omnibus_significant}, after correction {s.omnibus_survive}, of {s.n_cells} cells"
    return "\n".join([*table, counts])


def board(reports: DataFrame) -> DataFrame:
    """(model, domain, scaffold, cfr, masd, disparity, n_records) of report files -> the leaderboard, with each model's records."""
    sizes = reports.groupBy("model").agg(F.max("n_records").alias("n_records"))
    return replay.leaderboard(reports).join(sizes, "model", "left")


def board_document(reports: DataFrame) -> dict:
    """The board's rows in order, each with its cells: a few numbers a model."""
    shown = [f"{r.model}" for r in reports.select("model").where("model is not null").distinct().orderBy("model").collect()]
    cells: dict[str, dict] = {m: {} for m in shown}
    for r in reports.where("model is not null").orderBy("cell").collect():
        cells[r.model][r.cell] = {"cfr": r.cfr, "masd": r.masd, "rate_disparity": r.disparity}
    rows = [{**r.asDict(), "reference_group": REFERENCE, "per_cell": cells.get(r.model, {})} for r in board(reports).orderBy("position").collect()]
    return {"note": "Lower CFR, MASD and disparity are fairer; a higher composite score is fairer.", "rows": rows}


def board_html(board: DataFrame, note: str = "") -> str:
    """The leaderboard page: a row a model."""
    names = ("position", "model", "composite_score", "mean_cfr", "mean_masd", "mean_rate_disparity", "n_records")
    shown = lambda v: "" if v is None else html.escape(str(v))
    rows = "".join("<tr>" + "".join(f"<td>{shown(r[n])}</td>" for n in names) + "</tr>" for r in board.orderBy("position").collect())
    heads = "".join(f"<th>{n.replace('_', ' ')}</th>" for n in names)
    return f"<!doctype html><meta charset=utf-8><title>Leaderboard</title><h1>Leaderboard</h1><p>{html.escape(note)}</p><table><tr>{heads}</tr>{rows}</table>\n"


def write_board(reports: DataFrame, path: str) -> None:
    """``path``.json and ``path``.html."""
    doc = board_document(reports)
    Path(f"{path}.json").write_text(json.dumps(doc, indent=2) + "\n")
    Path(f"{path}.html").write_text(board_html(board(reports), doc["note"]))


def tasks(named_grid: DataFrame) -> DataFrame:
    """The grid with ``name``, ``content`` and its domain's columns -> a row a task: key, fields, range of the score, prompt."""
    score = [F.col("score_range")[i].alias(n) for i, n in enumerate(("score_lo", "score_hi"))]
    return named_grid.select("domain", "scaffold", "profile_id", "group", "name", F.col("action_name").alias("action_field"), F.col("score_name").alias("score_field"), *score, S.prompt().alias("prompt"))


def write_lines(rows: DataFrame, path: str) -> None:
    """JSONL, written in parallel: tasks, profiles, records of references."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def profile_records(drafted: DataFrame) -> DataFrame:
    """(domain, profile) of a drafting run -> profiles under their domain's own name, with defaults and the content's hash."""
    field = lambda n: F.get_json_object("profile", f"$.{n}")
    content = field("content")
    return drafted.select(
        field("id").alias("id"), panel.mapped(F.col("domain"), panel.DOMAIN_KEYS).alias("domain"), F.coalesce(field("title"), F.lit("")).alias("title"), content.alias("content"),
        F.coalesce(field("difficulty"), F.lit("unknown")).alias("difficulty"), F.substring(F.sha2(content, 256), 1, 16).alias("content_sha256_16"),
    )


def write_pools(pools: DataFrame, path: str) -> None:
    """(group, pos, name) -> one JSON object of lists; a pool is a few names."""
    got: dict[str, list[str]] = {}
    for r in pools.orderBy("group", "pos").collect():
        got.setdefault(r["group"], []).extend([] if r["name"] is None else [r["name"]])
    Path(path).write_text(json.dumps(got, indent=2, ensure_ascii=False) + "\n")


def write_texts(entries: DataFrame, column: Column, path: str) -> None:
    """A text a row, written in parallel: bibliographies."""
    entries.select(column.alias("value")).write.mode("overwrite").text(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """(key, text) -> a folder of text for each known key, without its heading; others are left out, as are empty texts."""
    from ..operators import textcheck

    name = F.element_at(F.create_map(*[F.lit(x) for pair in panel.SECTION_FILES.items() for x in pair]), F.col("key"))
    rows = sections.where(F.length(F.trim("text")) > 0).select(name.alias("section"), textcheck.without_heading(F.col("text")).alias("value"))
    rows.where("section is not null").write.mode("overwrite").partitionBy("section").text(path)
