"""Panel runs: keys mapped to pinned names, labels, scores of any domain, tool use, and the arity report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scenarios as S
from ..schema import CELL, LEVEL
from ..shared import settled
from . import anova, replay, resample, tests

# Short model names and domains as runs give them, files of sections, noise floors of the paired retest.
MODEL_IDS = {"haiku": "claude-haiku-4-5", "sonnet": "claude-sonnet-4-6", "opus": "claude-opus-4-8"}
DOMAIN_KEYS = {"medical_triage": "triage", "triage": "triage", "hiring": "hiring", "lending": "lending"}
SECTION_FILES = {"related": "02_related", "bcf": "03_bcf", "design": "04_design", "harness": "05_harness", "impact": "07_impact", "limitations": "08_limitations", "ethics": "09_ethics", "repro": "10_repro"}
OLD_FLOORS = [
    ("hiring", "C0", 4.25), ("hiring", "C2", 3.58), ("hiring", "C3", 5.75),
    ("lending", "C0", 0.278), ("lending", "C2", 0.264), ("lending", "C3", 0.403),
    ("triage", "C0", 0.153), ("triage", "C2", 0.25), ("triage", "C3", 0.25),
]
SCORE_FIELDS = ("score", "apr_tier", "acuity")
TOOL_SCAFFOLD = "C4"


def mapped(key: Column, names: dict[str, str]) -> Column:
    """The name a key stands for; a key without one stands for itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


def cell_code(domain: Column, scaffold: Column) -> Column:
    return F.concat(F.substring(domain, 1, 3), F.lit("-"), scaffold)


def dashed(label: Column) -> Column:
    return F.replace(label, F.lit("_"), F.lit("-"))


def spaced(label: Column) -> Column:
    return F.lower(F.replace(label, F.lit("_"), F.lit(" ")))


def first_score(payload: Column, strict: bool = True) -> Column:
    """The number in the first of SCORE_FIELDS that the payload has, whatever its domain.

    With none of them the row is an error if ``strict``, and null otherwise; a field that is there but is no number is null.
    """
    v = F.try_parse_json(F.coalesce(payload, F.lit("{}")))
    got = F.coalesce(*[F.try_variant_get(v, f"$.{name}", "variant") for name in SCORE_FIELDS])
    if not strict:
        return S.number(got)
    return F.when(got.isNotNull(), S.number(got)).otherwise(F.raise_error(F.concat(F.lit("no score in "), F.coalesce(payload, F.lit("null")))).cast("double"))


def pinned(records: DataFrame, model: str | None = None) -> DataFrame:
    """Records of a run under pinned model ids: ``model`` for all of them, or each by its own."""
    return records.withColumn("model", mapped(F.lit(model) if model else F.col("model"), MODEL_IDS))


def tool_cells(rates: DataFrame) -> DataFrame:
    """(cell, group, rate) of tool use -> a row a cell of the scaffold that offers the tool: its spread, and rates by group as text."""
    own = rates.where(F.col("scaffold") == TOOL_SCAFFOLD)
    shown = F.transform(F.sort_array(F.collect_list(F.struct("group", "rate"))), lambda r: F.concat(dashed(r["group"]), F.lit(":"), F.format_number(r["rate"], 2)))
    return own.groupBy(*CELL).agg((F.max("rate") - F.min("rate")).alias("disparity"), F.array_join(shown, ", ").alias("rates"))  # a rate a group: a few


def retest_floors(first: DataFrame, second: DataFrame) -> DataFrame:
    """(domain, scaffold, old_floor): how far the scores of two runs of the same prompts lie apart on average."""
    cell = ["domain", "scaffold"]
    return replay.retest(first, second, cell).select(*cell, F.col("mae").alias("old_floor"))


def naive_ratios(wide: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Observed spread over the paired retest's floor, of the cells that have one above zero.

    ``floors`` comes from ``retest_floors``; without it, the floors published with the pilot run stand in.
    """
    if floors is None:
        floors = wide.sparkSession.createDataFrame(OLD_FLOORS, "domain string, scaffold string, old_floor double")
    floors = floors.where("old_floor > 0")
    return anova.observed(wide).join(floors, ["domain", "scaffold"]).withColumn("old_ratio", F.col("obs") / F.col("old_floor"))


def arity_report(wide: DataFrame, n_sim: int = 20_000, floors: DataFrame | None = None) -> DataFrame:
    """A row a cell: observed spread, both floors and ratios, p of the matched null, and the group effect's F and p.

    With ``floors`` of two runs every cell has a row, and no naive ratio where there is no floor; without, see ``naive_ratios``.
    ``wide`` is settled first, as each figure reads it anew.
    """
    wide = settled(wide)
    cell = ["domain", "scaffold"]
    null = resample.arity_null(wide, n_sim).select(*cell, "null_mean", F.col("ratio").alias("new_ratio"), "p_arity")
    omnibus = anova.with_p(anova.two_way(wide)).select(*cell, "f_group", "p_group")
    rows = naive_ratios(wide, floors)
    if floors is not None:
        rows = anova.observed(wide).join(rows.select(*cell, "old_floor", "old_ratio"), cell, "left")
    rows = rows.join(null, cell).join(omnibus, cell)
    return rows.select(cell_code(F.col("domain"), F.col("scaffold")).alias("cell"), "obs", "old_floor", "old_ratio", "null_mean", "new_ratio", "p_arity", "f_group", "p_group")


def ratio_summary(report: DataFrame, name: str) -> DataFrame:
    return report.agg(F.min(name).alias("lowest"), F.max(name).alias("highest"), F.avg(name).alias("mean"), F.count_if(F.col(name) > 1).alias("above_floor"), F.count(name).alias("n_cells"))


def arity_summary(report: DataFrame) -> DataFrame:
    """Range and mean of both ratios; how many cells are above the floor, and how many tests are significant.

    The report is settled first: a row a cell, which the counts and the ranked tests read without drawing it again.
    """
    report = settled(report)
    of = lambda name, p: [F.min(name).alias(f"{p}_lowest"), F.max(name).alias(f"{p}_highest"), F.avg(name).alias(f"{p}_mean")]
    known = ~F.isnan("p_group")
    counts = report.agg(
        *of("old_ratio", "old"), *of("new_ratio", "new"), F.count_if(F.col("new_ratio") > 1).alias("above_floor"),
        F.count_if(F.col("p_arity") < LEVEL).alias("arity_significant"), F.count_if(known & (F.col("p_group") < LEVEL)).alias("omnibus_significant"), F.count(F.lit(1)).alias("n_cells"),
    )
    kept = tests.bh_elementwise(report.select("cell", F.col("p_group").alias("p")), [], ["cell"]).select(F.col("n_survive").alias("omnibus_survive"))
    return counts.crossJoin(kept)  # a row each


def arity_bars(report: DataFrame) -> DataFrame:
    """Behind the bar figure: (cell, kind, ratio), both ratios of each cell."""
    return report.select("cell", F.explode(F.array(F.struct(F.lit("naive").alias("kind"), F.col("old_ratio").alias("ratio")), F.struct(F.lit("matched").alias("kind"), F.col("new_ratio").alias("ratio")))).alias("r")).select("cell", "r.*")


def arity_lines(report: DataFrame) -> DataFrame:
    """Behind the line figure: (domain, scaffold, ratio), the matched ratio by scaffold."""
    return report.select(F.substring("cell", 1, 3).alias("domain"), F.substring_index("cell", "-", -1).alias("scaffold"), F.col("new_ratio").alias("ratio"))
