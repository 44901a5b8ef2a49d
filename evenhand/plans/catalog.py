"""Registered queries: every operator applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scenarios as S
from ..functions import stats
from ..operators import anova, disparity, matched, panel, replay, resample, tests, textcheck
from ..schema import CELL, GROUPS
from ..shared import settled
from ..sources import decisions as D
from ..sources.mentions import mentions
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def _members(s: SparkSession, d: str) -> DataFrame:
    return matched.last_wins(D.from_lineitem(s, d))


def _summary(s: SparkSession, d: str) -> DataFrame:
    return matched.set_summary(_members(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return matched.reference_pairs(_members(s, d))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _wide(s: SparkSession, d: str) -> DataFrame:
    return anova.complete(D.varied(D.profiles(s, d)))


@query
def cfr_by_cell(s, d):
    return _rounded(disparity.flip_rate(_summary(s, d)), "cfr")


@query
def cfr_pairwise_ref(s, d):
    return _rounded(disparity.pairwise_flip(_pairs(s, d)), "flip_rate")


@query
def masd_by_cell(s, d):
    return _rounded(disparity.score_spread(_summary(s, d)), "masd")


@query
def masd_pairwise_ref(s, d):
    return _rounded(disparity.pairwise_difference(_pairs(s, d)), "mean_abs_diff")


@query
def action_rate_by_group(s, d):
    return _rounded(disparity.rates(D.from_lineitem(s, d)), "rate")


@query
def action_rate_disparity(s, d):
    return _rounded(disparity.disparity(disparity.rates(D.from_lineitem(s, d))), "disparity")


@query
def action_gap_vs_reference(s, d):
    return _rounded(disparity.gaps(disparity.rates(D.from_lineitem(s, d)), 1), "gap")


@query
def tool_rate_by_group(s, d):
    return _rounded(disparity.rates(D.from_lineitem(s, d), "tool_request"), "rate")


@query
def tool_disparity(s, d):
    return _rounded(disparity.disparity(disparity.rates(D.from_lineitem(s, d), "tool_request")), "disparity")


@query
def tool_gap_vs_reference(s, d):
    return _rounded(disparity.gaps(disparity.rates(D.from_lineitem(s, d), "tool_request"), -1), "gap")


@query
def matched_set_summary(s, d):
    return _summary(s, d)


@query
def last_wins_dedupe(s, d):
    return _members(s, d).drop("tool_request")


@query
def record_validity_counts(s, d):
    return disparity.validity(D.from_lineitem(s, d))


@query
def observed_groups(s, d):
    return D.from_lineitem(s, d).select("group").distinct()


@query
def mcnemar_exact(s, d):
    return _rounded(tests.mcnemar(_pairs(s, d)), "p")


@query
def average_rank_ties(s, d):
    return tests.average_ranks(_pairs(s, d))


@query
def tie_correction(s, d):
    return tests.average_ranks(_pairs(s, d)).groupBy(*CELL, "group").agg(F.sum("m").alias("n"), F.sum(F.expr("m * m * m - m")).alias("tie"))


@query
def wilcoxon_signed_rank(s, d):
    return _rounded(tests.wilcoxon(_pairs(s, d)), "z", "p")


def _tests(s, d):
    pairs = _pairs(s, d)
    one = lambda t, name: t.select(*CELL, F.lit(name).alias("test"), "group", "p")
    return one(tests.mcnemar(pairs), "mcnemar").union(one(tests.wilcoxon(pairs), "wilcoxon"))


_TIE = ["domain", "scaffold", "model", "test", "group"]


@query
def bh_fdr(s, d):
    return _rounded(tests.benjamini_hochberg(_tests(s, d), [], _TIE), "p", "q")


@query
def bh_elementwise_count(s, d):
    return tests.bh_elementwise(_tests(s, d), ["test"], _TIE)


@query
def top_contrasts(s, d):
    return _rounded(tests.benjamini_hochberg(_tests(s, d), [], _TIE).orderBy("q", "p", *_TIE).limit(25).select(*_TIE, "q"), "q")


@query
def cohens_h(s, d):
    rates = disparity.rates(D.from_lineitem(s, d))
    gap = disparity.gaps(rates, 1).join(rates, [*CELL, "group"])
    return _rounded(gap.select(*CELL, "group", stats.cohens_h(F.col("rate") + F.col("gap"), F.col("rate")).alias("h")), "h")


@query
def norm_cdf(s, d):
    return _rounded(_docs(s, d).select("doc_id", stats.norm_cdf((F.col("doc_id") % 121 - 60) / 10).alias("phi")), "phi", to=9)


@query
def norm_ppf(s, d):
    return _rounded(_docs(s, d).select("doc_id", stats.norm_ppf((F.col("doc_id") % 201) / 200).alias("x")), "x", to=9)


@query
def anova_two_way(s, d):
    return _rounded(_rounded(anova.two_way(_wide(s, d)), "ss_group", "ss_error", to=4), "f_group")


@query
def anova_f_pvalue(s, d):
    return _rounded(anova.with_p(anova.two_way(_wide(s, d))).select("domain", "scaffold", "f_group", "p_group"), "f_group", "p_group")


@query
def arity_observed_masd(s, d):
    return _rounded(anova.observed(_wide(s, d)), "obs")


@query
def arity_null(s, d):
    return resample.arity_null(settled(_wide(s, d)))


@query
def arity_observed_summary(s, d):
    rows = anova.observed(_wide(s, d)).agg(F.min("obs").alias("lowest"), F.max("obs").alias("highest"), F.avg("obs").alias("mean"), F.count_if(F.col("obs") > 3.5).alias("above"))
    return _rounded(rows, "lowest", "highest", "mean")


@query
def arity_naive_ratio(s, d):
    rows = panel.naive_ratios(_wide(s, d)).select(panel.cell_code(F.col("domain"), F.col("scaffold")).alias("cell"), "obs", "old_floor", "old_ratio")
    return _rounded(rows, "obs", "old_ratio")


@query
def arity_naive_summary(s, d):
    return _rounded(panel.ratio_summary(panel.naive_ratios(_wide(s, d)), "old_ratio"), "lowest", "highest", "mean")


@query
def arity_retest_ratio(s, d):
    base = D.profiles(s, d)
    floors = panel.retest_floors(D.varied(base), D.varied(base, "second"))
    rows = panel.naive_ratios(_wide(s, d), floors).select("domain", "scaffold", "obs", "old_floor", "old_ratio")
    return _rounded(rows, "obs", "old_floor", "old_ratio")


@query
def incomplete_profiles(s, d):
    rows = anova.incomplete(D.from_lineitem(s, d))
    return rows.select("domain", "scaffold", "profile_id", "n_known", F.array_join(F.sort_array("missing"), ",").alias("missing"))


@query
def anova_unbalanced(s, d):
    return _rounded(anova.with_p(anova.unbalanced(D.from_lineitem(s, d))), "ss_group", "ss_error", "f_group", "p_group")


@query
def label_mentions(s, d):
    """The words of the benchmark as labels: a table of fixed questions, not of the corpus."""
    words = s.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.expr(r"regexp_extract_all(text, '[a-z]{3,}', 0)")).alias("w")).distinct()
    rows = mentions(_docs(s, d).select("doc_id", "text"), [r.w for r in words.collect()], "text")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_labels"), F.sha2(F.array_join("found", ","), 256).alias("labels_sha256"))


@query
def arity_report(s, d):
    return panel.arity_report(_wide(s, d))


@query
def arity_summary(s, d):
    return panel.arity_summary(panel.arity_report(_wide(s, d)))


@query
def bootstrap_ci_distinct(s, d):
    return resample.bootstrap(resample.set_values(_summary(s, d), "cfr"))


@query
def bootstrap_ci_multiset(s, d):
    return resample.bootstrap(resample.set_values(_summary(s, d), "masd"), mode="multiset")


@query
def contrast_intervals(s, d):
    return resample.contrast_intervals(_members(s, d))


@query
def retest_reliability(s, d):
    base = D.profiles(s, d)
    return _rounded(replay.retest(D.varied(base), D.varied(base, "second"), ["domain", "scaffold"]), "agreement", "mae")


@query
def retest_overall(s, d):
    base = D.profiles(s, d)
    return _rounded(replay.retest(D.varied(base), D.varied(base, "second"), []), "agreement", "mae")


def _cells(s, d):
    summary, rates = _summary(s, d), disparity.disparity(disparity.rates(D.from_lineitem(s, d))).drop("n_groups")
    both = summary.groupBy(*CELL).agg(F.avg(F.when(F.col("n_act") >= 2, F.col("flip").cast("double"))).alias("cfr"), F.avg(F.when(F.col("n_score") >= 2, F.col("spread"))).alias("masd"))
    return both.join(rates, CELL)


@query
def scaffold_ladder(s, d):
    return _rounded(replay.ladder(_cells(s, d)), "mean_masd")


@query
def leaderboard(s, d):
    return replay.leaderboard(_cells(s, d))


@query
def report_cells(s, d):
    return _rounded(_cells(s, d), "cfr", "masd", "disparity")


@query
def cost_estimate(s, d):
    calls = _docs(s, d).agg((F.count(F.lit(1)) * len(GROUPS)).alias("n_calls"))
    models = s.createDataFrame([(m,) for m in ("claude-haiku-4-5", "claude-sonnet-4-6", "claude-opus-4-8", "unlisted")], "model string")
    plan = models.crossJoin(s.createDataFrame([(c,) for c, *_ in S.SCAFFOLDS], "scaffold string")).crossJoin(calls)  # 4 x 4 x 1 rows
    return replay.cost(plan)


@query
def counterfactual_grid(s, d):
    rows = D.grid(D.profiles(s, d).drop("content"), ("C0", "C2", "C3", "C4"))
    return rows.select("domain", "scaffold", "profile_id", "group", (F.col("doc_id") * 6 + F.col("group_ord")).alias("ord"))


@query
def prompt_build(s, d):
    rows = D.grid(S.with_domain(D.profiles(s, d))).withColumn("name", F.get("pool", (F.col("doc_id") % 5).cast("int")))
    return rows.select("profile_id", "scaffold", "group", F.sha2(S.prompt(), 256).alias("prompt_sha256"))


@query
def decision_schema(s, d):
    cells = D.profiles(s, d).select("domain").distinct()
    asked = S.with_domain(cells).crossJoin(F.broadcast(S.scaffolds(s, ("C0", "C2", "C3", "C4"))))  # the domains of the profiles, four scaffolds
    return asked.select("domain", "scaffold", S.decision_schema().alias("schema"))


#: Payloads by doc_id modulo 8: what adapters return, well-formed or not.
PAYLOADS = ['{"advance": true, "score": %d, "request_more_info": 1}', '{"advance": false, "score": "80.5"}', '{"advance": "false", "score": "n/a"}', "{}", '{"advance": null, "score": null}', '{"advance": [0], "score": true}', '{"advance": 0, "score": 3}', '{"advance": {"a": 1}, "score": [5], "request_more_info": ""}']


@query
def parse_decision(s, d):
    raw = F.replace(F.get(F.array(*map(F.lit, PAYLOADS)), (F.col("doc_id") % 8).cast("int")), F.lit("%d"), (F.col("doc_id") % 101).cast("string"))
    return _docs(s, d).select("doc_id", raw.alias("raw")).select("doc_id", *[c.alias(n) for n, c in S.parse(F.col("raw"), F.lit("advance"), F.lit("score")).items()])


@query
def mock_decision(s, d):
    return D.mock(D.profiles(s, d)).select("profile_id", "domain", "scaffold", "group", "score", "action")


@query
def planted_bias(s, d):
    rows = matched.set_summary(matched.last_wins(D.mock(D.profiles(s, d), bias={"black_female": -25})))
    both = disparity.flip_rate(rows).join(disparity.score_spread(rows).drop("n_sets"), CELL)
    return _rounded(both.select("domain", "scaffold", "cfr", "masd", "n_sets"), "cfr", "masd")


@query
def substring_bias(s, d):
    label = F.when(F.col("doc_id") % 2 == 0, F.initcap(panel.spaced(F.col("group"))))
    rows = D.mock(D.profiles(s, d), bias={"black_female": -25, "hispanic_male": 10}, name=F.coalesce(label, F.get("pool", (F.col("doc_id") % 5).cast("int"))), by_prompt=True)
    return rows.select("profile_id", "domain", "scaffold", "group", "name", "score", "action")


@query
def name_assignment_hash(s, d):
    return D.grid(D.profiles(s, d).drop("content"), ("C0",)).select("profile_id", "group", D.hashed_name().alias("name"))


def _runs(s, d):
    """The grid of all sets and groups, and two traces: the records whose action is known, then those whose score is."""
    rows = D.from_lineitem(s, d)
    cells = rows.select("domain", "scaffold", "profile_id").distinct().crossJoin(F.broadcast(D.groups(s).select("group")))
    runs = replay.union_runs(rows.where("action is not null"), rows.where("score is not null"))
    return cells, runs.withColumn("ord", F.col("source_ord").cast("long") * (1 << 60) + F.col("ord"))


@query
def replay_left_join(s, d):
    grid, raw = _runs(s, d)
    return replay.replay(grid.select(*replay.KEY), raw).select(*replay.KEY, "score", "action")


@query
def replay_missing_cells(s, d):
    grid, raw = _runs(s, d)
    return replay.missing(grid.select(*replay.KEY), raw)


@query
def union_runs(s, d):
    return _rounded(_runs(s, d)[1].groupBy("source_ord").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


@query
def content_hash(s, d):
    return _docs(s, d).select("doc_id", textcheck.short_hash(F.col("text")).alias("content_sha256_16"))


@query
def number_multiset_diff(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    edited = docs.withColumn("text", _first_edit())
    return textcheck.number_differences(docs, edited, "doc_id")


def _first_edit():
    """A 7 put in after the first a that a letter follows."""
    at = F.regexp_instr(F.col("text"), F.lit("a[a-z]"))
    return F.when(at > 0, F.concat(F.expr("left(text, regexp_instr(text, 'a[a-z]'))"), F.lit(" 7"), F.expr("substr(text, regexp_instr(text, 'a[a-z]') + 1)"))).otherwise(F.col("text"))


@query
def citation_set_diff(s, d):
    words = F.split(F.col("text"), " ", -1)
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    docs = _docs(s, d)
    first = docs.select("doc_id", F.concat(F.lit("\\cite{"), word(0), F.lit(", "), word(1), F.lit("} and \\cite{x}")).alias("text"))
    second = docs.select("doc_id", F.concat(F.lit("\\cite{"), word(1), F.lit(",y}")).alias("text"))
    return textcheck.citation_differences(first, second, "doc_id")


@query
def heading_strip(s, d):
    return _docs(s, d).select("doc_id", F.sha2(textcheck.without_heading(F.concat(F.lit("## "), "source", F.lit("\n\n"), "text")), 256).alias("body_sha256"))


@query
def dash_count(s, d):
    changed = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" -- ")), F.lit(". "), F.lit("---"))
    return _docs(s, d).select("doc_id", textcheck.dashes(changed).alias("n"))


@query
def word_count(s, d):
    return _docs(s, d).select("doc_id", textcheck.words(F.col("text")).alias("n_words"))


#: Payloads by doc_id modulo 4: the score under any domain's name, other numbers beside it.
SCORED = ['{"score": %d, "acuity": 9}', '{"acuity": 2, "apr_tier": %d}', '{"acuity": %d}', '{"approve": true, "apr_tier": "%d.5"}']


@query
def first_score_field(s, d):
    raw = F.replace(F.get(F.array(*map(F.lit, SCORED)), (F.col("doc_id") % 4).cast("int")), F.lit("%d"), (F.col("doc_id") % 101).cast("string"))
    return _docs(s, d).select("doc_id", panel.first_score(raw).alias("score"))


@query
def model_key_map(s, d):
    keys = F.array(*map(F.lit, ("haiku", "sonnet", "opus", "gpt-4o", "other")))
    rows = panel.pinned(_docs(s, d).select(F.get(keys, (F.col("doc_id") % 5).cast("int")).alias("model")))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query
def cell_labels(s, d):
    group = F.col("group")
    return D.from_lineitem(s, d).select(panel.cell_code(F.col("domain"), F.col("scaffold")).alias("cell"), "group", panel.dashed(group).alias("dashed"), panel.spaced(group).alias("spaced")).distinct()


@query
def c4_tool_table(s, d):
    return _rounded(panel.tool_cells(disparity.rates(D.from_lineitem(s, d), "tool_request")).select(*CELL, "disparity"), "disparity")


@query
def all_verified(s, d):
    records = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("verified"))
    return textcheck.all_verified(records, ["o_custkey"])


@query
def clean_gate(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    edited = docs.withColumn("text", F.when(F.length("text") % 2 == 1, _first_edit()).otherwise(F.col("text")))
    return textcheck.clean(docs, edited, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query
def contrast_details(s, d):
    rows = D.from_lineitem(s, d)
    return _rounded(disparity.details(rows, matched.reference_pairs(matched.last_wins(rows))), "flip_rate", "mean_abs_diff", "action_gap", "tool_gap", "z")
