"""python -m evenhand.cli run | report | cost | board | arity | retest"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scenarios as S
from .operators import anova, panel, replay
from .plans import report
from .schema import GROUPS, SEED
from .sources import adapters, decisions, files, names


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("evenhand").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _profiles(spark: SparkSession, path: str) -> DataFrame:
    rows = files.profiles(spark, path)
    return rows.select(F.col("id").alias("profile_id"), "domain", "content", F.xxhash64("id").alias("doc_id"))


def _drawn(spark: SparkSession, args, pools: dict[str, list[str]] | None) -> DataFrame | None:
    """(profile_id, group, name) as a seeded loop over the file draws from given pools; None for the built-in ones, drawn by hash."""
    if pools is None:
        return None
    base = files.profiles(spark, args.profiles, ordered=True).select(F.col("id").alias("profile_id"), "line_no")
    return names.seeded(base, ["line_no"], pools, args.seed).groupBy("profile_id", "group").agg(F.min("name").alias("name"))


def _named(spark: SparkSession, grid: DataFrame, args, pools: dict[str, list[str]] | None) -> DataFrame:
    drawn = _drawn(spark, args, pools)
    return grid.withColumn("name", decisions.hashed_name(args.seed)) if drawn is None else grid.join(drawn, ["profile_id", "group"])


def _pools(spark: SparkSession, path: str | None) -> dict[str, list[str]] | None:
    """The name pools of a file, a few names a group; None stands for the built-in ones."""
    if path is None:
        return None
    pools: dict[str, list[str]] = {}
    for r in files.name_pools(spark, path).where("name is not null").orderBy("group", "pos").collect():
        pools.setdefault(r["group"], []).append(r["name"])
    return pools


def _bias(given: list[str]) -> dict[str, float]:
    """GROUP=DELTA pairs, or one JSON object."""
    if len(given) == 1 and given[0].lstrip().startswith("{"):
        return {g: float(d) for g, d in json.loads(given[0]).items()}
    return {g: float(d) for g, _, d in (b.partition("=") for b in given)}


def _asked(spark: SparkSession, args, pools) -> DataFrame:
    """Decisions of a chat server over the whole grid; those that ``out``_store has from an earlier run are not asked for again."""
    rows = _named(spark, decisions.grid(S.with_domain(_profiles(spark, args.profiles)), tuple(args.scaffolds), pools), args, pools)
    rows = rows.select(F.lit(args.model).alias("model"), *replay.KEY, "name", "action_name", "score_name", S.prompt().alias("prompt"), S.decision_schema().alias("schema"))
    store = adapters.Store(f"{args.out}_store", ["model", *replay.KEY])
    got = store.fill(rows, _server(args), args.parallel, in_flight=args.in_flight, retries=args.retries)
    return got.withColumns(S.parse(F.col("decision"), F.col("action_name"), F.col("score_name"))).withColumn("raw", F.col("decision")).drop("prompt", "schema", "action_name", "score_name", "decision", "error")


def _server(args):
    return adapters.chat_completions(args.model, args.base_url)


def _reported(made: DataFrame, args) -> None:
    doc = report.document(report.build(made, args.n_boot, args.seed, args.mode))
    report.write(doc, f"{args.out}_report.json")
    print(f"{doc['n_records']} decisions -> {args.out}_report.json\n{report.summary(doc)}")


def run(args) -> None:
    """Decisions of the whole grid, by the mock or a chat server, written as traces and reported."""
    spark = _session()
    pools = _pools(spark, args.names)
    if args.adapter == "chat":
        if not args.model:
            raise SystemExit("--adapter chat needs --model")
        report.write_raw(_asked(spark, args, pools), f"{args.out}_raw")
        return _replay(spark, args, f"{args.out}_raw", args.model)  # a server is asked once: the report reads the traces
    made = decisions.mock(_profiles(spark, args.profiles), tuple(args.scaffolds), _bias(args.bias), name=decisions.hashed_name(args.seed), by_prompt=args.bias_by_prompt, pools=pools, model=args.model or "mock", names=_drawn(spark, args, pools))
    made = made.withColumn("ord", F.xxhash64("profile_id", "scaffold", "group"))
    report.write_raw(made, f"{args.out}_raw")
    _reported(made, args)


def _replay(spark: SparkSession, args, raw: str, model: str) -> None:
    pools = _pools(spark, args.names)
    grid = _named(spark, decisions.grid(_profiles(spark, args.profiles).drop("content"), tuple(args.scaffolds), pools), args, pools).select(*replay.KEY, "name")
    held = replay.latest(decisions.trace(spark, raw, model).select(*replay.KEY, "ord", "score", "action", "tool_request"))
    full = grid.join(held, replay.KEY, "left").withColumn("model", F.lit(model)).withColumn("ord", F.coalesce("ord", F.lit(0)))
    _reported(full, args)


def replayed(args) -> None:
    """The expected grid with the decisions of a trace."""
    _replay(_session(), args, args.raw, args.model)


def cost(args) -> None:
    spark = _session()
    plan = [(m, s, args.n_profiles * args.n_groups) for m in args.models for s in args.scaffolds]
    replay.cost(spark.createDataFrame(plan, "model string, scaffold string, n_calls long")).orderBy("model").show(truncate=False)


def board(args) -> None:
    """The leaderboard of report files."""
    report.write_board(files.reports(_session(), args.reports), args.out)


def arity(args) -> None:
    """The arity-matched report of a trace."""
    spark = _session()
    read = lambda path: decisions.trace(spark, path, args.model).where(F.col("scaffold").isin("C0", "C2", "C3"))
    raw = read(args.raw)
    floors = panel.retest_floors(raw, read(args.retest)) if args.retest else None
    print(report.write_arity(panel.arity_report(anova.complete(raw), args.n_sim, floors), f"{args.out}.json"))
    left_out = anova.incomplete(raw).groupBy("domain", "scaffold").agg(F.count(F.lit(1)).alias("n")).orderBy("domain", "scaffold").collect()  # a row a cell
    print("\n".join(f"{r.domain} {r.scaffold}: {r.n} profiles left out, as they lack a group" for r in left_out) or "all profiles are complete")


def retest(args) -> None:
    """Test-retest reliability of two traces."""
    spark = _session()
    text = report.reliability(*[decisions.trace(spark, p, args.model) for p in args.raw])
    with open(f"{args.out}.md", "w") as f:
        f.write(text)
    print(text)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evenhand")
    verbs = parser.add_subparsers(required=True)
    for name, f in (("run", run), ("report", replayed), ("cost", cost)):
        p = verbs.add_parser(name)
        p.set_defaults(func=f)
        p.add_argument("--scaffolds", nargs="+", default=["C0", "C2", "C3"], choices=[s[0] for s in S.SCAFFOLDS])
        if name == "cost":
            p.add_argument("--models", nargs="+", default=[m for m, *_ in replay.PRICES])
            p.add_argument("--n-profiles", type=int, default=36)
            p.add_argument("--n-groups", type=int, default=len(GROUPS))
            continue
        p.add_argument("--profiles", required=True)
        p.add_argument("--names", help="JSON file of name pools; without it, the built-in ones")
        p.add_argument("--out", default="evenhand")
        p.add_argument("--seed", type=int, default=SEED)
        p.add_argument("--n-boot", type=int, default=2000)
        p.add_argument("--mode", choices=["distinct", "multiset"], default="distinct")
        if name == "run":
            p.add_argument("--adapter", choices=["mock", "chat"], default="mock")
            p.add_argument("--model")
            p.add_argument("--base-url")
            p.add_argument("--parallel", type=int, default=8, help="tasks that call the server at a time")
            p.add_argument("--in-flight", type=int, default=4, help="calls of a task at a time")
            p.add_argument("--retries", type=int, default=3)
            p.add_argument("--bias", nargs="*", default=[], metavar="GROUP=DELTA", help="or one JSON object")
            p.add_argument("--bias-by-prompt", action="store_true", help="move the scores of prompts that name the group")
        else:
            p.add_argument("--raw", required=True)
            p.add_argument("--model", required=True)
    p = verbs.add_parser("board")
    p.set_defaults(func=board)
    p.add_argument("--reports", required=True, help="path or pattern of report files")
    p.add_argument("--out", default="leaderboard")
    p = verbs.add_parser("arity")
    p.set_defaults(func=arity)
    p.add_argument("--raw", required=True)
    p.add_argument("--model")
    p.add_argument("--retest", help="a second trace of the same prompts, for the floor; without it, the pilot's published floors")
    p.add_argument("--n-sim", type=int, default=20_000)
    p.add_argument("--out", default="arity")
    p = verbs.add_parser("retest")
    p.set_defaults(func=retest)
    p.add_argument("--raw", nargs=2, required=True)
    p.add_argument("--model")
    p.add_argument("--out", default="reliability")
    args = parser.parse_args(argv)
    args.func(args)


if __name__ == "__main__":
    main()
