"""Decision records from plain tables: deterministic mappings, traces and the full evaluation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scenarios as S
from ..schema import GROUPS, SEED, TRACE


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomplete, duplicated and null-bearing records: one a line item."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    step = F.floor(key / 3) % 4
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + line).alias("ord"),
        _pick(("hiring", "lending", "triage"), key % 3).alias("domain"),
        _pick(("C0", "C2", "C3", "C4"), step).alias("scaffold"),
        F.concat(F.lit("m"), (F.floor(key / 12) % 2).cast("string")).alias("model"),
        key.cast("string").alias("profile_id"),
        _pick((GROUPS[5], *GROUPS[:5]), line % 6).alias("group"),
        F.when(F.col("l_tax") != 0, F.col("l_discount") >= 0.05).alias("action"),
        F.when(F.col("l_tax") < 0.08, F.when(key % 3 == 0, F.col("l_quantity") * 2).otherwise(F.col("l_quantity") % 5 + 1)).alias("score"),
        F.when(step == 3, F.col("l_returnflag") == "R").alias("tool_request"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, domain, content) of the documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("profile_id"), _pick(("hiring", "lending", "triage"), F.col("doc_id") % 3).alias("domain"), F.col("text").alias("content"), "doc_id")


def groups(spark: SparkSession, pools: dict[str, list[str]] | None = None) -> DataFrame:
    pools = S.NAMES if pools is None else pools
    return spark.createDataFrame([(i, g, pools.get(g, [])) for i, g in enumerate(GROUPS)], "group_ord int, `group` string, pool array<string>")


def grid(base: DataFrame, codes: tuple[str, ...] = ("C0", "C2", "C3"), pools: dict[str, list[str]] | None = None) -> DataFrame:
    """Each profile with every scaffold and group. Both are fixed tables of a few rows, sent to all tasks."""
    spark = base.sparkSession
    return base.crossJoin(F.broadcast(S.scaffolds(spark, codes))).crossJoin(F.broadcast(groups(spark, pools)))


def hashed_name(seed: int = SEED) -> Column:
    """A name for (profile, group) that depends on neither order nor partitions; the group's label where its pool is empty."""
    at = F.pmod(F.xxhash64(F.lit(seed), "profile_id", "group"), F.greatest(F.size("pool"), F.lit(1))).cast("int")
    return F.coalesce(F.get("pool", at), F.col("group"))


def seeded_names(ids: list[str], pools: dict[str, list[str]], seed: int = SEED) -> list[tuple[str, str, str]]:
    """(profile, group, name) drawn one after the other in file order; for small fixed splits."""
    import random

    draw = random.Random(seed)
    return [(i, g, draw.choice(pools[g]) if pools.get(g) else g) for i in ids for g in GROUPS]


def mock(
    base: DataFrame, codes: tuple[str, ...] = ("C0", "C2", "C3"), bias: dict[str, float] | None = None, threshold: float = 50.0,
    name: Column | None = None, by_prompt: bool = False, pools: dict[str, list[str]] | None = None, model: str = "mock", names: DataFrame | None = None,
    effect: Column | None = None,
) -> DataFrame:
    """Mock decisions of the whole grid. The text is hashed once a profile, before the grid multiplies its rows.

    ``bias`` moves the scores of a group; with ``by_prompt``, of every prompt that has the group's label in it, with blanks
    or underscores. A body is searched once a profile, and a row of the grid adds what stands before it. Names are those of
    ``names`` (profile_id, group, name) if it is given, else the column ``name``, else drawn by hash. ``effect`` is added to the
    score too: any expression of profile_id, domain, scaffold, group, name and the neutral score ``base``; null adds nothing.
    """
    bias = bias or {}
    body = S.prompt_body()
    longest = max(map(len, bias), default=0)
    within = lambda text, g: F.contains(text, F.lit(g.replace("_", " "))) | F.contains(text, F.lit(g))
    found = [within(F.lower(body), g).alias(f"_in{i}") for i, g in enumerate(bias)] if by_prompt else []
    head = ["subject", "task", F.lower(F.substring(body, 1, longest)).alias("_start")] if by_prompt else []
    scored = S.with_domain(base).select("profile_id", "domain", "doc_id", S.mock_score(body).alias("base"), *found, *head)
    out = grid(scored, codes, pools)
    out = out.withColumn("name", hashed_name() if name is None else name) if names is None else out.join(names, ["profile_id", "group"])
    if by_prompt:
        out = out.withColumn("_head", F.concat(F.lower(S.prompt_head()), "_start"))
    delta = F.lit(0.0)
    for i, (group, d) in enumerate(bias.items()):
        hit = F.col(f"_in{i}") | within(F.col("_head"), group) if by_prompt else F.col("group") == group
        delta = delta + F.when(hit, F.lit(float(d))).otherwise(0.0)
    if effect is not None:
        delta = delta + F.coalesce(effect.cast("double"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base") + delta))
    out = out.withColumn("score", score).withColumn("model", F.lit(model))
    return out.select("profile_id", "domain", "scaffold", "model", "group", "name", (F.col("score") >= threshold).alias("action"), "score", F.when(F.col("has_tool"), F.lit(False)).alias("tool_request"), (F.col("doc_id") * 6 + F.col("group_ord")).alias("ord"))


def varied(base: DataFrame, salt: str = "first", codes: tuple[str, ...] = ("C0", "C2", "C3")) -> DataFrame:
    """Decisions that differ by profile, scaffold and group: the hash of the text is hashed again with them."""
    own = base.select("profile_id", "domain", F.sha2("content", 256).alias("digest"))
    x = 30 + S.hex_mod(F.sha2(F.concat_ws("|", F.lit(salt), "scaffold", "group", "digest"), 256), 50) / 10 + S.hex_mod(F.col("digest"), 40)
    return grid(own, codes).withColumn("score", x.cast("double")).withColumn("action", F.col("score") >= 50.0).select("profile_id", "domain", "scaffold", "group", "score", "action")


def trace(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """JSONL traces; the payload stays text for ``parse``. ``ord`` follows file names, then the order of lines in a file.

    Spark packs pieces of files into tasks by size, so a row's running number alone says nothing about the order. A piece
    that others follow in its file fills a task, and a line has two bytes or more: its start and the running number add up.
    """
    rows = spark.read.schema(TRACE).json(path)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/// and file:/ are one
    names = spark.createDataFrame([*enumerate(sorted(rows.inputFiles()))], "_file int, _name string").withColumn("_name", plain("_name"))  # a row a file
    place = F.col("_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_place", place)
    rows = rows if model is None else rows.where(F.col("model") == model)
    dims = F.broadcast(S.domains(spark).select("domain", "action_name", "score_name"))
    rows = rows.join(names, plain("_path") == F.col("_name"), "left").join(dims, "domain", "left").withColumn("ord", F.coalesce("_file", F.lit(0)).cast("long") * (1 << 44) + F.col("_place"))
    return rows.withColumns(S.parse(F.col("decision"), F.col("action_name"), F.col("score_name"))).select("ord", "domain", "scaffold", "model", "profile_id", "group", "name", "action", "score", "tool_request", F.col("decision").alias("raw"))
