"""Scans of profile splits, name pools, workflow results, reports, drafts and tables of references."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROFILE


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: for small JSON documents whose shape differs."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def profiles(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """JSONL profiles with their defaults; blank lines are skipped. ``ordered`` adds ``line_no``, for small splits."""
    if ordered:
        lines = _whole(spark, path).select(F.posexplode(F.split("value", "\n", -1)).alias("line_no", "value"))
    else:
        lines = spark.read.text(path)
    rows = lines.where(F.length(F.trim("value")) > 0).withColumn("p", F.from_json("value", PROFILE))
    extra = ["line_no"] if ordered else []
    return rows.select(*extra, "p.id", "p.domain", F.coalesce("p.title", F.lit("")).alias("title"), "p.content", F.coalesce("p.difficulty", F.lit("unknown")).alias("difficulty"), "p.content_sha256_16")


def altered(split: DataFrame) -> DataFrame:
    """Profiles whose stored hash isn't that of their content."""
    return split.where(F.col("content_sha256_16").isNotNull() & (F.col("content_sha256_16") != F.substring(F.sha2("content", 256), 1, 16)))


def name_pools(spark: SparkSession, path: str) -> DataFrame:
    """(group, pos, name) from {group: [name]}, bare or under ``cells``."""
    whole = _whole(spark, path).select(F.coalesce(F.get_json_object("value", "$.cells"), F.col("value")).alias("v"))
    pools = whole.select(F.explode(F.from_json("v", "map<string,array<string>>")).alias("group", "pool"))
    return pools.select("group", F.posexplode_outer("pool").alias("pos", "name"))


def workflow_records(spark: SparkSession, path: str, where: str = "records") -> DataFrame:
    """Records of {result: {...}} or of the inner object; each stays JSON text."""
    inner = F.coalesce(F.get_json_object("value", f"$.result.{where}"), F.get_json_object("value", f"$.{where}"))
    return _whole(spark, path).select("file", F.posexplode(F.from_json(inner, "array<string>")).alias("pos", "record"))


def decisions(records: DataFrame) -> DataFrame:
    """The fields of workflow records; the payload stays text."""
    field = lambda n: F.get_json_object("record", f"$.{n}").alias(n)
    return records.select("pos", *[field(n) for n in ("domain", "scaffold", "profile_id", "group", "name", "decision")])


def drafted_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The nested profiles[].profiles[] of a drafting run."""
    outer = workflow_records(spark, path, "profiles")
    return outer.select("pos", F.get_json_object("record", "$.domain").alias("domain"), F.posexplode(F.from_json(F.get_json_object("record", "$.profiles"), "array<string>")).alias("inner_pos", "profile"))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Drafted sections: key and text; those without text fall away."""
    rows = workflow_records(spark, path, "sections")
    text: Column = F.coalesce(F.get_json_object("record", "$.markdown"), F.get_json_object("record", "$.text"))
    return rows.select(F.get_json_object("record", "$.key").alias("key"), text.alias("text")).where(F.length(F.trim("text")) > 0)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Cells of report files, nested or flat: one row a (file, cell), with the numbers that the leaderboard needs."""
    whole = _whole(spark, path).select("file", F.get_json_object("value", "$.n_records").cast("long").alias("n_records"), F.explode(F.from_json(F.get_json_object("value", "$.cells"), "map<string,string>")).alias("cell", "c"))
    at = lambda p, kind, n: F.get_json_object("c", f"$.{p}").cast(kind).alias(n)
    either = lambda p, flat, n: F.coalesce(*[F.get_json_object("c", f"$.{x}").try_cast("double") for x in (p, flat)]).alias(n)
    return whole.select("file", "n_records", "cell", at("model", "string", "model"), at("domain", "string", "domain"), at("scaffold", "string", "scaffold"), either("CFR.CFR", "cfr", "cfr"), either("MASD.MASD", "masd", "masd"), either("rate_disparity.disparity", "rate_disparity", "disparity"))


def arity_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("cell string, obs double, old_floor double, old_ratio double, null_mean double, new_ratio double, p_arity double, F_group double, p_group double").json(path)


def committed(spark: SparkSession, repository: str, files: dict[str, str], ref: str = "HEAD") -> DataFrame:
    """(key, text) of files as a commit holds them; a file that it lacks has an empty text. For a few documents: git runs on the driver."""
    show = lambda path: subprocess.run(["git", "show", f"{ref}:{path}"], cwd=repository, capture_output=True, text=True)
    got = {key: show(path) for key, path in files.items()}
    return spark.createDataFrame([(k, r.stdout if r.returncode == 0 else "") for k, r in got.items()], "key string, text string")
