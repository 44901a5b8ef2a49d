"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest on which URLs and rules are joined, before the whole digests are compared.
SHORT = 8
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The expressions of a URL that a rule of one of ``shapes`` (labels of its host, characters of its path) can equal."""
    labels = F.split(host, r"\.", -1)
    return F.filter(
        F.array(*[F.when((F.size(labels) >= n) & (F.length(path) >= m) & (host != ""), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, m))) for n, m in shapes]),
        lambda x: x.isNotNull(),
    )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url, ...), rules (host, path, verdict) -> page_id, host, path, rule, verdict.

    A rule fits its host and its subdomains if the URL's path starts with the rule's. The longest expression wins, then
    block before allow; without a fitting rule ``rule`` is null and the verdict is allow. Each distinct URL is expanded
    once, joined to the rules on short digest prefixes, and confirmed on full digests, so a very common URL or host costs
    one row. Null URLs and those without ``://`` have empty host and path and no rule. Repeated rows stay, no pages give
    no rows, no rules give allow; other columns are left out. The number of expressions a URL has depends on the shapes
    that rules have (how many labels, how long a path), and not on how many rules there are.
    """
    listed = rules.select(ascii_lower(F.col("host")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")).where("_h <> ''")
    listed = listed.withColumn("_rule", F.concat("_h", "_p"))
    shapes = [tuple(r) for r in listed.select(F.size(F.split("_h", r"\.", -1)), F.length("_p")).distinct().collect()]
    keyed = listed.select("_rule", "_v", F.sha2("_rule", 256).alias("_digest")).withColumn("_short", F.substring("_digest", 1, SHORT))
    own = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not shapes:
        return own.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))
    # where host and path are the same, so is the verdict
    asked = own.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shapes))).alias("_e"))
    asked = asked.withColumn("_full", F.sha2("_e", 256)).withColumn("_start", F.substring("_full", 1, SHORT))
    fits = asked.join(keyed, F.col("_start") == F.col("_short")).where("_full = _digest")
    found = fits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max(F.struct(F.length("_rule").alias("n"), (F.col("_v") == "block").alias("b"), F.col("_rule").alias("rule"), F.col("_v").alias("verdict"))).alias("_best"))
    return own.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
