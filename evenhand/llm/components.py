"""Connected components of link tables, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Links between numbered nodes -> (node, component), the component being its smallest node.

    Alternates large-star and small-star steps until the links no longer change, so chains shorten by half a step or more. A
    node of very many links is joined, never gathered, so a skewed join may split it. Self-links and nulls fall away;
    nodes without links are not in the result, no links give no rows.
    """
    edges = cut(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        lowest = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(lowest, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select(F.col("x").alias("u"), F.col("m").alias("v")))
        before, edges = edges, cut(small.where("u <> v").distinct(), "small-star")
        drop(before, large)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v")).distinct()


def grown(comps: DataFrame | None, links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Components (node, component), or None, with further links -> the components of all.

    Links between nodes that are known lead from component to component, so the links that made these are not walked again.
    """
    if comps is None:
        return connected_components(links, u, v)
    of = lambda to: comps.select(F.col("node").alias(f"_{to}"), F.col("component").alias(f"_{to}_comp"))
    between = links.select(F.col(u).alias("u"), F.col(v).alias("v")).join(of("u"), F.col("u") == F.col("_u"), "left").join(of("v"), F.col("v") == F.col("_v"), "left")
    merged = connected_components(between.select(F.coalesce("_u_comp", "u").alias("u"), F.coalesce("_v_comp", "v").alias("v")))
    known = comps.join(merged.select(F.col("node").alias("_n"), F.col("component").alias("_m")), F.col("component") == F.col("_n"), "left")
    new = merged.join(comps.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return known.select("node", F.coalesce("_m", "component").alias("component")).union(new)
