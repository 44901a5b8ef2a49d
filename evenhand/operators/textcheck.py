"""Checks on texts: numbers and citations that an edit must not change, headings, dashes, words, hashes, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
CITE = r"\\cite\{([^}]+)\}"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def citations(text: Column) -> Column:
    """Distinct keys of all citation lists."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITE), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k)))))


def number_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, text) twice -> numbers that one has more often than the other."""
    count = lambda d, n: d.select(key, F.explode(numbers(F.col("text"))).alias("number")).groupBy(key, "number").agg(F.count(F.lit(1)).alias(n))
    both = count(first, "n1").join(count(second, "n2"), [key, "number"], "full").na.fill(0, ["n1", "n2"])
    return both.where("n1 <> n2").select(key, "number", F.greatest(F.col("n1") - F.col("n2"), F.lit(0)).alias("lost"), F.greatest(F.col("n2") - F.col("n1"), F.lit(0)).alias("gained"))


def citation_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    a = first.select(key, citations(F.col("text")).alias("a"))
    b = second.select(F.col(key).alias("_k"), citations(F.col("text")).alias("b"))
    both = a.join(b, F.col(key) == F.col("_k"), "left")
    return both.select(key, F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))).alias("lost"), F.size(F.array_except(F.coalesce("b", F.array().cast("array<string>")), "a")).alias("gained"), F.col("b").isNull().alias("unmatched"))


def without_heading(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^##\s+[^\n]+\n+", "")


def dashes(text: Column) -> Column:
    return F.size(F.split(text, "---", -1)) - 1 + F.size(F.split(text, " -- ", -1)) - 1


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s]+"))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bibtex(key: Column, title: Column, authors: Column, year: Column, venue: Column, ident: Column, url: Column) -> Column:
    """An entry whose type and fields follow from how its identifier starts."""
    low = F.lower(ident)
    arxiv, doi = low.startswith("arxiv"), low.startswith("doi") | low.startswith("10.")
    field = lambda name, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {name} = {{"), v, F.lit("}")))
    extra = F.when(arxiv, field("eprint", F.regexp_replace(ident, r"(?i)^arxiv:\s*", ""))).when(doi, field("doi", F.regexp_replace(ident, r"(?i)^doi:\s*", "")))
    kind = F.when(doi, "article").otherwise("misc")
    fields = F.concat_ws(",\n", field("title", title), field("author", authors), field("year", year.cast("string")), field("journal", venue), extra, field("url", url))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), fields, F.lit("\n}\n"))


def all_verified(records: DataFrame, by: list[str], flag: str = "verified") -> DataFrame:
    """Whether all records of a key are verified; an unknown flag counts as no."""
    return records.groupBy(*by).agg(F.bool_and(F.coalesce(F.col(flag), F.lit(False))).alias("all_verified"))


def clean(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of (key, text) ``second`` that may be written: the first has a text, and no number or citation differs from it."""
    known = first.where(F.col("text") != "").select(key)
    cites = citation_differences(first, second, key).where("lost > 0 or gained > 0").select(key)
    return second.join(known, key, "left_semi").join(number_differences(first, second, key).select(key), key, "left_anti").join(cites, key, "left_anti")
