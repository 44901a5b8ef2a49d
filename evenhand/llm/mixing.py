"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key. The key's leading digits cut every source into key ranges; per-range word counts, summed
up in order, say how many words lie before a range, and a window inside one range does the rest. So no task holds a
whole source, however large it is, and the word budget of a source is met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, cut, whole_text

#: Hex digits of the key that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, take ``weights`` in turn and divide ``share`` times all words; no target
    exceeds ``cap`` times its source, and what is above is divided anew by weight. With the sources ordered by cap for a
    unit of weight, the common level is the largest one that any prefix of capped sources leaves to the rest.
    Has one row a source, so its windows run over that many rows only.
    """
    every = Window.partitionBy()
    ordered = Window.orderBy("_per", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    return (
        sizes.withColumn("_w", F.get(turns, at % len(weights)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_per", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / left("_w"))
        .withColumn("_level", F.max("_level").over(every))
        .select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_level")).alias("target"))
    )


def mix(docs: DataFrame, carry: tuple[str, ...] = (), seed: str = "mix", **shares) -> DataFrame:
    """(doc_id, source, text, ...) -> one row a document: doc_id, source, size, source_size, target, before, epochs, taken.

    ``epochs`` whole passes over a source come first; of the pass that the budget ends in, the documents up to it in key
    order are taken, and the one that the budget falls into gives its first words only. ``taken`` counts words, repeats
    included. Empty tables give no row, null and empty texts have size 0 and give 0, null sources are a source of their
    own, and repeated rows are rows: of rows with one id, size and text any is like the other. Other columns are left out, but for those named in ``carry``.
    """
    tie = F.xxhash64(whole_text())
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), tie.cast("string")))  # rows without an id are spread by their texts
    keyed = docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"), n_words().alias("size"), tie.alias("_tie"), F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("_key"), *carry
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    slim = keyed if carry else (keyed := cut(keyed, "mix-keys"))
    ranges = cut(slim.groupBy("source", "_src", "_range").agg(F.sum("size").alias("_words")), "mix-ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("_words").alias("source_size")), **shares)
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .join(aims.withColumnRenamed("source", "_o"), F.col("source").eqNullSafe(F.col("_o")))
        .select(F.col("_src").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    )
    # dealt like the join: whole texts may travel with the rows, and they travel once
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return (
        keyed.join(starts, (F.col("_src") == F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select("doc_id", "source", "size", "source_size", "target", "before", "epochs", "part", "taken", *carry)
    )


def mixed_rows(docs: DataFrame, **shares) -> DataFrame:
    """``docs`` as the mix has them: a row for each time that a document is taken, the cut one with its first words only.

    Columns of ``docs`` stay as they are, ``n_chars``, if there, follows the text.
    """
    names = docs.columns
    carry = tuple(c for c in names if c not in ("doc_id", "source"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"[{BLANKS}]*{WORD}"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    whole = F.when(F.col("part") == F.col("size"), F.col("text")).when(F.col("part") > 0, first)
    out = (
        mix(docs, carry, **shares)
        .withColumn("_texts", F.concat(F.array_repeat("text", F.col("epochs").cast("int")), F.when((F.col("size") > 0) & (F.col("part") > 0), F.array(whole)).otherwise(F.array().cast("array<string>"))))
        .withColumn("text", F.explode("_texts"))
    )
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
