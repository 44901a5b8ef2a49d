"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

All shingles of a text are hashed once. The leading bits of a hash name its bin, the least hash of a bin is its value.
Empty bins are filled by optimal densification: bin i asks the bins h(i, 1), h(i, 2), ... until one has a value, so that two
texts that fill the same bins fill the empty ones alike. Of each value the low bits are kept, and the share of
equal bins is corrected by what chance makes equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, whole_text

#: Fixed by the layout: 128 bins, from the 7 leading bits; 8 low bits of each are stored, as two hex digits.
BIN_BITS, BINS, LOW_BITS = 7, 128, 8
SHINGLE = 5
#: Probes before the rest of a bin's probe order is compared at once.
PROBES = 6
#: Documents in an id range, and the most ranges (their first ids are broadcast: 16 bytes each).
RANGE_ROWS, MOST_RANGES = 512, 4096

_LAST = (1 << (64 - BIN_BITS)) - 1  # no bin's value but by a chance of 2**-57: stands for an empty bin


def _bin(x: Column) -> Column:
    """Place of a hash's bin in signed order."""
    return F.shiftrightunsigned(x, 64 - BIN_BITS).bitwiseXOR(F.lit(BINS // 2).cast("long")).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though it is named often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bins(text: Column) -> Column:
    """Array of 128 low-order values, or an empty array for a text without words.

    Shingles are five words, A-Z lower-cased; a text of fewer words is one shingle.
    """
    words = F.filter(F.split(ascii_lower(text), f"[{BLANKS}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def slots(m: Column) -> Column:
        empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(m, _bin))
        marks = F.transform(empty, lambda e: F.shiftleft(e.bitwiseXOR(F.lit(BINS // 2)).cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_LAST)))
        return F.array_sort(F.concat(m, marks))

    def dense(m: Column, s: Column) -> Column:
        value = lambda x: F.when(x.bitwiseAND(F.lit(_LAST)) != F.lit(_LAST), x)
        probe = lambda i, j: value(F.get(s, F.xxhash64(i, F.lit(j)).bitwiseAND(F.lit(BINS - 1)).cast("int")))
        rest = lambda i: F.array_min(F.transform(m, lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("o"), y.alias("y"))))["y"]
        return F.transform(s, lambda x, i: F.coalesce(value(x), *[probe(i, j) for j in range(PROBES)], rest(i)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))

    return _let(
        hashed,
        lambda h: _let(F.array_sort(shingles(h)), lambda s: _let(least(s), lambda m: F.when(F.size(m) > 0, _let(slots(m), lambda t: dense(m, t))).otherwise(F.array().cast("array<int>")))),
    )


def packed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), LOW_BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share m of equal bins gives (m - C) / (1 - C) with C = 2**-8, at least 0.

    Two texts without words are alike (1), one without words is like no other (0).
    """
    chance = 2.0**-LOW_BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def _place(key: Column, marks: list[int]) -> Column:
    """How many of the sorted ``marks`` are at most ``key``, by halving."""
    if not marks:
        return F.lit(0)
    table = F.array(*[F.lit(int(m)).cast("long") for m in marks])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(table, middle) <= key)
        return F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(marks)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(marks).bit_length())), start, halve)["lo"]


def with_next(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``next``: ``value`` of the row that follows in descending ``key``, null last; the last row has the first one's.

    Rows are dealt into id ranges, each sorted by itself; the first rows of a range are also sent to the range before
    it, so no task orders all rows. Equal keys follow each other in the order of a hash of the value.
    """
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    marks = []
    if ranges > 1:
        marks = sorted(set(rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000)).first()[0] or []))
    spots = rows.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(_place(F.col(key), marks)))
    firsts = spots.groupBy("_range").agg(F.max(key).alias("_first"))
    order = Window.orderBy(F.desc("_range"))  # at most 4,098 rows
    firsts = firsts.select(F.col("_range").alias("_own"), "_first", F.lag("_range").over(order).alias("_before"), F.min("_range").over(Window.partitionBy()).alias("_end"))
    firsts = firsts.select("_own", "_first", F.coalesce("_before", "_end").alias("_to"))
    sent = spots.join(F.broadcast(firsts), (F.col("_range") == F.col("_own")) & F.col(key).eqNullSafe(F.col("_first")), "left")
    dealt = sent.withColumn("_also", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    dealt = dealt.withColumn("_range", F.when(F.col("_also"), F.col("_to")).otherwise(F.col("_range")))
    w = Window.partitionBy("_range").orderBy("_also", F.col(key).desc_nulls_last(), F.xxhash64(value))
    return dealt.withColumn("next", F.lead(value).over(w)).where(~F.col("_also")).drop("_range", "_own", "_first", "_to", "_also")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by as many first ones, or all, of
    the next document in descending doc_id; the last is followed by the first. Null texts are empty, an empty table
    gives no row, repeated rows and ids are rows, a lone document follows itself; other columns are left out.
    """
    own = docs.select("doc_id", whole_text().alias("_text")).withColumn("_bins", bins(F.col("_text")))
    own = own.select("doc_id", F.struct(F.col("_text").alias("text"), F.col("_bins").alias("bins")).alias("_doc"))
    both = with_next(own, "doc_id", "_doc")
    half = F.floor(F.length("_doc.text") / 2).cast("int")
    both = both.withColumn("_edited", F.concat(F.substring(F.col("_doc.text"), F.lit(1), F.length("_doc.text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    both = both.withColumn("_edited_bins", bins(F.col("_edited")))
    return both.select(
        "doc_id",
        F.length("_doc.text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_doc.bins")).alias("fingerprint"),
        packed(F.col("_edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("_doc.bins"), F.col("_edited_bins")).alias("near_edited"),
        likeness(F.col("_doc.bins"), F.col("next.bins")).alias("near_next"),
    )
