"""Resampling documents towards a target: importance weights from hashed word and word-pair counts, Gumbel noise, exact top share.

Counts of all rows go into two arrays of a fixed number of buckets, the array of their log ratios scores every document,
and the ranks come from a histogram of the integer scores: counts summed from the top give each score's first rank, so only rows
of one score are ever sorted together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, python_ready, whole_text

BUCKETS = 10_000
#: Words of more bytes are hashed one by one.
LONG = 48


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC's byte table, and for 0 to ``LONG`` zero bytes what each of a register's four bytes becomes behind them."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    behind = np.empty((LONG + 1, 4, 256), np.uint32)
    behind[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, LONG + 1):
        behind[n] = byte[behind[n - 1] & 0xFF] ^ (behind[n - 1] >> 8)
    return byte, behind


_BYTE, _BEHIND = _tables()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CRC32 of every word and of every pair of neighbours joined by a blank, with the rows they belong to.

    Texts are UTF-8; A-Z count as a-z, words are runs of digits, letters a-z and anything beyond ASCII. The CRC of a pair
    follows from those of its words: the first one's register is carried behind as many bytes as the second one has.
    """
    wide = texts.cast(pa.large_string())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = np.where((data - np.uint8(65)) < 26, data | 0x20, data)
    inside = (data >= 0x80) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    edge = np.zeros(len(data) + 1, bool)  # a word starts or ends before this byte
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[ends] = True
    edges = np.flatnonzero(edge)
    word = inside[edges[:-1]] if len(data) else np.zeros(0, bool)
    first, size = edges[:-1][word], np.diff(edges)[word]
    row = np.searchsorted(ends, first, side="right") - 1
    code = np.full(len(first), 0xFFFFFFFF, np.uint32)
    order = np.argsort(size, kind="stable")
    beyond = np.searchsorted(size[order], np.arange(LONG + 1), side="right")
    for n in range(min(LONG, int(size.max(initial=0)))):
        some = order[beyond[n] : beyond[LONG]]
        code[some] = _BYTE[(code[some] ^ data[first[some] + n]) & 0xFF] ^ (code[some] >> 8)
    code = ~code
    for i in order[beyond[LONG] :]:
        code[i] = zlib.crc32(data[first[i] : first[i] + size[i]].tobytes())
    left = np.flatnonzero(row[1:] == row[:-1])
    right = left + 1
    with_blank = ~code[left]
    with_blank = ~(_BYTE[(with_blank ^ 0x20) & 0xFF] ^ (with_blank >> 8))
    n = np.minimum(size[right], LONG)
    pair = code[right].copy()
    for k in range(4):
        pair ^= _BEHIND[n, k, (with_blank >> (8 * k)) & 0xFF]
    for i in np.flatnonzero(size[right] > LONG):
        j = right[i]
        pair[i] = zlib.crc32(data[first[j] : first[j] + size[j]].tobytes(), int(with_blank[i]))
    return code, row, pair, row[left]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket`` and ``n``: how many features of all texts fall there. Buckets without any have no row; null texts have no feature.

    A task adds up its own rows in one array, so what is shuffled is an array's worth of rows a task.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in pieces(batch, "whole"):
                one, _, two, _ = features(some.column(0))
                total += np.bincount(one % buckets, minlength=buckets) + np.bincount(two % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return docs.select(whole_text(text).alias("whole")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """A whole number a bucket: 1000 times the log of how much likelier the target is to use it, with one added to every count.

    ``buckets`` rows a table come to the driver, whatever the tables' size.
    """
    counted = []
    for table in (source, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, buckets, text).collect():
            n[r.bucket] = r.n
        counted.append(n)
    s, t = counted
    ratio = (t + 1).astype(np.float64) * float(s.sum() + buckets) / ((s + 1).astype(np.float64) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a row's features (0 without any)."""
    python_ready(docs.sparkSession)
    gain = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "whole"):
                one, row, two, of = features(some.column(1))
                k = some.num_rows
                words = np.bincount(row, minlength=k)
                n = words + np.bincount(of, minlength=k)
                total = np.zeros(k, np.int64)
                for code, at in ((one, row), (two, of)):  # rows stand in order, so sums are differences of running sums
                    run_sum = np.r_[0, np.cumsum(gain[code % len(gain)])]
                    edges = np.searchsorted(at, np.arange(k + 1))
                    total += np.diff(run_sum[edges])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    ready = docs.select("doc_id", whole_text(text).alias("whole"))
    schema = T.StructType([ready.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return ready.mapInArrow(run, schema)


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7") -> DataFrame:
    """``weighed`` with ``score`` (weight and hash-random Gumbel noise) and ``rank`` (null where not drawn).

    Of the rows with ``least_words`` words or more the best ``percent`` of 100 are drawn, ties to the smaller ``doc_id`` (null
    last). The histogram has a row a score: scores are whole thousandths within the noise's 26,000 and the gains' range, so
    their number is bounded and the noise keeps any one of them under a thousandth of the rows. ``weighed`` is read three times.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise)
    known = F.col("n_words") >= least_words
    histogram = scored.where(known).groupBy("score").agg(F.count(F.lit(1)).alias("rows"))
    from_top = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.select(F.col("score").alias("_score"), F.coalesce(F.sum("rows").over(from_top), F.lit(0)).alias("_before"), F.floor(F.lit(percent) * F.sum("rows").over(Window.partitionBy()) / 100).cast("long").alias("_most"))
    surviving = offsets.where("_before < _most")
    at = scored.where(known).join(surviving, F.col("score") == F.col("_score"), "left")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words")
    drawn = at.where("_before is not null").withColumn("rank", (F.col("_before") + F.row_number().over(order)).cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank"))).drop("_score", "_before", "_most")
    none = F.lit(None).cast("long").alias("rank")
    left = at.where("_before is null").drop("_score", "_before", "_most").select("*", none)
    return drawn.unionByName(left).unionByName(scored.where(~known).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = BUCKETS, least_words: int = 20, seed: str = "7", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Null and empty texts have no features, weigh 0 and are never drawn if ``least_words`` is above 0. Rows that share an id
    share their noise and are ranked each; exact copies tie in weight only. Texts are read whole, however long; an empty
    table gives none; other columns of ``docs``, whatever their names, are not looked at.
    """
    weighed = cut(weigh(docs, gains(docs, target, buckets, text), text), "weighed")
    return draw(weighed, percent, least_words, seed)
