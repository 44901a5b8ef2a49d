"""Removal of long strings that occur more than once in the corpus, by suffix arrays over shards.

Every window of ``length`` bytes has an anchor, the k-gram of least hash in it, so equal windows have equal anchors.
Consecutive windows of one anchor form a segment. Segments whose anchor occurs once can't repeat. Of the rest, equal
segments fall together, and those of anchors that have different segments go into shards by anchor; each shard gets a suffix
array by induced sorting, and its permuted common prefixes tell which windows repeat. An anchor with very many
different segments isn't gathered: its windows are counted by their digests instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, pieces, python_ready
from .suffix import repeated

#: Bytes of an anchor, and of a shard's text, about.
GRAM, SHARD_BYTES = 96, 1_500_000
#: Different segments of an anchor that go into one shard, at most.
MOST_SEGMENTS = 1_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bits of a position beside 32 of a hash; a text of Arrow's strings has fewer bytes than 2**31.
_PLACE = 32


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Polynomial hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n])]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(_inverse(base)), np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _BASES[1])


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of ``w``, from prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    rows = np.r_[x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text number, first window, windows, anchor hash, two digests of the segment's bytes."""
    gram = min(gram, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    one, two = (Hashes(data, b) for b in _BASES)
    at = np.arange(len(data) - gram + 1)
    grams = one.of(at, at + gram)
    low = np.uint64((1 << _PLACE) - 1)
    anchor = (_window_least((grams & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (start + sizes)[owner]
    p = np.flatnonzero(inside)
    if not len(p):
        return none
    new = np.flatnonzero(np.r_[True, (anchor[p][1:] != anchor[p][:-1]) | (np.diff(p) != 1) | (owner[p][1:] != owner[p][:-1])])
    first, n = p[new], np.diff(np.r_[new, len(p)])
    end = first + n - 1 + length
    return owner[first], first - start[owner[first]], n, grams[anchor[first]], one.of(first, end), two.of(first, end)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut_up(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                texts = [(t or "").encode() for t in some.column(2).to_pylist()]
                owner, first, n, a, d, e = segments(texts, length)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), some.column(1).take(pa.array(owner)), pa.array(first), pa.array(n), _signed(a), _signed(d), _signed(e)], names=["doc_id", "t", "p", "n", "a", "d", "e"])

    return run


def _fetch(length: int):
    """(text, wanted) -> the bytes of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                out += [(w["a"], w["d"], w["e"], data[w["p"] : w["p"] + w["n"] - 1 + length]) for w in wanted.as_py()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["a", "d", "e", "data"])

    return run


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_shard(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, flags in enumerate(repeated(list(frame.data), length)):
            lo, hi = _runs(flags)
            if len(lo):
                out.append(pd.DataFrame({"i": i, "lo": lo, "hi": hi}))
        got = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"i": [], "lo": [], "hi": []}, dtype="int64")
        return pd.concat([frame[["a", "d", "e"]].iloc[got.i].reset_index(drop=True), got[["lo", "hi"]]], axis=1)

    return run


def _windows(length: int):
    """Segments -> two digests of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], np.uint8)
                at = np.arange(len(data) - length + 1)
                x, y = (Hashes(data, b).of(at, at + length) for b in _BASES)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row[c])) for c in "ade"] + [pa.array(at), _signed(x), _signed(y)], names=["a", "d", "e", "lo", "x", "y"])

    return run


def _strip(length: int):
    """(doc_id, text, found) -> what is left, and the removed runs of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                where = []
                for f in sorted((f["lo"], f["hi"]) for f in found.as_py() or ()):
                    lo, hi = f[0], f[1] - 1 + length
                    if where and lo <= where[-1][1]:
                        where[-1][1] = max(where[-1][1], hi)
                    else:
                        where.append([lo, hi])
                spans.append([{"start": a, "end": b} for a, b in where])
                edges = [0, *[x for w in where for x in w], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, kept (binary), spans (array of start, end: maximal removed runs), a row a document.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another; strings lie within
    one text and are judged on the input. Null texts are empty, texts shorter than ``length`` stay, repeated rows
    repeat each other, rows that share an id but not the text are apart; an empty table gives no row. Other columns
    are left out. What is left need not be whole characters, so it is binary.
    """
    spark = docs.sparkSession
    python_ready(spark)
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = cut(own.mapInArrow(_cut_up(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, p long, n long, a long, d long, e long"), "segments")
    again = found.groupBy(F.col("a").alias("_a")).agg(F.count(F.lit(1)).alias("m"), *[f(c).alias(f"{c}{i}") for c in "de" for i, f in enumerate((F.min, F.max))]).where("m > 1")
    # written first: what stands right before a join can't be split, and one anchor may have very many segments
    again = cut(again.select("_a", ((F.col("d0") != F.col("d1")) | (F.col("e0") != F.col("e1"))).alias("mixed")), "again")
    twice = cut(found.join(again, F.col("a") == F.col("_a")).drop("_a"), "anchored")
    drop(found, again)
    alike = twice.where("not mixed").select("doc_id", "t", "p", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))

    mixed = twice.where("mixed").drop("mixed")
    key = ["a", "d", "e"]
    distinct = cut(mixed.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.min(F.struct("doc_id", "t", "p")).alias("at")), "distinct")
    crowd = cut(distinct.groupBy(F.col("a").alias("_a")).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > MOST_SEGMENTS), "crowded")
    wanted = distinct.groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.t").alias("_t")).agg(F.collect_list(F.struct("a", "d", "e", F.col("at.p").alias("p"), "n")).alias("wanted"))
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t"))).select("text", "wanted").mapInArrow(_fetch(length), "a long, d long, e long, data binary")
    texts = cut(texts.join(crowd, F.col("a") == F.col("_a"), "left").select(*key, "data", F.col("many").isNotNull().alias("crowded")), "texts")
    size = texts.where("not crowded").agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    # rows that repeated ids and texts fetch twice are one segment
    shard = texts.where("not crowded").groupBy(F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")).applyInPandas(_sorted_shard_once(length), "a long, d long, e long, lo long, hi long")
    digests = cut(texts.where("crowded").select(*key, "data").dropDuplicates(key).mapInArrow(_windows(length), "a long, d long, e long, lo long, x long, y long"), "windows")
    common = digests.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    counted = digests.join(common, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select(*key, "lo", (F.col("lo") + 1).alias("hi"))
    whole = distinct.where("m > 1").select(*key, F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    marks = shard.union(counted).union(whole).groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    marks = cut(marks, "marks")  # as above: one segment may be that of very many documents
    on = [F.col(c) == F.col(f"_{c}") for c in key]
    differing = mixed.join(marks, on).select("doc_id", "t", "p", F.explode("found").alias("f")).select("doc_id", "t", "p", "f.lo", "f.hi")
    every = alike.union(differing).groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg(F.collect_list(F.struct((F.col("p") + F.col("lo")).alias("lo"), (F.col("p") + F.col("hi")).alias("hi"))).alias("found"))
    every = cut(every, "found")
    drop(twice, distinct, crowd, texts, digests, marks)
    both = own.join(every, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "found")
    return both.mapInArrow(_strip(length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def _sorted_shard_once(length: int):
    sort = _sorted_shard(length)
    return lambda frame: sort(frame.drop_duplicates(["a", "d", "e"]))
