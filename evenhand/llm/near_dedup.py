"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts with the same shingle set fall into one class first. Every class has ``TREES`` signature orders; each order is sorted by
range over all partitions, and a class's neighbours with the longest common prefix are its candidates: how deep
the prefix reaches depends on how dense the region is. Candidates are confirmed on the full sets. The orders are taken in
batches, and a later batch only pairs classes that are still in different components, so a large group of near copies is
one component before most of its pairs have been compared. What a window of neighbours can't reach in dense regions is
taken up afterwards: members of different components there meet block by block. Components come from the confirmed links.

Pairs are ruled out by a bound before their texts are fetched. An odd sketch has a bit for each residue of a set's hashes, set
if an odd number of them has it; two sketches differ in no more bits than the sets differ in shingles. So a pair whose
sketches differ in too many bits for the similarity can't be a link, and no link is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, python_ready
from .components import connected_components

#: Orders, hashes an order is sorted by, and hashes that neighbours share at least. A pair of similarity s shares them in some order with a
#: probability of 1 - (1 - s**3)**21: at 0.8, all but 3 in 10 million.
TREES, DEPTH, LEAST_DEPTH = 21, 6, 3
#: Following neighbours in an order that a class is compared with; the rest of a region comes in the last round.
WINDOW = 4
#: Orders of each batch.
BATCHES = (1, 4, 16)
#: Members of a dense region that meet in one task.
BLOCK = 256
#: Bytes of the odd sketch that goes with the orders, and the least of the one that goes with dense regions, which has two bits a shingle.
NARROW, LEAST_WIDE = 64, 128

_ODD = np.random.default_rng(20_240_601).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = np.random.default_rng(20_240_602).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=500_000)
def _word(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all k-word shingles, A-Z lower-cased; of the whole sequence, if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII letters and the six blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    x = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        x = (x + h[i : i + n]) * _STEP
        x ^= x >> np.uint64(29)
    x *= _MIX
    return np.unique(x ^ (x >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Big-endian 32-bit minima, TREES * DEPTH of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * DEPTH), ">u4")
    for i, (a, b) in enumerate(zip(_ODD, _PLUS, strict=True)):
        out[:, i] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Packed parities of the residues of a set's hashes; their number is a power of two, two a member at least."""
    m = max(8 * LEAST_WIDE, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool))


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches, a row each, as they are for ``width`` bytes: residues of a smaller power of two."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def can_be_like(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members with the sketches x and y can have ``percent`` hundredths of their union in common.

    Sets that differ in d members have (n + m - d) / 2 in common and (n + m + d) / 2 together.
    """
    bits = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint64)).sum(-1, dtype=np.int64)
    return (100 + percent) * np.maximum(bits, np.abs(n - m)) <= (100 - percent) * (n + m)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sets = [shingle_set(t, k) for t in some.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                wide = [odd_sketch(s) if len(s) else None for s in sets]
                binary = lambda of: pa.array([of(s, o) if len(s) else None for s, o in zip(sets, wide, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        binary(lambda s, o: xxhash.xxh3_128_digest(s.tobytes())),
                        binary(lambda s, o: next(sig).tobytes()),
                        binary(lambda s, o: folded(o[None], NARROW).tobytes()),
                        binary(lambda s, o: o.tobytes()),
                    ],
                    names=["doc_id", "n", "key", "sig", "narrow", "wide"],
                )

    return run


def _neighbours(percent: int):
    """Rows (tree, part, node, comp, n, narrow) in order -> pairs of different components that share the least depth and whose
    sketches don't rule them out, and the rows next to the partition's ends (b null)."""
    names = ["a", "b", "tree", "part", "comp", "n", "narrow"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def fixed(column: pa.Array, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)

    def ends(cols: tuple[np.ndarray, ...]) -> list[tuple]:
        return [(int(node), None, int(t), bytes(p), int(c), int(n), bytes(o)) for t, p, node, c, n, o in zip(*cols, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        first: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node, comp, size = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
            cols = (tree, fixed(batch.column(1), 4 * DEPTH), node, comp, size, fixed(batch.column(5), NARROW))
            fresh = 0
            if kept is not None:
                fresh = len(kept[0])
                cols = tuple(np.concatenate(x) for x in zip(kept, cols, strict=True))
            if len(first) < WINDOW:
                first = ends(tuple(x[:WINDOW] for x in cols))
            t, p, node, c, n, o = cols
            for step in range(1, WINDOW + 1):
                i = np.arange(max(0, fresh - step), len(t) - step)
                j = i + step
                near = (t[i] == t[j]) & (p[i, : 4 * LEAST_DEPTH] == p[j, : 4 * LEAST_DEPTH]).all(1) & (c[i] != c[j])
                i, j = i[near], j[near]
                fine = can_be_like(n[i], o[i], n[j], o[j], percent)
                i, j = node[i[fine]], node[j[fine]]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), *[pa.nulls(len(i), x) for x in types[2:]]], names=names)
            kept = tuple(x[-WINDOW:] for x in cols)
        if kept is not None:
            rows = sorted({*first, *ends(kept)}, key=lambda r: (r[2:4], r[0]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            fine = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.as_py(), b.as_py()
                if x != last[0]:
                    last = (x, shingle_set(x, k))
                own = shingle_set(y, k)
                both = len(np.intersect1d(last[1], own, assume_unique=True))
                fine.append(100 * both >= percent * (len(last[1]) + len(own) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(fine, pa.bool_()))

    return run


def _across(percent: int):
    """Pairs of two blocks, or of one, whose components differ and whose sketches don't rule out the similarity."""

    def run(key, frame):
        import pandas as pd

        node, comp, home, n = (frame[c].to_numpy() for c in ("node", "comp", "home", "n"))
        width, alone = frame.wide.str.len().to_numpy(), key[2] == key[3]
        a, b = [], []
        for w in np.unique(width):
            # the rows of this width, then the wider ones as they are at this width
            own, sketches = [], []
            for v in np.unique(width[width >= w]):
                at = np.flatnonzero(width == v)
                own.append(at)
                sketches.append(folded(np.frombuffer(b"".join(frame.wide.iloc[at]), np.uint8).reshape(len(at), -1), int(w)))
            rows, x = np.concatenate(own), np.concatenate(sketches)
            for at, i in enumerate(own[0]):
                j = rows[at + 1 :]
                near = np.flatnonzero((comp[j] != comp[i]) & (alone | (home[j] != home[i])))
                near = near[can_be_like(n[i], x[at], n[j[near]], x[at + 1 + near], percent)]
                a.append(np.minimum(node[i], node[j[near]])), b.append(np.maximum(node[i], node[j[near]]))
        return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}, dtype="int64")

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The confirmed ones of (a, b); the text of b travels to that of a."""
    held = texts.select(F.col("node").alias("_n"), F.col("text").alias("_t"))
    right = pairs.join(held, F.col("b") == F.col("_n")).select("a", "b", F.col("_t").alias("text_b"))
    both = right.join(held, F.col("a") == F.col("_n")).select("a", "b", F.col("_t").alias("text_a"), "text_b")
    return both.mapInArrow(_confirm(k, percent), "u long, v long")


def _part(t: int):
    return F.substring("sig", t * 4 * DEPTH + 1, 4 * DEPTH)


def _with_component(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds ``comp``; a class without links is a component of its own."""
    if comps is None:
        return nodes.withColumn("comp", F.col("node"))
    held = comps.select(F.col("node").alias("_c"), "component")
    return nodes.join(held, F.col("node") == F.col("_c"), "left").withColumn("comp", F.coalesce("component", "node")).drop("_c", "component")


def _candidates(classes: DataFrame, comps: DataFrame | None, trees: range, slots: int, percent: int) -> DataFrame:
    """(a, b) that are neighbours in one of the orders, in different components and not ruled out."""
    orders = _with_component(classes.select("node", "n", "narrow", F.posexplode(F.array(*[_part(t) for t in trees])).alias("tree", "part")), comps)
    sort, schema = ["tree", "part", "node"], "a long, b long, tree int, part binary, comp long, n long, narrow binary"
    found = cut(orders.select(*sort, "comp", "n", "narrow").repartitionByRange(slots, *sort).sortWithinPartitions(*sort).mapInArrow(_neighbours(percent), schema), "neighbours")
    # rows at the ends of partitions, a few of each: those of adjacent partitions are neighbours too
    ends = found.where("b is null").select("tree", "part", F.col("a").alias("node"), "comp", "n", "narrow").coalesce(1).sortWithinPartitions(*sort).mapInArrow(_neighbours(percent), schema)
    pairs = cut(found.union(ends).where("b is not null").select("a", "b").distinct(), "pairs")
    drop(found)
    return pairs


def _texts(own: DataFrame, named: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the classes in ``pairs``: the text of the row that gave the class its number."""
    asked = pairs.select(F.col("a").alias("_n")).union(pairs.select("b")).distinct()
    mine = classes.join(asked, F.col("node") == F.col("_n"), "left_semi").select("node", F.col("key").alias("_k"))
    reps = named.select("doc_id", "key").join(mine, (F.col("key") == F.col("_k")) & (F.col("doc_id") == F.col("node"))).select("node").distinct()
    return own.join(reps, F.col("doc_id") == F.col("node")).groupBy("node").agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row a document.

    Documents whose sets of k-word shingles have at least ``percent`` hundredths of their union in common are linked;
    ``component_id`` is the smallest id that links reach, and the document with that id is kept. Null and blank texts
    have no shingles and no links. Rows of one id count as one document; rows without an id are linked with nothing,
    have no component and are kept. An empty table gives no row; other columns are left out.
    """
    spark = docs.sparkSession
    python_ready(spark)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = cut(own.mapInArrow(_profile(k), "doc_id long, n long, key binary, sig binary, narrow binary, wide binary"), "profiles")
    classes = cut(profile.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in ("n", "sig", "narrow", "wide")]), "classes")
    whole, profile = profile, cut(profile.select("doc_id", "n", "key"), "sizes")
    drop(whole)
    named = profile.where("key is not null and doc_id is not null")

    links, comps, start = None, None, 0

    def confirmed(pairs: DataFrame) -> DataFrame:
        texts = cut(_texts(own, named, classes, pairs), "texts")
        new = cut(_links(pairs, texts, k, percent), "links")
        drop(texts, pairs)
        return new

    for size in BATCHES:
        new = confirmed(_candidates(classes, comps, range(start, start + size), slots, percent))
        links = new if links is None else links.union(new)
        if comps is not None:
            drop(comps)
        comps = cut(connected_components(links), "components")
        start += size

    regions = classes.select("node", F.posexplode(F.array(*[F.xxhash64(F.substring(_part(t), 1, 4 * LEAST_DEPTH)) for t in range(TREES)])).alias("tree", "stem"))
    sizes = regions.groupBy(F.col("tree").alias("_t"), F.col("stem").alias("_s")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WINDOW + 1)
    dense = regions.join(sizes, (F.col("tree") == F.col("_t")) & (F.col("stem") == F.col("_s"))).drop("_t", "_s")
    dense = cut(_with_component(dense, comps).select("tree", "stem", "size", "node", "comp"), "dense")
    mixed = dense.groupBy(F.col("tree").alias("_t"), F.col("stem").alias("_s")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    blocked = dense.join(mixed, (F.col("tree") == F.col("_t")) & (F.col("stem") == F.col("_s")), "left_semi").join(classes.select(F.col("node").alias("_n"), "n", "wide"), F.col("node") == F.col("_n"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    blocked = blocked.withColumn("i", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    blocked = blocked.select("tree", "stem", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "comp", "n", "wide", F.col("i").alias("home"))
    rest = cut(blocked.groupBy("tree", "stem", "i", "j").applyInPandas(_across(percent), "a long, b long").distinct(), "rest")
    drop(dense)
    links = links.union(confirmed(rest))

    comps = connected_components(links)
    ids = cut(classes.select("key", "node").join(comps.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left").select(F.col("key").alias("_k"), F.coalesce("component", "node").alias("component")), "ids")
    drop(links, comps, classes)
    return profile.join(ids, F.col("key") == F.col("_k"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
