"""Approximate nearest neighbours by inner product: coarse centroids, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample; every row is indexed. A query visits the lists of its best
centroids, ranks their rows with asymmetric distance tables, and scores the best of them exactly on the stored vectors.
How many lists there are follows from the number of rows; how many a query visits, and how many rows of each are scored
exactly, from the recall that is measured on the sample. Long lists and long runs of queries are cut into blocks, so a list that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, python_ready

#: Rows from which centroids and codebooks are fitted, at most: those with the least hash of their id.
FIT_ROWS = 16_384
#: Lists there are at least and at most; between, as many as the square root of the rows.
LEAST_LISTS, MOST_LISTS = 16, 1024
#: Share of the true neighbours that the visited lists have to hold, in the mean over so many queries of the sample.
RECALL, TRIED = 0.98, 256
#: Rows of a list and queries that meet in one task, about.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 2_048


@dataclass
class Index:
    """centroids: lists x dims; books: parts x codes x dims / parts."""

    centroids: np.ndarray
    books: np.ndarray
    dims: int

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, axis=1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[lists]).reshape(len(x), len(self.books), -1)
        return np.stack([np.argmin((b**2).sum(1) - 2 * rest[:, j] @ b.T, axis=1) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        n = np.bincount(at, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
    return centers


def fit(sample: np.ndarray, lists: int = 64, parts: int = 16, codes: int = 256, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    parts = max(p for p in range(1, min(parts, dims) + 1) if dims % p == 0)
    index = Index(_kmeans(sample, lists, rng), np.zeros((parts, 1, dims // parts)), dims)
    rest = (sample - index.centroids[index.lists(sample)]).reshape(len(sample), parts, -1)
    books = [_kmeans(rest[:, j], codes, rng) for j in range(parts)]
    width = max(map(len, books))
    index.books = np.stack([np.concatenate([b, np.repeat(b[:1], width - len(b), axis=0)]) for b in books])
    return index


def measured(index: Index, sample: np.ndarray, k: int, recall: float = RECALL) -> tuple[int, np.ndarray]:
    """How many lists a query has to visit, best first, so that in the mean they hold ``recall`` of its ``k`` nearest in the
    sample; and for each list down to which part of its rows, in the order of the codes, as many of those that lie in it stand.

    Where rows are much alike, as near copies are, codes hardly tell them apart, and that part is large.
    """
    tried, k = sample[:TRIED], min(k, len(sample) - 1)
    if k < 1:
        return len(index.centroids), np.ones(len(index.centroids))
    at = index.lists(sample)
    order = np.argsort(-(tried @ index.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    score = tried @ sample.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    visits = np.take_along_axis(place, at[near], axis=1)
    held = np.cumsum(np.bincount(visits.ravel(), minlength=len(index.centroids))) / visits.size
    code = index.codes(sample, at)
    rebuilt = np.concatenate([b[code[:, j]] for j, b in enumerate(index.books)], axis=1) + index.centroids[at]
    guess = tried @ rebuilt.T
    guess[np.arange(len(guess)), np.arange(len(guess))] = -np.inf
    depth = np.zeros(len(index.centroids))
    for c in np.unique(at[near]):
        rows = np.flatnonzero(at == c)
        asks, which = np.nonzero(at[near] == c)
        ahead = (guess[asks][:, rows] >= guess[asks, near[asks, which]][:, None]).mean(1)
        depth[c] = np.quantile(ahead, recall)
    return int(np.searchsorted(held, recall - 1e-12)) + 1, depth


def usable(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, x array of double): rows with an id and a non-zero vector of finite components."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), F.lit(False))) & F.exists("x", lambda v: v != 0)
    return rows.select(F.col(ident).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(fine)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, and of all that equal the last of them: rows of one code are told apart by exact scores only."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    return np.flatnonzero(scores >= least)


def search(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, lists: int | None = None, probes: int | None = None, rerank: int = 64, **fitting) -> DataFrame:
    """Rows whose id is divisible by ``every`` against all rows: query_id, rank, vec_id, score.

    The ``k`` largest inner products found, in double precision on the given vectors, ties to the smaller id, the query's
    own id left out. Null, zero and non-finite vectors, null ids, and vectors of another length than the most frequent one of
    the sample take no part, as they have no inner product with the others; no usable rows give no result. An id that
    repeats is one item, as near as its nearest row. Other columns are left out. In each block of a list the ``rerank`` ids
    that the codes find nearest are scored exactly, or more where the sample shows that they tell rows apart badly. ``lists``
    and ``probes`` follow from the rows and from the recall on the sample unless they are given; a query whose lists hold fewer than ``k`` ids visits all of them, so it gets ``k`` if there are as many.
    """
    spark = rows.sparkSession
    python_ready(spark, 4096)
    good = usable(rows, ident, vector)
    sample = [r.x for r in good.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("x").collect()]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    dims = pd.Series([len(x) for x in sample]).mode()[0]
    fitted = np.array([x for x in sample if len(x) == dims])
    lists = lists or min(MOST_LISTS, max(LEAST_LISTS, math.isqrt(good.count())))
    index = fit(fitted, lists, **fitting)
    visits, depth = measured(index, fitted, k)
    probes = probes or visits
    shared = spark.sparkContext.broadcast(index)  # bounded by lists, codes and dims
    good = good.where(F.size("x") == int(dims))

    def place(frames):
        ix = shared.value
        for f in frames:
            if len(f):
                x = np.stack(f.x.to_numpy())
                at = ix.lists(x)
                near = np.argsort(-(x @ ix.centroids.T), axis=1, kind="stable")[:, :probes]
                asks = (f.id.to_numpy() % every) == 0
                yield pd.DataFrame({"id": f.id, "x": f.x, "list": at.astype(np.int32), "code": [c.tobytes() for c in ix.codes(x, at)], "near": [n.astype(np.int32) if a else None for n, a in zip(near, asks, strict=True)]})

    placed = cut(good.mapInPandas(place, "id long, x array<double>, list int, code binary, near array<int>"), "ann-index")
    n_rows = {r["list"]: r.n for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list

    def meet(key, entry: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entry) and len(ask):
            ix = shared.value
            entry = entry.sort_values("id", kind="stable")
            ids, x, q = entry.id.to_numpy(), np.stack(entry.x.to_numpy()), np.stack(ask.q.to_numpy())
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            code = np.frombuffer(b"".join(entry.code), np.uint8).reshape(len(entry), -1)
            base = q @ ix.centroids[key[0]]
            parts = q.reshape(len(q), len(ix.books), -1)
            most = max(rerank, math.ceil(depth[key[0]] * len(first)))
            for i, own in enumerate(ask.ask.to_numpy()):
                table = np.einsum("jcd,jd->jc", ix.books, parts[i])
                near = base[i] + table[np.arange(len(table))[:, None], code.T].sum(0)
                near[ids == own] = -np.inf
                if len(first) < len(ids):  # of an id that repeats, all rows are scored if any is near
                    of = np.maximum.reduceat(near, first)
                    top = np.flatnonzero(np.isin(ids, ids[first[_best(of, most)]]))
                else:
                    top = _best(near, most)
                top = top[ids[top] != own]
                score = (x[top] * q[i]).sum(1)  # row by row alike, so equal vectors tie
                order = np.lexsort((ids[top], -score))
                order = order[np.sort(np.unique(ids[top][order], return_index=True)[1])[:k]]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[top][order], "score": score[order]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def visit(asking: DataFrame) -> DataFrame:
        """(id, x, near) -> what each finds in its lists: a row a query and id, cut off at ``k`` a query."""
        n_asks = {r["list"]: r.n for r in asking.select(F.explode("near").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
        blocks = [(c, max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asks[c] // BLOCK_QUERIES))) for c, n in n_rows.items() if n_asks.get(c)]
        sizes = F.broadcast(spark.createDataFrame(blocks, "list int, row_blocks int, ask_blocks int"))
        mine = lambda n: F.pmod(F.xxhash64("id", "list"), F.col(n)).cast("int")
        steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        entries = placed.select("id", "x", "code", "list").join(sizes, "list").select("id", "x", "code", "list", mine("row_blocks").alias("rb"), steps("ask_blocks").alias("ab"))
        asks = asking.select("id", "x", F.explode("near").alias("list")).join(sizes, "list").select(F.col("id").alias("ask"), F.col("x").alias("q"), F.col("list").alias("l"), mine("ask_blocks").alias("qb"), steps("row_blocks").alias("r"))
        found = entries.groupBy("list", "rb", "ab").cogroup(asks.groupBy("l", "r", "qb")).applyInPandas(meet, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = placed.where("near is not null").select("id", "x", "near")
    best = cut(visit(asking), "ann-found")
    had = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = cut(asking.join(had, F.col("id") == F.col("query_id"), "left_anti").withColumn("near", F.array(*[F.lit(c) for c in sorted(n_rows)])), "ann-short")
    if probes >= len(n_rows) or short.isEmpty():
        return best
    again = visit(short)
    return best.join(short.select("id").distinct(), F.col("query_id") == F.col("id"), "left_anti").unionByName(again)
