"""Toxic passages as maximum-scoring segments.

A token scores by its log-odds between toxic and clean labelled texts, counted once a text, under a Dirichlet prior that
has the shares of both together; tokens that do not differ clearly score a little below zero. One linear scan finds every maximal segment. How
far a segment's score is beyond chance follows from extreme-value statistics: in n tokens of clean text, E = K n
exp(-lambda S) segments reach S. A document's score is a logistic function of its best passage and of all
significant ones, fitted on the same labelled sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, python_ready

#: The model is fitted on at most so many labelled rows, those with the least hash of their id, ...
FIT_ROWS = 20_000
#: ... and keeps at most so many tokens, those that differ most.
FIT_TOKENS = 50_000
#: Strength of the prior against all counts, least |z| of a kept token, score of any other token, largest E of a significant passage.
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT = 0.05, 4.0, -0.1, 0.01

_TOKEN = re.compile(r"\w+")
PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e", T.DoubleType())]))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) in one pass, each candidate linked to the nearest one with a lower sum before it."""
    total = np.cumsum(scores)
    up = np.flatnonzero(scores > 0)
    starts: list[int] = []
    ends: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for i, after, own in zip(up.tolist(), total[up].tolist(), scores[up].tolist(), strict=True):
        start, before = i, after - own
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= before:
                j = link[j]
            if j < 0 or high[j] >= after:
                break
            start, before = starts[j], low[j]
            for x in (starts, ends, low, high, link):
                del x[j:]
        starts.append(start), ends.append(i + 1), low.append(before), high.append(after), link.append(j)
    return [(s, e, h - b) for s, e, b, h in zip(starts, ends, low, high, strict=True)]


@dataclass
class Model:
    """weights: of the kept tokens; rate, ln_k: of the extreme-value law; logistic: intercept and two slopes."""

    weights: dict[str, float]
    rate: float = 1.0
    ln_k: float = 0.0
    logistic: tuple[float, float, float] = (-5.0, 0.0, 0.0)

    def passages(self, found: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Best normalised score, and (start, end, score, E) of each significant passage, in tokens."""
        n, get = max(1, len(found)), self.weights.get
        scores = np.fromiter((get(t, DRIFT) for t in found), float, len(found))
        segments = maximal_segments(scores) if len(found) else []
        level = self.ln_k + math.log(n)
        best = self.rate * max((s for *_, s in segments), default=0.0) - level
        kept = [(a, b, s, math.exp(min(50.0, level - self.rate * s))) for a, b, s in segments]
        return best, [x for x in kept if x[3] <= SIGNIFICANT]

    @staticmethod
    def features(best: float, passages: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Bounded so that no single passage outweighs the fit."""
        return max(-20.0, min(20.0, best)), math.log1p(sum(-math.log(max(p[3], 1e-20)) for p in passages))

    def probability(self, best: float, passages: list[tuple[int, int, float, float]]) -> float:
        a, b = self.features(best, passages)
        z = self.logistic[0] + self.logistic[1] * a + self.logistic[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _rate(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; the mean score is below zero."""
    rest = max(0.0, 1 - shares.sum())
    f = lambda x: float((shares * np.exp(np.minimum(x * weights, 700))).sum() + rest * math.exp(x * DRIFT) - 1)
    if not len(weights) or weights.max() <= 0 or float((shares * weights).sum() + rest * DRIFT) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if f(middle) > 0 else (middle, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps; the intercept is not shrunk."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    keep = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """From the labelled rows that are not held out. Without labels of both kinds every text has the same low score and is clean."""
    spark = docs.sparkSession
    python_ready(spark)
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out("_id"))
    marks = marks.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("text", "_y")  # at most ``rows`` rows of 12 bytes

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for f in frames:
            for text, y in zip(f["text"], f["_y"], strict=True):
                seen[y].update(set(tokens(text)))  # texts that have it: a token comes in bursts
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
        words = list(seen[0].keys() | seen[1].keys())
        if words:
            yield pd.DataFrame({"token": words, "clean": [seen[0][w] for w in words], "toxic": [seen[1][w] for w in words]})
        for c in seen:
            c.clear()

    counts = sample.mapInPandas(count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    clean, toxic = counts.agg(F.sum("c"), F.sum("t")).first()
    if not clean or not toxic:
        return Model({})
    prior = PRIOR * (clean + toxic)
    a = F.lit(PRIOR) * (F.col("c") + F.col("t"))
    odds = F.log((F.col("t") + a) / (toxic + prior - F.col("t") - a)) - F.log((F.col("c") + a) / (clean + prior - F.col("c") - a))
    z = odds / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    kept = counts.where("c + t >= 3").select("token", "c", odds.alias("w"), F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "token").limit(FIT_TOKENS).collect()
    model = Model({r.token: r.w for r in kept})
    model.rate = _rate(np.array([r.w for r in kept]), np.array([r.c / clean for r in kept]))

    def measure(with_model: Model):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = [with_model.passages(tokens(t)) for t in f["text"]]
                yield pd.DataFrame([(int(y), b, *with_model.features(b, p)) for y, (b, p) in zip(f["_y"], found, strict=True)], columns=["y", "best", "f", "g"])

        return sample.mapInPandas(run, "y int, best double, f double, g double").toPandas()

    before = measure(model)
    calm = before.loc[before.y == 0, "best"]
    model.ln_k = float(calm.mean() - 0.5772156649) if len(calm) else 0.0  # the mean of the law's standard form
    after = measure(model)
    model.logistic = _logistic(after[["f", "g"]].to_numpy(), after.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``passages``, the significant ones.

    A passage has its first and last token's numbers (end excluded), its score and its E. Null and empty texts have no passage and
    the score of a text without any toxic token. Repeated rows stay, an empty table stays empty; columns of ``docs``
    with these three names give way.
    """
    docs = docs.drop("score", "predicted", "passages")
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FIT_TOKENS tokens
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for some in pieces(batch, text):
                found = [m.passages(tokens(t)) for t in some.column(some.schema.get_field_index(text)).to_pylist()]
                spans = [[dict(zip(("start", "end", "score", "e"), p, strict=True)) for p in x[1]] for x in found]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([m.probability(*x) for x in found], pa.float64()), pa.array(spans, kind)], names=[*some.schema.names, "score", "passages"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
