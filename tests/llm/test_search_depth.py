"""Search: recall on clustered, even and crowded vectors, repeated ids, lists with few rows."""

import numpy as np
import pytest

from evenhand.llm import ann


def nearest(ids, x, query, own, k=20):
    best = {}
    for i, s in zip(ids.tolist(), (x * query).sum(1).tolist(), strict=True):
        if i != own:
            best[i] = max(s, best.get(i, -np.inf))
    return sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]


def recall(spark, ids, x, **how):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(rows, **how).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = n = 0
    for i in sorted({int(i) for i in ids if i % 20 == 0}):
        own = x[np.flatnonzero(ids == i)[0]]
        want, mine = nearest(ids, x, own, i), sorted(found[i])
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1)) and len({v for _, v, _ in mine}) == len(mine)
        hits += len({v for v, _ in want} & {v for _, v, _ in mine})
        n += len(want)
    return hits / n


@pytest.mark.parametrize("kind", ["even", "clusters", "crowd"])
def test_recall_by_kind_of_vectors(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    if kind == "clusters":
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] * 3 + 0.3 * x
    if kind == "crowd":  # a third of the rows are near copies of one
        x[:500] = x[0] + 0.01 * x[:500]
    x = rng.permutation(x)
    assert recall(spark, np.arange(1500), x) >= 0.95
    index = ann.fit(x, 38)
    visits, depth = ann.measured(index, x, 20)
    assert visits < 12 if kind == "clusters" else visits <= 38
    assert 0 <= depth.min() and np.median(depth) < depth.max() <= 1


def test_repeated_ids_and_lists_with_few_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    ids = np.arange(900)
    ids[100:700] = 7  # six hundred rows of one id, close to a query
    x[100:700] = x[0] + 0.001 * x[100:700]
    assert recall(spark, ids, x) >= 0.95
    assert recall(spark, np.arange(60), rng.normal(size=(60, 8)), lists=30, probes=1) >= 0.9
