import math

import numpy as np

import corpus_pipeline
from evenhand.llm import ann, queries


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(600)]
    odd = [(600, None, 1), (620, [0.0] * 16, 1), (640, [math.nan] * 16, 1), (660, [math.inf] + [0.0] * 15, 1), (None, [1.0] * 16, 1), (680, [None] * 16, 1), (700, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = ann.search(table).collect()
    d = x.astype(float)
    hit = 0
    for q in range(0, 600, 20):
        score = (d * d[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hit >= 0.9 * 600 and {r.query_id for r in got} == set(range(0, 600, 20))
    assert ann.search(table.limit(0)).count() == 0
    few = ann.search(table.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, sf_dir).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, p in scored.items() if not p}
        elif name == "line dedup":
            assert docs.count() == before.count() and docs.selectExpr("sum(length(text))").first()[0] <= before.selectExpr("sum(length(text))").first()[0]
        elif name == "near dedup":
            kept = {r.doc_id for r in docs.collect()}
            assert kept <= {r.doc_id for r in before.collect()} and docs.count() == len(kept)
        elif name == "mixing":
            words = lambda d: sum(len((r.text or "").encode().split()) for r in d.collect())
            assert abs(words(docs) - 1.5 * words(before)) <= 40
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.count() == before.count() and docs.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_runs_and_odd_rows_pass(spark, docs_of, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count()
    docs = docs_of([(None, "some words of a text"), (1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 4
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
