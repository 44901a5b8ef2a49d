import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import same

from evenhand.llm import bpe, components, fingerprints, licenses, mixing, near_dedup, queries, toxicity, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, sf_dir, duck, name):
    assert same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_mix(docs_of, by_id):
    docs = docs_of([(i, "w " * (i % 7)) for i in range(200)]).unionByName(docs_of([(i, "word word") for i in range(200, 230)], source="b")).unionByName(docs_of([(900, None), (901, ""), (902, "one")], source=None))
    got = mixing.mix(docs).collect()
    assert len(got) == 233 and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert by_id(mixing.mix(docs.repartition(9))) == by_id(mixing.mix(docs))
    again = mixing.mixed_rows(docs).collect()
    assert sum(len((r.text or "").split()) for r in again) == sum(r.taken for r in got)
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mix(docs_of([])).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.B.example.org/en/12?x", 1), (2, "http://example.org/en/2", 1), (3, "http://notexample.org/es/", 1), (4, "http://COM/de/x#y", 1), (5, None, 1), (6, "no scheme", 1), (7, "x://h://org/", 1), (7, "http://org?q", 1)], "page_id long, url string, verdict int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {
        (1, "a.b.example.org"): ("/en/12", "example.org/en/1", "block"), (2, "example.org"): ("/en/2", "org/", "allow"), (3, "notexample.org"): ("/es/", "org/", "allow"), (4, "com"): ("/de/x", "com/de/", "block"),
        (5, ""): ("", None, "allow"), (6, ""): ("", None, "allow"), (7, "h:"): ("//org/", None, "allow"), (7, "org"): ("", None, "allow"),
    }
    assert url_filter.judge(pages, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_fingerprints(docs_of):
    rng = random.Random(8)
    words = ["w" + str(i) for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 30, 400, 2000, 2000)]
    texts[6] = texts[5][: len(texts[5]) * 9 // 10] + texts[6][: len(texts[6]) // 10]
    pairs = [*enumerate(texts), (7, None), (8, texts[4]), (8, texts[4])]
    got = fingerprints.fingerprints(docs_of(pairs)).collect()
    assert len(got) == len(pairs)
    text = {i: t or "" for i, t in pairs}
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[8].fingerprint and by[0].fingerprint == by[7].fingerprint == ""
    import hashlib

    order = sorted(text, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, half = text[i], len(text[i]) // 2
        if i != 8:
            assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + text[j][:half]).encode()).hexdigest()
        assert by[i].n_chars == len(t) and 0 <= by[i].near_edited <= 1
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text.items() if (w := t.split())}
    exact = len(sets[6] & sets[5]) / len(sets[6] | sets[5])
    assert by[6].near_next == pytest.approx(exact, abs=0.15) and by[5].near_next < 0.1
    assert fingerprints.fingerprints(docs_of([])).count() == 0
    assert fingerprints.fingerprints(docs_of([(None, "a b c")])).first().near_next == 1.0


def test_next_over_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000, 3).withColumn("v", F.col("id").cast("string"))
    got = {r.id: r.next for r in fingerprints.with_next(rows, "id", "v").collect()}
    ids = sorted(got, reverse=True)
    assert len(ids) == 1334 and all(got[a] == str(b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True))


def test_bpe_equals_the_library(spark, docs_of, sf_dir):
    from tokenizers import Tokenizer

    path = queries.word_vocabulary()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += ["don't 's ''s \u0130stanbul \u039f\u0394\u039f\u03a3 e\u0301 a\x1cb <|startoftext|>x<|endoftext|> <|STARTOFTEXT|>", "aaaa " * 9, "", None, "\u65e5\u672c \U0001f389\U0001f389 \xbd \xb2 \u2168", "a\x85b\xa0c\u3000d\ufeffe\u200bf", "\x00\x1f\x7f"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 591), rng.randint(768, 879), rng.randint(880, 1023)])) for _ in range(150)) for _ in range(60)]
    rows = {r.doc_id: r for r in bpe.encode_decode(docs_of(enumerate(texts)), path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == want and rows[i].decoded == library.decode(want, skip_special_tokens=False)
    assert rows[0].node == "y" and bpe.encode_decode(docs_of([]), path).count() == 0


def brute_components(sets, percent=80):
    group = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


@pytest.mark.parametrize(("window", "block", "batches"), [(4, 256, (1, 4, 16)), (1, 3, (21,))])
def test_near_duplicates_against_all_pairs(docs_of, by_id, monkeypatch, window, block, batches):
    for name, value in (("WINDOW", window), ("BLOCK", block), ("BATCHES", batches)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(9)
    words = ["w" + str(i) for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(6)]
    texts = {i: " ".join(b) for i, b in enumerate(base)}
    for i in range(10, 60):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts[i] = " ".join(b)
    texts |= {70: "Only Two", 71: "only two", 72: "", 73: None, 74: " \n", 75: texts[0].upper(), 76: "only"}
    got = by_id(near_dedup.near_duplicates(docs_of(texts.items()), k=4))
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    want = brute_components(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_of_odd_tables(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).count() == 0
    rows = near_dedup.near_duplicates(docs_of([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows if r.doc_id) == [(3, 3, True), (3, 3, True), (4, 3, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_segments(x):
    """All maximal segments: repeatedly the best of what is left, as the definition has it."""

    def split(lo, hi):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        return [*split(lo, i), (i, j), *split(j, hi)]

    return split(0, len(x))


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.normal(-0.2, 1, rng.integers(0, 14))
        got = toxicity.maximal_segments(x)
        assert [(a, b) for a, b, _ in got] == brute_segments(x.tolist())
        assert all(s == pytest.approx(x[a:b].sum()) for a, b, s in got)


def test_toxicity_on_held_out_rows(spark, docs_of):
    rng = random.Random(10)
    calm, bad = ["w" + str(i) for i in range(200)], ["vile", "awful", "nasty"]
    texts, marks = {}, {}
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 80))]
        marks[i] = int(i % 4 == 0)
        if marks[i]:
            words[3:3] = rng.choices(bad, k=4)
        texts[i] = " ".join(words)
    texts |= {1000: "", 1001: None}
    labels = spark.createDataFrame([*((i, 1, y) for i, y in marks.items()), (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts.items())
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in rows if r.held and r.doc_id in marks]
    assert len(held) > 60 and np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.97
    hit = next(r for r in rows if r.predicted)
    found = toxicity.tokens(hit.text)[hit.passages[0].start : hit.passages[0].end]
    assert set(found) & set(bad) and hit.passages[0].e <= toxicity.SIGNIFICANT
    assert all(0 <= r.score <= 1 for r in rows) and next(r for r in rows if r.doc_id == 1001).predicted == 0
    again = toxicity.fit(docs, labels.withColumn("toxic", labels.toxic * (1 - toxicity.held_out().cast("int"))))
    assert again.weights == model.weights  # held-out labels do not matter
    assert {toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).select("score").distinct().count()} == {1}
    assert toxicity.score(docs_of([]), model).count() == 0


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\n# Licensed under the Apache License, Version 2.0.\n" + "more code here " * 9), ("a/b/y.py", "code"), ("a/c/d/z.py", None),
        ("top.py", ""), (None, "code"), ("q/note.txt", "Licensed under CC BY-NC 4.0."), ("q/r.txt", "about licences and versions"), ("q/long.txt", "word " * 300 + ". Released under the MIT License. " + "word " * 300),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, cosine int")
    got = {r.path: (r.licence, r.how, r.source_dir) for r in licenses.licences(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.py": ("Apache-2.0", "own", None), "a/b/y.py": ("MIT", "inherited", "a"), "a/c/d/z.py": ("MIT", "inherited", "a"), "top.py": (None, "none", None),
        None: (None, "none", None), "q/note.txt": ("CC-BY-NC-4.0", "own", None), "q/r.txt": ("CC-BY-NC-4.0", "inherited", "q"), "q/long.txt": ("MIT", "own", None),
    }
    assert licenses.licences(files.limit(0)).count() == 0


def test_cosine_against_dense_vectors():
    m = licenses.Matcher(licenses.TEMPLATES)
    line = "licensed under the apache license version 2.0 only here"
    words = Counter(licenses._TOKEN.findall(line))
    best = 0.0
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            other = Counter(licenses._TOKEN.findall(t.lower()))
            w = {x: m.idf.get(x, m.other) for x in {*words, *other}}
            dot = sum(words[x] * other[x] * w[x] ** 2 for x in w)
            best = max(best, dot / math.sqrt(sum((words[x] * w[x]) ** 2 for x in w) * sum((other[x] * w[x]) ** 2 for x in w)))
    assert m.best(line)[0] == pytest.approx(best) and m.best(line)[1] == "Apache-2.0"


def test_notices_that_share_a_line_or_are_wrapped():
    matcher = licenses.Matcher(licenses.TEMPLATES)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    for text, want, line in (
        ("Copyright (c) 2024 Jane Doe. Released under the MIT License.", "MIT", 0),
        ("Some data. Licensed under CC BY-NC 4.0. Ask us first.", "CC-BY-NC-4.0", 0),
        (f"#!/bin/sh\n{gpl}\necho many more words", "GPL-3.0", 1),
        ("// all of it is licensed under the\n// Apache License, Version 2.0 and so on", "Apache-2.0", 0),
    ):
        found = matcher.scan(text)
        assert found and (found["licence"], found["line"]) == (want, line)
    assert matcher.scan("this file is the one to use in any case") is None and matcher.scan(None) is None


@pytest.mark.parametrize("percent", [30, 80, 95])
def test_sketches_never_rule_out_a_link(percent):
    rng = np.random.default_rng(5)
    out = 0
    for _ in range(3000):
        n = int(rng.integers(1, 3000)) if rng.random() < 0.3 else int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        own = rng.random(len(a)) < rng.random() ** 0.3
        b = np.unique(np.r_[a[own], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 2)), dtype=np.uint64)])
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        x, y = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
        for width in (near_dedup.NARROW, min(len(x), len(y))):
            can = near_dedup.can_be_like(np.array([len(a)]), near_dedup.folded(x[None], width), np.array([len(b)]), near_dedup.folded(y[None], width), percent)[0]
            assert can or 100 * both < percent * (len(a) + len(b) - both)
            out += not can
    assert out > 100


def test_near_duplicates_of_long_and_short_texts(docs_of, by_id):
    """Sketches of different widths meet, and a long text links with its like."""
    rng = random.Random(11)
    long = [f"w{rng.randrange(5000)}" for _ in range(9000)]
    texts = {1: " ".join(long), 2: " ".join([*long[:8200], "cut"]), 3: " ".join(long[:500]), 4: " ".join([*long[:520], "end"]), 5: " ".join(long[:600]), 6: " ".join(long[:4500])}
    texts |= {10 + i: " ".join([*long[: 500 + i], f"own{i}"]) for i in range(0, 60, 5)}
    got = by_id(near_dedup.near_duplicates(docs_of(texts.items()), k=4))
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for i, t in texts.items() for w in [t.split()]}
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets)
