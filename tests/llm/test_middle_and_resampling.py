"""Fill-in-the-middle and importance resampling against plain loops, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import same
from evenhand.llm import middle, queries, resampling

ODD = ["", "a", "Aa1 é  <P x", "no <M> here", "\U0001f600x\U0001f600", "ab" * 70_000 + " é " + "9" * 600, "x y z " * 40, "\n\n", "<<S", "Zz" * 33 + "é" * 65]


def plain_middle(doc_id, text, seed="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKS) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cuts_of_odd_texts_and_tables(spark, docs_of):
    pairs = [(i, t) for i, t in enumerate(ODD * 4)] + [(3, None), (None, "null ids share the empty one"), (5, "a repeated id"), (5, "a repeated id")]
    docs = docs_of(pairs).withColumn("form", F.lit("clash")).withColumn("row", F.lit(7))
    made = middle.fill_in_middle(docs)
    assert made.columns == [*(c for c in docs.columns if c != "form"), "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=key)
    assert got == sorted(((i, *plain_middle(i, t)) for i, t in pairs), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert made.where(middle.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rank_and_select_agree_with_counting():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aZ é1\U0001f600"), n)) for n in (0, 1, 64, 511, 512, 513, 4096, 0, 70)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    marks = middle.Boundaries(data, starts[:-1])
    bits = np.unpackbits(marks.packed, count=len(data), bitorder="little")
    assert bits.sum() == sum(len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)) for t in texts)
    assert marks.rank(np.arange(len(data) + 1)).tolist() == np.r_[0, np.cumsum(bits)].tolist()
    assert marks.select(np.arange(int(bits.sum()))).tolist() == np.flatnonzero(bits).tolist()


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


@pytest.mark.parametrize("texts", [ODD, ["", ""], [], ["é" * 24 + " " + "é" * 25 + " ÀB" + "c" * 48 + " " + "d" * 49 + " e"]])
def test_hashed_features(texts):
    one, row, two, of = resampling.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        words, all_of = plain_features(t)
        assert [*one[row == i].tolist(), *two[of == i].tolist()] == [zlib.crc32(f.encode()) for f in all_of]
        assert len(words) == int((row == i).sum())


def test_draw_of_odd_tables_against_a_plain_loop(spark, docs_of):
    words = "the cat sat on a mat and then some more words came by so that this is long enough to count".split()
    texts = [*ODD, None, *(" ".join(words[i % 5 :] + [f"w{i % 7}"] * (i % 9)) for i in range(60))]
    pairs = [*enumerate(texts), (70, texts[-1]), (70, texts[-1]), (None, " ".join(words)), (None, " ".join(words))]
    target = ["the cat sat", None, "", "w3 w3 w3 more words"]
    source_n, target_n = Counter(), Counter()
    for n, many in ((source_n, [t for _, t in pairs]), (target_n, target)):
        for t in many:
            n.update(zlib.crc32(f.encode()) % 100 for f in plain_features(t)[1])
    s, t = sum(source_n.values()), sum(target_n.values())
    want = []
    for i, x in pairs:
        own, feats = plain_features(x)
        gain = [math.floor(1000 * math.log((target_n[b] + 1) * (s + 100) / ((source_n[b] + 1) * (t + 100)))) for b in (zlib.crc32(f.encode()) % 100 for f in feats)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(own), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    known = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    for k, w in enumerate(known[: 25 * len(known) // 100]):
        w[5] = k + 1
    got = resampling.resample(docs_of(pairs).withColumn("rank", F.lit(1)), spark.createDataFrame([(t,) for t in target], "text string"), buckets=100)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(map(tuple, want), key=key)
    none = resampling.resample(docs_of(pairs).limit(0), docs_of(pairs).limit(0))
    assert none.count() == 0


def test_registered_queries_match_their_sql(spark, sf_dir, duck):
    for name in ("op12_fill_in_middle", "op13_importance"):
        same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])
