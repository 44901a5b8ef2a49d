import random
from collections import Counter

import numpy as np
import pytest

from evenhand.llm import components, line_dedup, suffix, suffix_dedup


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0].astype(np.int32)
        sa = suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        phi, shared = suffix.permuted_lcp(s, sa, block=int(rng.integers(1, 6)))
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            n = next(k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k])
            assert phi[i] == j and shared[i] == n


def test_repeated_windows_against_counting():
    rng = np.random.default_rng(2)
    for _ in range(100):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        n = int(rng.integers(1, 9))
        count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert [f.tolist() for f in suffix.repeated(texts, n)] == [[count[t[i : i + n]] > 1 for i in range(max(0, len(t) - n + 1))] for t in texts]


def stripped(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((bytes(b for b, x in zip(t, gone, strict=True) if not x), len([x for x in bytes(gone).split(b"\0") if x])))
    return out


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeats_go_as_brute_force_has_it(docs_of, by_id, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "MOST_SEGMENTS", crowd)
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, other = prose(180), prose(90)
    texts = [prose(50) + shared + prose(60), prose(30) + shared[40:] + prose(200), shared, "", None, prose(99), other * 3, "a" * 500, prose(70) + other + prose(20), prose(40), prose(40)]
    texts += [shared[:100] + prose(3) + shared[100:] for _ in range(6)]
    pairs = [*enumerate(texts), (5, texts[5]), (None, prose(150))]
    got = suffix_dedup.remove_repeats(docs_of(pairs), length=100).collect()
    want = stripped([(t or "").encode() for _, t in pairs], 100)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, bytes(r.kept), len(r.spans)) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(pairs, want, strict=True)), key=key)
    assert all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) for r in got)


def test_no_rows_no_repeats(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(docs_of, by_id):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60))
    near = long.replace(long.split()[30], "changed", 1)
    texts = {1: f"Shared line of words!\nown line number one here\n{long}", 2: f"own words only in this\nshared LINE of... words\n{near}", 3: "Shared line of words", 4: "", 5: None, 6: "two words\ntwo words", 7: "again and again here\nagain and again here\n\n"}
    got = by_id(line_dedup.dedup_lines(docs_of(texts.items())))
    assert got[1].text == texts[1] and got[1].n_dropped == 0 and got[1].n_lines == 3
    assert got[2].text.split("\n")[0] == "own words only in this" and "shared" not in got[2].text
    assert got[3].text == "" and got[3].n_dropped == 1
    assert got[4].text == "" and got[4].n_lines == 1
    assert got[5].text is None and got[5].n_lines == 0
    assert got[6].text == texts[6] and got[7].text == "again and again here\n\n"
    assert set(got[1].asDict()) >= {"h", "node", "score", "source"}


def test_groups_are_all_that_a_common_block_and_edits_link(docs_of):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90)) for _ in range(8)]
    lines = [*base, *[b.replace(b.split()[i], "zzzzzz", 1) for b in base for i in (5, 20, 60)], *[b[: len(b) // 2] for b in base]]
    docs = docs_of(enumerate(lines))
    occurrences, groups = line_dedup.line_groups(docs)
    where = {r.h: r.doc_id for r in occurrences.collect()}
    found = {}
    for r in groups.collect():
        found.setdefault(r.comp, set()).add(where[r.h])
    blocks = {where[r.h]: r.blocks for r in line_dedup.with_simhash(line_dedup.lines_of(docs)).collect()}
    group = {i: i for i in blocks}
    for i in blocks:
        for j in range(i):
            apart = [((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(blocks[i], blocks[j], strict=True)]
            if 0 in apart and sum(apart) <= line_dedup.MOST_BITS and distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])):
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    want = {}
    for i, g in group.items():
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(m) for m in want.values() if len(m) > 1)
    assert sum(map(len, found.values())) >= 10


def test_null_ids_and_empty_tables(docs_of):
    got = line_dedup.dedup_lines(docs_of([(None, "the same three words"), (7, "the same three words"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.text) for r in got if r.text is not None) == [(False, "the same three words"), (True, "")]
    assert line_dedup.dedup_lines(docs_of([])).count() == 0




def test_simhash_bits_are_majorities(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    lines = [" ".join(rng.choice(["same", "word", "w" + str(rng.randrange(99))]) for _ in range(n)) for n in (3, 127, 128, 300, 1000)] + ["same " * 999 + "same"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "h long, norm string")
    got = {r.h: r.blocks for r in line_dedup.with_simhash(table).collect()}
    words = table.select("h", F.explode(F.split("norm", " ")).alias("w")).select("h", F.xxhash64("w", F.lit(0)).alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()
    for h, blocks in got.items():
        mine = [r for r in words if r.h == h]
        bits = [int(2 * sum((getattr(r, q) >> (8 * i + j)) & 1 for r in mine) > len(mine)) for q in "ab" for i in range(8) for j in range(8)]
        assert blocks == [sum(b << k for k, b in enumerate(bits[i::4])) for i in range(4)]


def test_whole_compares_lines_that_differ_in_a_word(docs_of, by_id):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    pairs = []
    for n in (5, 10, 20, 40):
        for _ in range(25):
            line = [word() for _ in range(n)]
            other = list(line)
            for i in rng.sample(range(n), max(1, n // 10)):
                other[i] = word()
            pairs.append((n, " ".join(line), " ".join(other)))
    assert all(distance(a, b) <= 0.2 * len(a) for _, a, b in pairs)
    got = by_id(line_dedup.dedup_lines(docs_of([(i, t) for i, t in enumerate(x for _, *both in pairs for x in both)]), whole=True))
    found = Counter(n for i, (n, *_) in enumerate(pairs) if got[2 * i].n_dropped == 0 and got[2 * i + 1].n_dropped == 1)
    assert found[5] == 25 and all(found[n] >= 24 for n in (10, 20, 40))


def test_whole_drops_copies_of_short_lines_and_lines_without_blanks(docs_of, by_id):
    plain, spaced = "\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17\u3067\u3059\u306d\u3001\u6563\u6b69\u306b\u884c\u304d\u307e\u3057\u3087\u3046\u304b", "eins\u00a0zwei\u3000drei"
    texts = {1: f"Ietzte.\ntwo words\n{plain}\n{spaced}\n\u00a0", 2: f"two words\nietzte\n{plain}\n{spaced}\n\u00a0", 3: "two words\nown line", 4: plain[:-1] + "\u306d"}
    got = by_id(line_dedup.dedup_lines(docs_of(texts.items()), whole=True))
    assert [got[i].text for i in (1, 2, 3, 4)] == [texts[1], "\u00a0", "own line", ""]


def test_recall_of_like_lines_against_all_pairs(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    occurrences, groups = line_dedup.line_groups(docs, whole=True)
    comp = {(r.h, r.g): r.comp for r in groups.collect()}
    lines = [r for r in line_dedup.lines_of(docs, True).select("h", "g", "norm").distinct().collect() if 12 <= len(r.norm) <= 400]
    sets = [set(r.norm.split()) for r in lines]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 10 * len(a & b) >= 3 * len(a | b)]  # those of fewer common words are beyond a fifth, but for misspellings of most words
    like = [(i, j) for i, j in near if duck.execute("select levenshtein(?, ?)", [lines[i].norm, lines[j].norm]).fetchone()[0] * 5 <= max(len(lines[i].norm), len(lines[j].norm))]
    joined = sum(comp.get((lines[i].h, lines[i].g), 0) == comp.get((lines[j].h, lines[j].g), 1) for i, j in like)
    print(f"{joined} of {len(like)} like pairs are in one group")
    assert len(like) >= 20 and joined >= 0.9 * len(like)


def test_links_between_lines_that_are_no_buckets_first(spark):
    """Of each three, one is like both others, which are unlike each other; all have the same sketch, so share all buckets."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(8):
        long, short = [word(8) for _ in range(10)], [[word(2) for _ in range(20)] for _ in range(2)]
        lines += [" ".join(long + short[1][:n] + short[0][n:]) for n in (0, 8, 16)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    occurrences, groups = line_dedup.line_groups(docs, whole=True)
    got = {r.doc_id: r.comp for r in occurrences.join(groups, ["h", "g"]).select("doc_id", "comp").collect()}
    assert [len({got.get(3 * k + i) for i in range(3)}) for k in range(8)] == [1] * 8 and len(set(got.values())) == 8


def units_apart(a, b):
    one, two = ([w for w in x.split() for _ in range(-(-len(w) // line_dedup.UNIT))] for x in (a, b))
    return distance(one, two), max(len(one), len(two))


@pytest.mark.parametrize("piece", [4, 500])
def test_lines_still_apart_meet_over_rare_words(spark, monkeypatch, piece):
    """No pair of different components within the edits is left out, and each one with something in common is met once."""
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    lines = [[rng.choice(words) for _ in range(rng.randint(11, 30))] for _ in range(12)]
    lines += [[rng.choice(words) if rng.random() < 0.15 else w for w in line for _ in range(1 + (rng.random() < 0.05))] for line in lines for _ in range(3)]
    rows = [(i, i % 5 if i % 2 else 7, " ".join(line)) for i, line in enumerate(lines)]
    found = [(r.a, r.b) for r in line_dedup._long_apart(spark.createDataFrame(rows, "h long, c long, norm string")).collect()]
    like = {(i, j) for j, d, y in rows for i, c, x in rows[:j] if c != d and (lambda n, m: n <= m // 4)(*units_apart(x, y))}
    assert len(like) >= 20 and like <= set(found) and len(found) == len(set(found))
    assert all(rows[a][1] != rows[b][1] for a, b in found)


def test_lines_with_a_common_half_are_not_paired(spark, monkeypatch):
    """Half of each line is one passage, so all share their sketches; the pairs must not grow with the square of the lines."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = " ".join(word(12) for _ in range(12))
    docs = spark.createDataFrame([(i, " ".join(word(5) for _ in range(20)) + " " + passage) for i in range(300)], "doc_id long, text string")
    made, cut = [], line_dedup.cut

    def counted(df, name):
        df = cut(df, name)
        made.extend([df.count()] if name == "pairs" else [])
        return df

    monkeypatch.setattr(line_dedup, "cut", counted)
    _, groups = line_dedup.line_groups(docs, whole=True)
    assert made and sum(made) <= 300 and groups.count() == 0


def test_units_tell_words_apart(spark):
    lines = [" ".join(f"{c}{i:03d}" for i in range(k, k + 20)) for c in "xyz" for k in range(0, 900, 20)]
    got = [r.u for r in spark.createDataFrame([(t,) for t in lines], "norm string").select(line_dedup._units("norm").alias("u")).collect()]
    assert [len(u) for u in got] == [20] * len(lines)
    assert len(set("".join(got))) >= 0.9 * 20 * len(lines)


def test_scratch_tables_hold_what_is_still_needed(docs_of, monkeypatch):
    """Keys are dealt out once; sketches go with their lines once those that share a bucket are known, texts come in parts."""
    rng = random.Random(14)
    line = lambda: [rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(12)]
    lines = [" ".join(x) for one in (line() for _ in range(20)) for x in (one, [*one[:-1], "changed"])] + [" ".join(line()) for _ in range(200)]
    dealt, names, cut = [], [], line_dedup.cut

    def seen(df, name):
        if name == "members":
            dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block"))
        names.append(name)
        return cut(df, name)

    monkeypatch.setattr(line_dedup, "cut", seen)
    occurrences, groups = line_dedup.line_groups(docs_of(enumerate(lines)), whole=True)
    assert dealt and set(dealt) == {1}
    files = lambda df: df.sparkSession.read.parquet(*df.inputFiles()).columns
    assert files(occurrences) == ["doc_id", "t", "pos", "h", "g"] and groups.count() == 40
    assert names.count("texts") == line_dedup.PARTS


def test_lines_with_only_a_rare_word_in_common_are_not_paired(spark):
    rng = random.Random(15)
    pool = [f"w{i:03d}" for i in range(60)]
    rows = [(i, i, " ".join([f"r{i // 2:03d}", *rng.sample(pool, 19)])) for i in range(40)]
    rows += [(100 + i, 100 + i, line.replace(line.split()[7], "x" * 4)) for i, _, line in rows[:10]]
    got = {(r.a, r.b) for r in line_dedup._long_apart(spark.createDataFrame(rows, "h long, c long, norm string")).collect()}
    assert got == {(i, 100 + i) for i in range(10)}


def test_components_with_further_links_are_those_of_all(spark, monkeypatch):
    rng = random.Random(16)
    walked, walk = [], components.connected_components

    def seen(links, *names):
        walked.append(links.where("u <> v").count() if not names else None)
        return walk(links, *names)

    links = [[(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (30, 12, 25)] + [[]]
    table = lambda pairs: spark.createDataFrame(pairs, "u long, v long")
    comps, so_far = components.grown(None, table(links[0])), links[0]
    monkeypatch.setattr(components, "connected_components", seen)
    for more in links[1:]:
        comps, so_far = components.grown(comps, table(more)), so_far + more
        assert sorted(map(tuple, comps.collect())) == sorted(map(tuple, walk(table(so_far)).collect()))
    assert walked[0] <= 12 and walked[1] <= 25 and walked[2] == 0
