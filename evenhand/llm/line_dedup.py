"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised, equal ones fall together first. Lines that share a key are candidates, and an edit similarity confirms
them. One occurrence of every connected group stays: the first by document id and position.

The registered query and the pipeline take ``whole``. A line is then sketched by its words of least weighted hash, longer
words weighing more (three-character runs stand for very long words, so for scripts without blanks); keys are
combinations of the first of them, and of lines of few words all but one. Otherwise keys are four blocks of a SimHash of
128 bits, and candidates differ in few bits: certain up to three different bits only, which leaves most near lines of
under 60 words apart.

A text is normalised once. What is kept of a line is slim: two hashes, its place and its sketch. Texts are fetched for
candidates only. Keys are dealt out family by family, and only those that different lines share are kept. The lines of a
bucket meet its first line only; those linked to it leave, and the rest meets the first of them in the next round. So a
round is linear in the lines, however many a bucket has. After the rounds come the lines of the buckets that are still in
different components. Those compared by units meet over the rare words that like lines can't all lack, an exact prefix
filter; those of few words meet the lines of their bucket, in pieces. So no like pair that shares a key is left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .components import grown

#: Without ``whole``, lines of fewer words are left alone, however often they occur.
LEAST_WORDS = 3
#: Part of the longer line that may be edited.
EDITS = 0.2
#: Bits in which the SimHashes of like lines differ at most, of 128: an angle of 34 degrees between the word counts.
MOST_BITS = 24
#: Keys of ``whole``: lines of fewer characters have none; lines of longer words, on average, count by their runs of three characters.
LEAST_CHARS, LONG_WORD = 12, 16
#: Words in a sketch. Any COMMON of the first CHOICE are a key: with a tenth of the words changed two lines share one in
#: 98 %, with a fifth in 90 % of the cases. Lines with no more words than a sketch also have keys without one of them.
SKETCH, CHOICE, COMMON = 10, 6, 4
#: Parts that the keys are dealt out in, one after the other, to bound the disk they take.
PARTS = 2
#: Lines whose whole sketches share fewer words are not compared: with a fifth of the words changed, 1 % of the pairs.
LEAST_SHARED = 5
#: Halvings of a word's hash by its length, 0 to 10 characters: about the square of the length.
HALVINGS = (0, 0, 2, 3, 4, 5, 5, 6, 6, 6, 7)
#: Lines of more words are compared by units: a word is one unit for each so many of its characters, at least one.
#: Changed words keep about a fifth of their letters by chance, so this part of the units is like EDITS of the letters.
FEW_WORDS, UNIT, UNIT_EDITS = 10, 4, 0.25
#: The letters of units: enough that different words hardly ever count as equal.
FIRST_LETTER, LETTERS = 0x4E00, 20_992
#: Rounds that link most lines at little cost, before all pairs of what is still apart.
ROUNDS = 3
#: Lines of a bucket or a word that are compared with each other in one piece.
PIECE = 500
#: Words ahead of a rare word that are kept with it, so that most pairs are met once.
AHEAD = 32
#: Numbers of 64 bits with the parities of a line's units; a byte of a word's hash names the bit of a unit, so at most four.
PARITIES = 4

#: Layout of the bit counts: eight counters of 8 bits in a number, for runs of up to 127 words (more could
#: overflow the sign), or two of 32 bits.
_HASHES, _BLOCKS, _RUN = 2, 4, 127
_EIGHT = 0x0101010101010101
#: Characters that count as blank once a line is in lower case: ASCII but for the line feed, letters and digits.
_BLANK = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same runs but for those of one space, which stay as they are.
_OTHER_BLANK = r" [\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x09\x0B-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]" + _BLANK[:-1] + "*"


def normalised_lines(text: Column) -> Column:
    """The lines in lower case, with one blank for each run of ASCII characters that are no letters or digits.

    The whole text is changed at once, and then split where it was a line's end, with the blanks beside it.
    """
    return F.split(F.trim(F.regexp_replace(F.lower(text), _OTHER_BLANK, " ")), " ?\n ?", -1)


def lines_of(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, t, pos, norm, h, g) of every line with enough words; with ``whole``, of all that are not blank.

    ``t`` tells rows of one id apart by their text; ``h`` and ``g`` are independent, 128 bits together.
    """
    every = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(normalised_lines(F.col("text"))).alias("pos", "norm"))
    enough = F.col("norm").rlike(r"(?U)\S") if whole else _blanks() >= LEAST_WORDS - 1
    return every.where((F.col("norm") != "") & enough).withColumn("h", F.xxhash64("norm")).withColumn("g", F.xxhash64(F.lit(1), "norm"))


def _blanks() -> Column:
    return F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" ")))


def _blocks(bits: list[Column]) -> Column:
    return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(b.cast("long"), k) for k, b in enumerate(bits[i::_BLOCKS])]) for i in range(_BLOCKS)])


def with_simhash(lines: DataFrame) -> DataFrame:
    """(h, norm, ...) -> (h, blocks): four numbers of 32 bits.

    Each word adds its 128 hash bits to packed counters; a bit of the SimHash is one where most words have it. Lines of
    up to 127 words have one run of words, longer ones add up their runs in wider counters.
    """
    words = lines.select("h", F.posexplode(F.split("norm", " ")).alias("at", "w")).select("h", F.floor(F.col("at") / _RUN).cast("int").alias("run"), *[F.xxhash64("w", F.lit(q)).alias(f"x{q}") for q in range(_HASHES)])
    sums = [F.sum(F.shiftrightunsigned(f"x{q}", j).bitwiseAND(F.lit(_EIGHT))).alias(f"s{q}_{j}") for q in range(_HASHES) for j in range(8)]
    runs = cut(words.groupBy("h", "run").agg(F.count(F.lit(1)).alias("m"), *sums), "word-runs")
    long = runs.where("run > 0").select(F.col("h").alias("_h")).distinct()
    short = runs.join(long, F.col("h") == F.col("_h"), "left_anti")
    bits = [F.shiftrightunsigned(f"s{q}_{j}", 8 * i).bitwiseAND(F.lit(255)) * 2 > F.col("m") for q in range(_HASHES) for i in range(8) for j in range(8)]
    wide = [F.sum(F.shiftrightunsigned(f"s{q}_{j}", 8 * i).bitwiseAND(F.lit(0x000000FF000000FF))).alias(f"w{q}_{j}_{i}") for q in range(_HASHES) for j in range(8) for i in range(4)]
    added = runs.join(long, F.col("h") == F.col("_h"), "left_semi").groupBy("h").agg(F.sum("m").alias("m"), *wide)
    wide_bits = [F.shiftrightunsigned(f"w{q}_{j}_{i % 4}", 32 * (i // 4)).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("m") for q in range(_HASHES) for i in range(8) for j in range(8)]
    return short.select("h", _blocks(bits).alias("blocks")).union(added.select("h", _blocks(wide_bits).alias("blocks")))


def sketched(lines: DataFrame) -> DataFrame:
    """Adds ``chars``, ``words`` (null for lines too short to be compared) and the sketch s0, s1, ... in order, null beyond its end."""
    many = F.length("norm") > LONG_WORD * (_blanks() + 1)
    words = F.when(many, F.regexp_extract_all(F.replace(F.col("norm"), F.lit(" ")), F.lit("(?s)(?=(...))"), F.lit(1))).otherwise(F.split("norm", " "))
    halvings = F.array(*[F.lit(h) for h in HALVINGS])
    value = lambda w: F.call_function("shiftright", F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.get(halvings, F.least(F.length(w), F.lit(len(HALVINGS) - 1))))
    sketch = F.when(F.length("norm") >= LEAST_CHARS, F.sort_array(F.array_distinct(F.transform(words, value))))
    lines = lines.select("doc_id", "t", "pos", "h", "g", F.length("norm").alias("chars"), F.explode(F.array(sketch)).alias("_s"))
    return lines.select("doc_id", "t", "pos", "h", "g", "chars", F.size("_s").alias("words"), *[F.get("_s", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)])


def families(lines: DataFrame) -> list[DataFrame]:
    """(h, block) of the lines that are compared, in parts: combinations of sketched words, and short sketches without one."""
    sets = list(combinations(range(CHOICE), COMMON))
    key = lambda c: F.when(F.col(f"s{c[-1]}").isNotNull(), F.xxhash64(*[f"s{k}" for k in c]))
    every = lines.select("h", F.explode(F.array_compact(F.array(*map(key, sets)))).alias("block"))
    some = [every.where(F.pmod("block", F.lit(PARTS)) == i) for i in range(PARTS)]
    few = lines.where(F.col("words").between(2, SKETCH)).select("h", "words", F.slice(F.array(*[f"s{k}" for k in range(SKETCH)]), F.lit(1), F.col("words")).alias("ws"))
    without = F.transform(F.sequence(F.lit(1), F.col("words")), lambda i: F.concat(F.slice("ws", F.lit(1), i - 1), F.slice("ws", i + 1, F.col("words"))))
    short = few.select("h", F.explode(without).alias("ws")).union(few.select("h", "ws"))
    return [*some, short.select("h", F.xxhash64(F.lit(-1), "ws").alias("block")).distinct()]


def _sketches_meet(x: str, y: str) -> Column:
    """Sketches of like length share enough words; those that are whole lines need no more than all but one or two."""
    shared = F.size(F.array_intersect(x, y))
    return shared >= F.least(F.lit(LEAST_SHARED), F.least(F.size(x), F.size(y)) - 2)


def _shared(keys: DataFrame) -> DataFrame:
    """(block, h, low) of the buckets with different lines; ``low`` is the first of them."""
    bucket = Window.partitionBy("block")  # the keys are dealt out once, where a join would do so twice
    buckets = keys.select("block", "h", F.min("h").over(bucket).alias("low"), F.max("h").over(bucket).alias("high"))
    return cut(buckets.where("low <> high").select("block", "h", "low"), "members")


def _common_start(a: Column, b: Column) -> Column:
    """Length of the common start of two strings, up to 262,143: by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(17, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    same = lambda n: (n <= most) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(same(n + k), n + k).otherwise(n))


def _without_start(pairs: DataFrame, then) -> DataFrame:
    """(a, b, most, a_t, b_t) without the common start of the strings, each changed by ``then``.

    The generator keeps later filters from working the strings out anew for each mention.
    """
    pairs = pairs.withColumn("_n", _common_start(F.col("a_t"), F.col("b_t")))
    rest = F.struct(*[then(F.substring(F.col(c), F.col("_n") + 1, F.length(c))).alias(c) for c in ("a_t", "b_t")])
    return pairs.select("a", "b", "most", F.explode(F.array(rest)).alias("_t")).select("a", "b", "most", "_t.a_t", "_t.b_t")


def _bits_apart(x: str, y: str) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(_BLOCKS)])


def _confirmed(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The ones of (a, b) whose edit distance is at most EDITS of the longer line, or UNIT_EDITS of its units.

    What both start and end with doesn't count for the distance, so it is taken off first.
    """
    held = lambda to: lines.select(F.col("h").alias(to), F.col("norm").alias(f"{to}_t"), F.col("units").alias(f"{to}_u"))
    both = pairs.join(held("a"), "a").join(held("b"), "b")
    by_units = F.col("a_u").isNotNull() & F.col("b_u").isNotNull()
    both = both.select("a", "b", F.when(by_units, F.col("a_u")).otherwise(F.col("a_t")).alias("a_t"), F.when(by_units, F.col("b_u")).otherwise(F.col("b_t")).alias("b_t"), F.when(by_units, UNIT_EDITS).otherwise(EDITS).alias("part"))
    both = both.withColumn("most", F.floor(F.col("part") * F.greatest(F.length("a_t"), F.length("b_t"))).cast("int")).where("abs(length(a_t) - length(b_t)) <= most")
    both = _without_start(_without_start(both, F.reverse), F.reverse)
    # the work grows with the limit, and most pairs differ in little
    return both.where("greatest(length(a_t), length(b_t)) <= most or levenshtein(a_t, b_t, most div 16) >= 0 or levenshtein(a_t, b_t, most div 4) >= 0 or levenshtein(a_t, b_t, most) >= 0").select("a", "b")


def _texts(docs: DataFrame, occurrences: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, g, norm) of the asked lines, each from its first occurrence; of different lines with one ``h``, the one with the least ``g``.

    The documents are dealt out in parts, one after the other, to bound the disk they take.
    """
    one = occurrences.join(asked, F.col("h") == F.col("_h"), "left_semi").groupBy("h").agg(F.min(F.struct("g", "doc_id", "t", "pos")).alias("o"))
    wanted = cut(one.groupBy(F.col("o.doc_id").alias("_doc"), F.col("o.t").alias("_t")).agg(F.collect_list(F.struct("h", "o.g", "o.pos")).alias("wanted")), "wanted")
    held = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    some = [cut(_lines_of_documents(held.where(F.pmod("t", F.lit(PARTS)) == i), wanted.where(F.pmod("_t", F.lit(PARTS)) == i)), "texts") for i in range(PARTS)]
    drop(wanted)
    return reduce(DataFrame.union, some)


def _lines_of_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, g, norm, units) of the wanted lines of the documents (doc_id, t, text)."""
    own = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("t") == F.col("_t")))
    # rows of one id and text give the same lines
    found = own.select(F.explode(_let(F.split("text", "\n", -1), lambda lines: F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), w["g"].alias("g"), F.get(lines, w["pos"]).alias("line"))))).alias("w"))
    norm = F.trim(F.regexp_replace(F.lower("w.line"), _OTHER_BLANK, " "))
    found = found.select("w.h", "w.g", norm.alias("norm")).dropDuplicates(["h"])
    return found.withColumn("units", _units("norm"))


def _units(norm: str) -> Column:
    """A line of more than FEW_WORDS words as a string of units; one of LETTERS letters stands for each word."""
    letter = lambda w: F.decode(F.unhex(F.hex(F.lit(FIRST_LETTER) + F.pmod(F.xxhash64(w), F.lit(LETTERS)))), "UTF-16BE")
    words = F.split(norm, " ")
    return F.when(F.size(words) > FEW_WORDS, F.array_join(F.transform(words, lambda w: F.repeat(letter(w), _weight(w))), ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _left_over(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(block, h, low) of the members that are not in the component of their bucket's first, with the first of them."""
    of = lambda c: comps.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"{c}_comp"))
    at = members.join(of("h"), F.col("h") == F.col("_h"), "left").join(of("low"), F.col("low") == F.col("_low"), "left")
    rest = cut(at.where(F.coalesce("h_comp", "h") != F.coalesce("low_comp", "low")).select("block", "h"), "left-over")
    first = rest.groupBy(F.col("block").alias("_b")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    return rest.join(first, F.col("block") == F.col("_b")).select("block", "h", "low")


def _weight(w: Column) -> Column:
    """Units that a word stands for."""
    return F.greatest(F.lit(1), F.ceil(F.length(w) / UNIT).cast("int"))


def _parities() -> list[Column]:
    """Parities p0, p1, ... of the bits that a line's words (x, k units) name: one for each unit, up to four for a word.

    An edit changes one unit or swaps one for another. So two lines have no more different bits than twice the edits
    between them, less one for each unit that one is longer.
    """
    at = [F.shiftrightunsigned("x", 8 * j).bitwiseAND(F.lit(64 * PARITIES - 1)).cast("int") for j in range(4)]
    bit = lambda j, q: F.when((F.col("k") > j) & (F.call_function("shiftright", at[j], F.lit(6)) == q), F.call_function("shiftleft", F.lit(1).cast("long"), at[j].bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
    return [F.bit_xor(reduce(lambda a, b: a.bitwiseXOR(b), [bit(j, q) for j in range(4)])).alias(f"p{q}") for q in range(PARITIES)]


def _rare_words(words: DataFrame) -> DataFrame:
    """Words (h, c, x, k units) of lines -> (x, h, c, u, b, before, p0, ...): each line's rarest words, which a like line can't all lack.

    Lines within UNIT_EDITS of ``u`` units have all but so many of the longer one's units in common. So in one order of all
    words the first they have in common has at most so many units ``b`` before it in either. Rare words come first, which
    decides the cost and not the result. ``before`` are the AHEAD words of the line, at most, that come right before this one.
    """
    counts = words.groupBy(F.col("x").alias("_x")).agg(F.count(F.lit(1)).alias("n"))
    at = words.join(counts, F.col("x") == F.col("_x")).groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct("n", "x", "k"))).alias("_w"), *_parities())
    bits = [f"p{q}" for q in range(PARITIES)]
    at = at.select("h", "c", *bits, F.explode(F.array(F.flatten(F.transform("_w", lambda w: F.array_repeat(w["x"], w["k"]))))).alias("_u"))
    at = at.select("h", "c", *bits, "_u", F.explode(F.array(F.array_distinct(F.slice("_u", F.lit(1), F.floor(F.size("_u") * UNIT_EDITS).cast("int") + 1)))).alias("_p"))
    with_place = F.transform("_p", lambda x: F.struct(x.alias("x"), (F.call_function("array_position", "_u", x) - 1).cast("int").alias("b")))
    at = at.select("h", "c", *bits, F.size("_u").alias("u"), "_p", F.posexplode(with_place).alias("_k", "_x"))
    return at.select("_x.x", "h", "c", *bits, "u", "_x.b", F.slice("_p", F.greatest(F.lit(1), F.col("_k") - AHEAD + 1), F.least(F.col("_k"), F.lit(AHEAD))).alias("before"))


def _long_apart(lines: DataFrame) -> DataFrame:
    """(a, b) of the lines (h, c, norm) with units, different ``c``, and enough units in common by two bounds: each pair once.

    One counts the units before the word that two lines meet over, the other the parities in which they differ. Both are
    exact, so they rule out no like pair.

    A word's lines are dealt into pieces that meet two by two under keys of their own. A component of more lines than a piece has one for
    itself, which does not meet itself: no time goes into pairs of one component, however large.
    """
    words = lines.select("h", "c", F.explode(F.split("norm", " ")).alias("w")).select("h", "c", F.xxhash64("w").alias("x"), _weight(F.col("w")).alias("k"))
    words, bits = cut(words, "apart-words"), [f"p{q}" for q in range(PARITIES)]
    rare = cut(_rare_words(words), "rare")
    drop(words)
    of_word = rare.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("x").alias("_x")).agg(F.count(F.lit(1)).alias("cs"), F.ceil(F.sum("n") / PIECE).cast("int").alias("n"), F.collect_list(F.when(F.col("n") > PIECE, F.col("c"))).alias("large")).where("cs > 1")
    own_piece = lambda c: -1 - F.pmod(c, F.lit(1 << 62))
    rows = rare.join(of_word, F.col("x") == F.col("_x")).withColumn("alone", F.array_contains("large", F.col("c")))
    rows = rows.withColumn("own", F.when(F.col("alone"), own_piece(F.col("c"))).otherwise(F.pmod(F.xxhash64("h"), F.col("n"))))
    every = F.concat(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), F.transform("large", own_piece))
    rows = rows.select("x", "h", "c", *bits, "u", "b", "before", "own", "alone", F.explode(every).alias("_o")).where("not (alone and own = _o)")
    rows = cut(rows.select("x", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "h", "c", *bits, "u", "b", "before"), "rare-pieces")
    of = lambda to, piece: rows.where(F.col("own") == F.col(piece)).select("x", "i", "j", F.col("h").alias(to), *[F.col(k).alias(f"{to}_{k}") for k in ("c", *bits, "u", "b", "before")])
    pairs = of("a", "i").join(of("b", "j"), ["x", "i", "j"]).where("(i <> j or a < b) and a_c <> b_c")
    longer = F.greatest("a_u", "b_u")
    enough = F.least(F.col("a_u") - F.col("a_b"), F.col("b_u") - F.col("b_b")) >= longer - F.floor(longer * UNIT_EDITS)
    odd = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in bits])
    enough = enough & (odd <= 2 * F.floor(longer * UNIT_EDITS) - F.abs(F.col("a_u") - F.col("b_u")))
    found = cut(pairs.where(enough).where(~F.arrays_overlap("a_before", "b_before")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    drop(rare, rows)
    return found


def _short_apart(rows: DataFrame, lines: DataFrame, hashes: DataFrame, close) -> DataFrame:
    """(a, b) with close sketches and like lengths of the rows (block, h, c) that share a bucket, one of them at least without units.

    The lines of a bucket are dealt into pieces, which those without units meet: no task has a whole bucket.
    """
    rows = rows.join(lines.select("h", "chars", "few"), "h").join(hashes, "h")
    some = rows.groupBy(F.col("block").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("n")).join(rows.where("few").select(F.col("block").alias("_f")).distinct(), F.col("_b") == F.col("_f"), "left_semi")
    rows = rows.join(some, F.col("block") == F.col("_b"))
    of = lambda to, part, piece: rows.where(part).select("block", piece.alias("piece"), F.col("h").alias(to), *[F.col(k).alias(f"{to}_{k}") for k in ("c", "chars", "few", "x")])
    both = of("a", "few", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(of("b", "true", F.pmod(F.xxhash64("h"), F.col("n")).cast("int")), ["block", "piece"])
    near = F.abs(F.col("a_chars") - F.col("b_chars")) <= F.floor(F.greatest("a_chars", "b_chars") * EDITS)
    pairs = both.where("a_c <> b_c and (a < b or not b_few)").where(near).where(close("a_x", "b_x"))
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _still_apart(members: DataFrame, comps: DataFrame, hashes: DataFrame, texts: DataFrame, close) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the lines that share a bucket with one of another component: all that may be like by what rules none out.

    Lines that are compared by units meet over their rare words, whatever buckets they have; the others, and those with
    them, in their buckets.
    """
    named = members.select("block", "h").join(comps.select(F.col("node").alias("_h"), "component"), F.col("h") == F.col("_h"), "left").select("block", "h", F.coalesce("component", "h").alias("c"))
    apart = named.groupBy(F.col("block").alias("_b")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    rows = cut(named.join(apart, F.col("block") == F.col("_b")).select("block", "h", "c"), "apart")
    held = texts.select(F.col("h").alias("_h"), "norm", F.length("norm").alias("chars"), F.col("units").isNull().alias("few"))
    lines = cut(rows.select("h", "c").distinct().join(held, F.col("h") == F.col("_h")).drop("_h"), "apart-lines")
    pairs = _long_apart(lines.where("not few").select("h", "c", "norm")), _short_apart(rows, lines, hashes, close)
    drop(rows, lines)
    return pairs


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components that further links leave; the table of those before goes."""
    after = cut(grown(comps, links, "a", "b"), "components")
    if comps is not None:
        drop(comps)
    return after


def line_groups(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, t, pos, h, g), and (h, g, comp) of the distinct lines that occur again or have others like them."""
    if whole:
        every = cut(sketched(lines_of(docs, whole)), "sketches")
        sketch = [f"s{k}" for k in range(SKETCH)]
        occurrences = cut(every.select("doc_id", "t", "pos", "h", "g"), "occurrences")
        lines = cut(every.groupBy("h", "g", "words").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in sketch]), "lines")
        drop(every)
        parts, held, close = families(lines), "sketch", _sketches_meet
        hashes = lines.select("h", F.array_compact(F.array(*sketch)).alias("sketch"))
    else:
        every = lines_of(docs)
        occurrences = cut(every.select("doc_id", "t", "pos", "h", "g").distinct(), "occurrences")
        lines = cut(every.groupBy("h", "g", "norm").agg(F.count(F.lit(1)).alias("n")), "lines")
        hashes = cut(with_simhash(lines), "simhashes")
        parts, held, close = [hashes.select("h", F.posexplode("blocks").alias("k", "b")).select("h", F.xxhash64("k", "b").alias("block"))], "blocks", lambda x, y: _bits_apart(x, y) <= MOST_BITS
    members = reduce(DataFrame.union, [_shared(p) for p in parts])
    # most lines share no bucket: what is compared is small beside what is counted
    asked = cut(members.select(F.col("h").alias("_h")).distinct(), "asked")
    near = cut(hashes.join(asked, F.col("h") == F.col("_h"), "left_semi"), "near")
    counts = cut(lines.select("h", "g", "n"), "counts")
    drop(hashes, lines)
    hashes, lines = near, counts
    texts = _texts(docs, occurrences, asked)
    drop(asked)
    of = lambda to: hashes.select(F.col("h").alias(to), F.col(held).alias(f"{to}_x"))
    tried, links, comps = [], [], None
    shared = members
    for i in range(ROUNDS):
        if i:
            members = cut(_left_over(members, comps), "members")
        stars = members.where("h <> low").select(F.col("low").alias("a"), F.col("h").alias("b")).distinct()
        for before in tried:
            stars = stars.join(before, ["a", "b"], "left_anti")
        stars = cut(stars.join(of("a"), "a").join(of("b"), "b").where(close("a_x", "b_x")).select("a", "b"), "stars")
        tried.append(stars)
        links.append(cut(_confirmed(stars, texts), "links"))
        comps = _joined(comps, links[-1])
    pairs = _still_apart(shared, comps, hashes.select("h", F.col(held).alias("x")), texts, close)
    rest = reduce(DataFrame.union, pairs).join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
    tried += pairs
    links.append(cut(_confirmed(rest, texts), "links"))
    comps = _joined(comps, links[-1])
    # only the line whose text was compared has the component
    named = comps.join(texts.select(F.col("h").alias("_h"), F.col("g").alias("_g")), F.col("node") == F.col("_h")).select("_h", "_g", "component")
    groups = lines.select("h", "g", "n").join(named, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    groups = cut(groups.where("n > 1 or component is not null").select("h", "g", F.coalesce("component", "h").alias("comp")), "groups")
    drop(hashes, lines, members, shared, texts, comps, *tried, *links)
    return occurrences, groups


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with the text that remains, ``n_lines`` and ``n_dropped``.

    Lines end with a line feed. Of each group of like lines the occurrence with the least (doc_id, position) stays, null
    ids last; blank lines stay always, and without ``whole`` those of fewer than LEAST_WORDS words. Lines of any length are
    compared whole. Rows that share an id but not the text are different documents; rows equal in both are one, and each keeps what that one keeps. Null texts stay
    null with no line, empty texts have one empty line; a text whose lines all go is empty, its row stays. An empty table
    stays empty; columns of ``docs`` named like the new ones give way.
    """
    docs = docs.drop("n_lines", "n_dropped")
    occurrences, groups = line_groups(docs, whole)
    at = occurrences.join(groups.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "comp"), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")))
    at = cut(at.select("doc_id", "t", "pos", "comp"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("t").alias("t"), F.col("pos").alias("pos"))
    first = at.groupBy(F.col("comp").alias("_c")).agg(F.min(rank).alias("first"))
    gone = at.join(first, F.col("comp") == F.col("_c")).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")) & (F.col("pos") == F.col("first.pos"))))
    gone = cut(gone.groupBy(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("_gone")), "gone")
    drop(occurrences, groups, at)
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_t")), "left")
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    new = F.when(F.col("_gone").isNotNull(), F.array_join(_lines_but(F.col("text"), F.col("_gone")), "\n")).otherwise(F.col("text"))
    both = both.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long")).withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
    return both.withColumn("text", new).select(*docs.columns, "n_lines", "n_dropped")


def _lines_but(text: Column, gone: Column) -> Column:
    """The lines of a text whose numbers are not in ``gone``; the text is split once."""
    return _let(F.split(text, "\n", -1), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)))
