"""Fill-in-the-middle over a succinct index of token boundaries.

All texts of a batch lie in one byte buffer. A packed bitvector has a one at every byte where a token starts, and a
directory holds the number of ones before each block of 64 bytes of it. Rank (ones before a byte) gives a text's number of
tokens, select (byte of the k-th one) gives the two cuts; no token is ever made into a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, python_ready, whole_text

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of the packed bitvector in a block of the directory.
BLOCK = 64

_ADDED = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
)


class Boundaries:
    """Rank and select over the bits that mark where tokens start in ``data`` (UTF-8 bytes of texts that begin at ``starts``).

    A token is a run of ASCII letters or any other single code point; none crosses from one text to the next.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        letter = ((data | 0x20) - np.uint8(97)) < 26
        follows = np.zeros(len(data), bool)
        follows[1:] = letter[:-1]
        follows[starts[starts < len(data)]] = False
        bits = ((data & 0xC0) != 0x80) & ~(letter & follows)
        self.packed = np.packbits(bits, bitorder="little")
        spare = -len(self.packed) % BLOCK
        self.ones = np.bitwise_count(np.r_[self.packed, np.zeros(spare, np.uint8)]).reshape(-1, BLOCK)
        self.before = np.r_[0, np.cumsum(self.ones.sum(axis=1, dtype=np.int64))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of the bytes ``at``."""
        byte, bit = at >> 3, (at & 7).astype(np.uint8)
        block, inner = byte // BLOCK, byte % BLOCK
        block = np.minimum(block, max(len(self.ones) - 1, 0))
        inner = byte - block * BLOCK
        if not len(self.ones):
            return np.zeros(len(at), np.int64)
        part = np.where(np.arange(BLOCK) < inner[:, None], self.ones[block], 0).sum(axis=1, dtype=np.int64)
        last = self.packed[np.minimum(byte, len(self.packed) - 1)] & ((np.uint8(1) << bit) - np.uint8(1))
        return self.before[block] + part + np.where(byte < len(self.packed), np.bitwise_count(last), 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the one with each of the ranks ``k`` (from 0), which have to exist."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        run = np.cumsum(self.ones[block], axis=1, dtype=np.int64)
        inner = (run <= left[:, None]).sum(axis=1)
        left = left - np.where(inner > 0, run[np.arange(len(k)), np.maximum(inner - 1, 0)], 0)
        byte = block * BLOCK + inner
        bits = np.cumsum(np.unpackbits(self.packed[byte][:, None], axis=1, bitorder="little"), axis=1)
        return byte * 8 + (bits <= left[:, None]).sum(axis=1)


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and the bytes within it where the prefix and the middle end.

    They end after the smaller and the larger of ``first`` and ``second`` modulo tokens plus one.
    """
    wide = texts.cast(pa.large_string())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    marks = Boundaries(data, ends[:-1])
    ranks = marks.rank(ends)
    n = np.diff(ranks)
    a, b = first % (n + 1), second % (n + 1)

    def byte(units: np.ndarray) -> np.ndarray:
        at = np.diff(ends)
        some = units < n
        at[some] = marks.select((ranks[:-1] + units)[some]) - ends[:-1][some]
        return at

    return n, byte(np.minimum(a, b)), byte(np.maximum(a, b))


def _hash_group(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 90, swapped: int = 20, seed: str = "1", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; what ``docs`` has under these names gives way.

    ``rate`` of 100 texts are transformed, ``swapped`` of 100 of those with the suffix first (``spm``, else ``psm``), by hashes
    of ``seed`` and ``doc_id``: rows that share an id share their draws, null ids count as the empty text. A text that is
    null, empty or holds one of the marks stays ``plain``, whole and without character counts (a null one becomes empty);
    cuts never split a code point, and however long a text is, all of it is in its output. An empty table stays empty.
    """
    docs = docs.drop(*_ADDED.fieldNames())
    python_ready(docs.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    whole, own = whole_text(text), docs.columns
    forced = (whole == "") | F.greatest(*[F.instr(whole, m) for m in MARKS]).__gt__(0)
    form = F.when(forced | (_hash_group(hashed, 2) % 100 >= rate), "plain").when(_hash_group(hashed, 3) % 100 < swapped, "spm").otherwise("psm")
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), whole.alias("whole"), form.alias("form"), _hash_group(hashed, 0).alias("h1"), _hash_group(hashed, 1).alias("h2"))
    schema = T.StructType([ready.schema["row"], *_ADDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "whole"):
                whole, form = some.column(1), some.column(2)
                n, one, two = cuts(whole, some.column(3).to_numpy(), some.column(4).to_numpy())
                out, before, within = [], [], []
                for x, kind, i, j in zip(whole.to_pylist(), form.to_pylist(), one.tolist(), two.tolist(), strict=True):
                    if kind == "plain":
                        out.append(x)
                        before.append(None)
                        within.append(None)
                        continue
                    coded = x.encode()
                    prefix, middle, suffix = coded[:i].decode(), coded[i:j].decode(), coded[j:].decode()
                    p, s, m = MARKS
                    out.append(p + prefix + s + suffix + m + middle if kind == "psm" else s + suffix + p + prefix + m + middle)
                    before.append(len(prefix))
                    within.append(len(middle))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), form, pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.string())], names=["row", *_ADDED.fieldNames()])

    return ready.mapInArrow(run, schema).select("row.*", *_ADDED.fieldNames())


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks occur in a transformed output only where they were put."""
    part = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
