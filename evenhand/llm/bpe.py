"""BPE encoding and decoding in batched merge rounds.

Texts fall into blank-separated chunks, chunks into the words of the vocabulary's pattern. All words that a batch needs and
that are not yet known are merged together: their symbols lie in one flat array, every round looks up all
neighbouring pairs at once by binary search over the sorted pair keys, and each word merges its lowest-ranked pair.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces, python_ready

#: The word pattern of the vocabulary, and what counts as blank to it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Chunks and words a worker knows at a time; longer ones it does not keep.
KEPT, KEPT_LENGTH = 300_000, 80

_WORDS = regex.compile(PATTERN.replace(r"\s", BLANKS))
_BLANK = regex.compile(f"[{BLANKS}]+")
_ODD = regex.compile(r"[\x1c-\x1f]")  # blanks to str.split, not to the vocabulary


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level vocabulary whose words end in a suffix; ``path`` names its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.base
        for name, i in chain(vocab.items(), self.special.items()):
            self.names[i] = name
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each non-empty word."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(x) for x in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), np.uint8)
        ids, word = self.inner[flat], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.final[flat[ends]]
        out: list[list[int]] = [[]] * len(words)
        none = len(self.ranks)
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank, to = np.full(len(ids), none, np.int64), np.zeros(len(ids), np.int64)
            pair = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            hit = (self.keys[at] == pair) & (word[1:] == word[:-1])
            rank[:-1][hit], to[:-1][hit] = self.ranks[at[hit]], self.joined[at[hit]]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            done = least == none
            if done.any():
                over = word[done]
                begin = np.flatnonzero(np.r_[True, over[1:] != over[:-1]])
                listed = ids[done].tolist()
                for w, i, j in zip(over[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(listed)], strict=True):
                    out[w] = listed[i:j]
                ids, word, rank, to, least = (x[~done] for x in (ids, word, rank, to, least))
                if not len(ids):
                    break
            chosen = np.flatnonzero(rank == least)
            # of pairs that overlap, as in aaa, every second one from the left is merged
            run = np.flatnonzero(np.r_[True, np.diff(chosen) != 1])
            nth = np.arange(len(chosen)) - np.repeat(run, np.diff(np.r_[run, len(chosen)]))
            chosen = chosen[nth % 2 == 0]
            ids[chosen] = to[chosen]
            stay = np.ones(len(ids), bool)
            stay[chosen + 1] = False
            ids, word = ids[stay], word[stay]
        return out

    def _words(self, chunk: str) -> list[str | int]:
        """Words of a chunk; the ids of special tokens, which are taken before anything is normalised."""
        found: list[str | int] = []
        for part in self.split.split(chunk) if self.split and "<|" in chunk else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += _WORDS.findall(part)
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        chunks = [(_BLANK.split(t) if _ODD.search(t) else t.split()) if t else [] for t in texts]
        for kept in (self.known, self.words):
            if len(kept) > KEPT:
                kept.clear()
        new = list(set(chain.from_iterable(chunks)).difference(self.known))
        parts = [self._words(x) for x in new]
        fresh = list({w for p in parts for w in p if isinstance(w, str)}.difference(self.words))
        if fresh:
            self.words.update(zip(fresh, self.merge(fresh), strict=True))
        ids = self.words
        self.known.update(zip(new, [ids[p[0]] if len(p) == 1 and p[0] in ids else [i for w in p for i in (ids[w] if isinstance(w, str) else (w,))] for p in parts], strict=True))
        get = self.known.__getitem__
        out = [list(chain.from_iterable(map(get, c))) for c in chunks]
        for kept, used in ((self.known, new), (self.words, fresh)):
            for x in used:
                if len(x) > KEPT_LENGTH:
                    del kept[x]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Token names joined by a blank: the vocabulary has no decoder of its own."""
        name = self.names.__getitem__
        return [" ".join(map(name, x)) for x in ids]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBpe:
    """Once a worker and path."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, special tokens of the text included, none added) and ``decoded``.

    Null and empty texts give an empty array and an empty string; nothing is cut off, repeated rows stay, an empty table
    stays empty. Columns of ``docs`` named ``ids`` or ``decoded`` give way.
    """
    docs = docs.drop("ids", "decoded")
    python_ready(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for some in pieces(batch, text):
                ids = bpe.encode(some.column(some.schema.get_field_index(text)).to_pylist())
                sizes = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(bpe.decode(ids), pa.string())],
                    names=[*some.schema.names, "ids", "decoded"],
                )

    return docs.mapInArrow(run, schema)
