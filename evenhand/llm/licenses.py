"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is read once. Every run of tokens as long as a template is compared with it: a running sum gives the dot products of
all runs, another one bounds their norms, and only runs that can reach the least cosine are scored exactly. As rivals differ
in a word or a number only, a licence also names the words that its notice must and must not have.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, python_ready


class Licence(NamedTuple):
    """Notices of a licence; of each set in ``needs`` a notice has one word at least, and none of ``bars``."""

    texts: tuple[str, ...]
    needs: tuple[frozenset[str], ...] = ()
    bars: frozenset[str] = frozenset()


_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."


def _notices(*names: str) -> tuple[str, ...]:
    return tuple(f"{verb} under the {n}." for n in names for verb in ("Released", "Licensed", "This work is licensed", "Distributed"))


def _gnu(name: str, versions: tuple[str, ...]) -> tuple[str, ...]:
    whole = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    short = "This {} is free software: you can redistribute it and modify it under the terms of the {}, version {}."
    kinds = ("library", "program") if "Lesser" in name else ("program",)
    found = [f"{name}, version {v}." for v in versions]
    return (*_notices(*found), *(t.format(k, name, v) for t in (whole, short) for k in kinds for v in versions), *(f"{name} Version {v}" for v in versions))


def _commons(name: str, code: str) -> tuple[str, ...]:
    kind = f"Creative Commons {name} 4.0 International License"
    return (f"Licensed under CC {code} 4.0.", f"This work is licensed under a {kind}.", f"This work is licensed under the {kind}.", f"Creative Commons {name} 4.0 International Public License", f"Licensed under a Creative Commons {name} 4.0 license.")


def _any(*words: str) -> frozenset[str]:
    return frozenset(words)


_NC, _SA, _ND, _ZERO = _any("noncommercial", "nc", "commercial"), _any("sharealike", "sa", "alike"), _any("noderivatives", "noderivs", "nd", "derivatives"), _any("cc0", "zero", "universal")
_CREATIVE, _FOUR = _any("creative", "cc"), _any("4.0", "4")
_TWO, _THREE, _LESSER, _AFFERO = _any("2", "2.0", "gplv2"), _any("3", "3.0", "gplv3", "lgplv3", "agplv3"), _any("lesser", "library", "lgpl", "lgplv3"), _any("affero", "agpl", "agplv3")
_GNU = _any("gnu", "gpl", "lgpl", "agpl")

#: Notices, headings and short full texts, by identifier.
LICENCES = {
    "0BSD": Licence((_notices("BSD Zero Clause License")), (_any("zero", "0", "0bsd"), _any("bsd", "0bsd"))),
    "AGPL-3.0": Licence(_gnu("GNU Affero General Public License", ("3",)), (_AFFERO, _THREE)),
    "Apache-1.1": Licence((*_notices("Apache License, Version 1.1", "Apache Software License, Version 1.1"), "Apache Software License Version 1.1"), (_any("apache"), _any("1.1"))),
    "Apache-2.0": Licence(
        (*_notices("Apache License, Version 2.0", "Apache License 2.0"), "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"),
        (_any("apache"), _any("2.0", "2")), _any("1.1", "1.0"),
    ),
    "BSD-2-Clause": Licence((_BSD, *_notices("BSD 2-Clause License", "Simplified BSD License")), (), _any("neither", "endorse", "3", "zero")),
    "BSD-3-Clause": Licence((_BSD + _BSD3, *_notices("BSD 3-Clause License", "New BSD License", "Modified BSD License")), (_any("3", "neither", "new", "modified"),)),
    "CC-BY-4.0": Licence(_commons("Attribution", "BY"), (_CREATIVE, _FOUR, _any("attribution", "by")), _NC | _SA | _ND | _ZERO),
    "CC-BY-NC-4.0": Licence(_commons("Attribution-NonCommercial", "BY-NC"), (_CREATIVE, _FOUR, _NC), _SA | _ND),
    "CC-BY-NC-ND-4.0": Licence(_commons("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"), (_CREATIVE, _FOUR, _NC, _ND)),
    "CC-BY-NC-SA-4.0": Licence(_commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), (_CREATIVE, _FOUR, _NC, _SA)),
    "CC-BY-ND-4.0": Licence(_commons("Attribution-NoDerivatives", "BY-ND"), (_CREATIVE, _FOUR, _ND), _NC),
    "CC-BY-SA-4.0": Licence(_commons("Attribution-ShareAlike", "BY-SA"), (_CREATIVE, _FOUR, _SA), _NC),
    "CC0-1.0": Licence(("Licensed under CC0 1.0.", "This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "Creative Commons Legal Code CC0 1.0 Universal"), (_any("cc0"),)),
    "EPL-2.0": Licence((*_notices("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"), "Eclipse Public License - v 2.0"), (_any("eclipse", "epl"), _any("2.0"))),
    "GPL-2.0": Licence(_gnu("GNU General Public License", ("2",)), (_GNU, _TWO), _LESSER | _AFFERO | _any("3", "2.1")),
    "GPL-3.0": Licence(_gnu("GNU General Public License", ("3",)), (_GNU, _THREE), _LESSER | _AFFERO | _any("2", "2.0", "2.1")),
    "ISC": Licence((_ISC, *_notices("ISC License")), (_any("isc", "fee"),)),
    "LGPL-2.1": Licence(_gnu("GNU Lesser General Public License", ("2.1",)), (_LESSER, _any("2.1"))),
    "LGPL-3.0": Licence(_gnu("GNU Lesser General Public License", ("3",)), (_LESSER, _THREE), _any("2.1", "2")),
    "MIT": Licence((_MIT, *_notices("MIT License"), "MIT License", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. MIT License."), (_any("mit", "hereby"),)),
    "MPL-2.0": Licence((*_notices("Mozilla Public License, version 2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"), (_any("mozilla", "mpl"), _any("2.0"))),
    "Unlicense": Licence((_UNLICENSE, *_notices("Unlicense")), (_any("unlicense", "unencumbered"),)),
}
#: One of these stands in every notice; and what the words have in common, as they are looked for in a text first.
SAYS, SAID = _any("license", "licensed", "licence", "licenced", "licenses", "unlicense", "permission", "redistribution", "redistributions", "commons", "unencumbered"), ("licen", "permission", "redistribution", "commons", "unencumbered")
LICENCES = {name: x._replace(texts=(*x.texts, f"SPDX-License-Identifier: {name}"), needs=(*x.needs, SAYS)) for name, x in LICENCES.items()}
TEMPLATES = {name: list(x.texts) for name, x in LICENCES.items()}
#: Least cosine of a notice, and the share of a file's words that makes it a licence file whatever its name.
LEAST_COSINE, LICENCE_SHARE = 0.8, 0.5
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: What turns a notice round, as a phrase of its tokens.
_DENIED = re.compile(r"\b(?:not|never|neither|no longer|isn t|aren t|wasn t)(?: [a-z]+){0,2} (?:licen[cs]ed|released|distributed|available|covered|published|under)\b")
FOUND = T.StructType([T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("line", T.IntegerType()), T.StructField("share", T.DoubleType())])


class Matcher:
    """Inverse document frequencies over the templates, and their unit vectors."""

    def __init__(self, templates: dict[str, list[str]], rules: dict[str, Licence] | None = None):
        flat = [(name, Counter(_TOKEN.findall(t.lower()))) for name, texts in sorted(templates.items()) for t in texts]
        self.rules = rules or {}
        self.names = [name for name, _ in flat]
        df = Counter(w for _, c in flat for w in c)
        self.idf = {w: math.log(1 + len(flat) / n) for w, n in df.items()}
        self.other = math.log(1 + len(flat))  # of words that no template has
        self.ids = {w: i for i, w in enumerate(df)}
        self.weights = np.array([*self.idf.values(), self.other])  # the last one stands for all other words
        vectors = np.zeros((len(df) + 1, len(flat)))
        for i, (_, c) in enumerate(flat):
            for w, n in c.items():
                vectors[self.ids[w], i] = n * self.idf[w]
        self.vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(0)), 1e-300)
        self.lengths = np.array([sum(c.values()) for _, c in flat], int)
        # words of which every notice has one: those that all rules ask for, else any
        common = [set(r.needs) for r in self.rules.values()]
        self.said = SAYS if common and all(SAYS in c for c in common) and set(self.names) <= set(self.rules) else None

    def dots(self, words: list[str]) -> tuple[np.ndarray, float]:
        """Cosines of a run of words with all templates."""
        counts = Counter(self.ids.get(w, -1) if w in self.ids else w for w in words)
        norm = sum((n * (self.weights[k] if isinstance(k, int) else self.other)) ** 2 for k, n in counts.items())
        dot = sum((n * self.weights[k] * self.vectors[k] for k, n in counts.items() if isinstance(k, int)), np.zeros(len(self.names)))
        return dot / math.sqrt(norm) if norm else dot

    def best(self, line: str) -> tuple[float, str] | None:
        """The template nearest to a line as a whole, whatever the rules."""
        words = _TOKEN.findall(line.lower())
        cosines = self.dots(words) if words else np.zeros(1)
        return (min(1.0, float(cosines.max())), self.names[int(cosines.argmax())]) if cosines.max() > 0 else None

    def holds(self, name: str, words: list[str], before: list[str]) -> bool:
        """Whether a run, with the words just before it, has what its licence asks for and nothing that speaks against it."""
        rule, have = self.rules.get(name), set(words)
        if rule and (not all(need & have for need in rule.needs) or rule.bars & have):
            return False
        return not _DENIED.search(" ".join([*before, *words]))

    def runs(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of all runs as long as the template, or as the text, that have a word of ``said`` and whose bound
        reaches the least cosine."""
        ids = np.array([self.ids.get(w, -1) for w in words], int)
        said = self.ids.keys() if self.said is None else self.said
        hits = np.array([i for i, w in enumerate(words) if w in said], int)
        if not len(hits):
            return
        squares = np.r_[0.0, np.cumsum(self.weights[ids] ** 2)]
        for length in np.unique(self.lengths):
            some = np.flatnonzero(self.lengths == length)
            n = min(int(length), len(words))
            firsts, lasts = np.maximum(hits - n + 1, 0), np.minimum(hits, len(words) - n)  # starts of the runs with each of them
            part = np.r_[0, np.flatnonzero(firsts[1:] > np.maximum.accumulate(lasts)[:-1]) + 1, len(hits)]
            values = self.weights[:, None] * self.vectors[:, some]
            for i, j in zip(part[:-1], part[1:], strict=True):
                lo, hi = int(firsts[i]), int(lasts[j - 1]) + 1
                if lo >= hi:
                    continue
                sums = np.vstack([np.zeros(len(some)), np.cumsum(values[ids[lo : hi + n - 1]], axis=0)])
                norms = np.sqrt(squares[lo + n : hi + n] - squares[lo:hi])  # a word that recurs in a run makes its norm larger still
                at, which = np.nonzero(sums[n:] - sums[:-n] >= (LEAST_COSINE - 1e-9) * norms[:, None])
                yield from ((int(some[k]), lo + int(x), lo + int(x) + n) for x, k in zip(at, which, strict=True))

    def scan(self, text: str | None) -> dict | None:
        """The likeliest notice of a text; of equal ones the first, then the one of the lesser name."""
        low = (text or "").lower()  # once, as some letters change their length
        if self.said is not None and not any(w in low for w in SAID):
            return None
        spans = list(_TOKEN.finditer(low))
        words = [m[0] for m in spans]
        best = None
        for i, start, end in self.runs(words) if words else ():
            cosine = min(1.0, float(self.dots(words[start:end])[i]))
            if cosine < LEAST_COSINE or not self.holds(self.names[i], words[start : end + 4], words[max(0, start - 8) : start]):
                continue
            rank = (-round(cosine, 9), start, self.names[i], end)
            if best is None or rank < best:
                best = rank
        if best is None:
            return None
        far, start, name, end = best
        return {"licence": name, "cosine": -far, "line": low.count("\n", 0, spans[start].start()), "share": (end - start) / len(words)}


def detect(files: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``files`` with ``found``: licence, cosine, line and share of words of the likeliest notice, or null.

    The built-in templates come with their rules; given ones go by cosine alone. Without ``keep_text`` the text goes.
    """
    python_ready(files.sparkSession)
    rules = None if templates else LICENCES
    templates = templates or TEMPLATES
    files = files.drop("found")
    schema = T.StructType([*[f for f in files.schema.fields if keep_text or f.name != text], T.StructField("found", FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, rules)
        kind = pa.struct([("licence", pa.string()), ("cosine", pa.float64()), ("line", pa.int32()), ("share", pa.float64())])
        for batch in batches:
            for some in pieces(batch, text):
                rows = [matcher.scan(t) for t in some.column(some.schema.get_field_index(text)).to_pylist()]
                stay = [c for c in some.schema.names if keep_text or c != text]
                yield pa.RecordBatch.from_arrays([*[some.column(some.schema.get_field_index(c)) for c in stay], pa.array(rows, kind)], names=[*stay, "found"])

    return files.mapInArrow(run, schema)


def directories(path: Column) -> Column:
    """All ancestors of a path, nearest first, the root as an empty string last."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def licences(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, text, ...) -> the other columns, path, licence, cosine, how, source_dir.

    A file's own notice comes first (how: own); else it has that of the nearest ancestor directory with a licence
    file (inherited), else none. A licence file is named like one, or is a notice for the most part; of several in
    a directory the one with the largest cosine counts, then the least name. Null and empty texts have no notice; null
    paths inherit nothing; repeated rows stay; an empty table stays empty. Columns of ``files`` named like the new ones give way.
    """
    files = files.drop("licence", "cosine", "how", "source_dir")
    scanned = cut(detect(files, templates, keep_text=False), "notices")  # texts are read once
    paths = scanned.where("path is not null and found is not null")
    mine = paths.where(F.col("path").rlike(LICENCE_NAME) | (F.col("found.share") >= LICENCE_SHARE)).select(F.get(directories(F.col("path")), F.lit(0)).alias("dir"), (-F.col("found.cosine")).alias("far"), "path", F.col("found.licence").alias("licence"))
    granted = mine.groupBy("dir").agg(F.min(F.struct("far", "path", "licence")).alias("g")).select("dir", F.col("g.licence").alias("licence"), (-F.col("g.far")).alias("cosine"))
    # one row a directory that files lie in, so a directory of very many files is looked up once
    held = scanned.where("path is not null").select(F.get(directories(F.col("path")), F.lit(0)).alias("_own")).distinct()
    climbs = held.select("_own", F.posexplode(directories(F.concat("_own", F.lit("/x")))).alias("up", "_dir"))
    nearest = climbs.join(granted, F.col("_dir") == F.col("dir")).groupBy("_own").agg(F.min(F.struct("up", "dir", "licence", "cosine")).alias("near"))
    both = scanned.withColumn("_in", F.when(F.col("path").isNotNull(), F.get(directories(F.col("path")), F.lit(0)))).join(nearest, F.col("_in") == F.col("_own"), "left")
    own = F.col("found").isNotNull()
    return both.select(
        *[c for c in files.columns if c != "text"],
        F.coalesce("found.licence", "near.licence").alias("licence"),
        F.coalesce("found.cosine", "near.cosine").alias("cosine"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~own, F.col("near.dir")).alias("source_dir"),
    )
