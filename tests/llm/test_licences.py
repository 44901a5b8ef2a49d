"""Licences: rivals told apart, pruned runs against all runs, inheritance against a loop over paths."""

import random

import pytest

from evenhand.llm import licenses as L

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.fixture(scope="module")
def matcher():
    return L.Matcher(L.TEMPLATES, L.LICENCES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        (GPL.format(2), "GPL-2.0"),
        (GPL.format(3), "GPL-3.0"),
        (GPL.format(3).replace("General", "Affero General"), "AGPL-3.0"),
        (GPL.format("2.1").replace("General", "Lesser General").replace("program", "library"), "LGPL-2.1"),
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
        ("This is not licensed under the Apache License, Version 2.0", None),
        ("It isn't released under the MIT License.", None),
        ("MIT License\n\nCopyright (c) 2020 Jane\n", "MIT"),
        ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
        ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        (f"Copyright Jane\n\n{L._BSD}", "BSD-2-Clause"),
        (f"Copyright Jane\n\n{L._BSD}{L._BSD3}", "BSD-3-Clause"),
        (f"Copyright Jane\n\n{L._MIT}\n\nTHE SOFTWARE IS PROVIDED AS IS", "MIT"),
        (L._ISC, "ISC"), (L._UNLICENSE, "Unlicense"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"), ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0-1.0"),
        ("ich gehe mit mit dir", None), ("a licence to kill, version 2", None), ("the commons of the software foundation", None), ("", None), (None, None),
    ],
)
def test_rivals(matcher, text, want):
    found = matcher.scan(text)
    assert (found and found["licence"]) == want


def test_every_licence_knows_its_own_texts(matcher):
    for name, x in L.LICENCES.items():
        assert [(matcher.scan(f"Some words first. {t}") or {}).get("licence") for t in x.texts] == [name] * len(x.texts)


def every_run(m, text):
    """All runs as long as each template, scored one by one."""
    spans = list(L._TOKEN.finditer((text or "").lower()))
    words = [s[0] for s in spans]
    best = None
    for i, length in enumerate(m.lengths):
        n = min(int(length), len(words))
        for start in range(len(words) - n + 1) if n else ():
            cosine = min(1.0, float(m.dots(words[start : start + n])[i]))
            if cosine >= L.LEAST_COSINE and m.holds(m.names[i], words[start : start + n + 4], words[max(0, start - 8) : start]):
                rank = (-round(cosine, 9), start, m.names[i])
                best = rank if best is None or rank < best else best
    return best


def test_pruned_runs_against_all_runs(spark, sf_dir):
    rng = random.Random(2)
    few = {k: L.LICENCES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0")}
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").collect()]
    flat = [t for x in L.LICENCES.values() for t in x.texts]
    for _ in range(60):
        words = " ".join(rng.choice(flat) for _ in range(2)).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "license", "not", "2.0", "gnu"])
        texts.append(" ".join(["some"] * rng.randint(0, 5) + words))
    for rules in (few, None):
        m = L.Matcher({k: list(x.texts) for k, x in few.items()}, rules)
        got = [m.scan(t) for t in texts]
        want = [every_run(m, t) for t in texts]
        assert [g and (-g["cosine"], g["licence"]) for g in got] == [w and (w[0], w[2]) for w in want] and sum(w is not None for w in want) > 15


def test_inheritance_against_a_loop(spark):
    rng = random.Random(5)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "nothing here"}
    rows = {}
    for _ in range(150):
        path = "/".join([*(rng.choice("abc") for _ in range(rng.randint(0, 4))), rng.choice(["LICENSE", "x.py", "y.py", "COPYING.txt"])])
        kind = rng.choice(list(notices))
        rows[path] = (kind, notices[kind] + (" code" * 40 if path.endswith(".py") else ""))
    rows["a/long.txt"] = (None, "word " * 150_000)
    got = {r.path: (r.licence, r.how, r.source_dir) for r in L.licences(spark.createDataFrame([(p, t, "clash") for p, (_, t) in rows.items()], "path string, text string, how string").repartition(4)).collect()}
    granted = {}
    for p in sorted(rows):
        if rows[p][0] and not p.endswith(".py"):
            granted.setdefault(p.rpartition("/")[0], rows[p][0])
    for p, (kind, _) in rows.items():
        want, at = (kind, "own", None) if kind else (None, "none", None), p
        while not kind and at:
            at = at.rpartition("/")[0]
            if at in granted:
                want = (granted[at], "inherited", at)
                break
        assert got[p] == want
    twice = L.licences(spark.createDataFrame([("a/x", notices["MIT"])] * 3 + [(None, None)] * 2, "path string, text string")).collect()
    assert sorted((r.path or "", r.licence or "") for r in twice) == [("", "")] * 2 + [("a/x", "MIT")] * 3
