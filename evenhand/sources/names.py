"""Names drawn one after the other by a seeded generator, in parallel, as a single loop over the profiles would draw them.

The loop takes one choice a (profile, group); a choice takes the top bits of as many 32-bit words as it needs until one is
below the pool's size, so which word belongs to which draw depends on all words before it. Words come in blocks. A block, whose
generator starts from a state kept in passing, tells for each group that could be next at its start which one is next at
its end and how many draws it completes; those few numbers a block, added up in order, say where each block starts, and
then all blocks give their draws.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..schema import GROUPS, SEED
from ..shared import beside, settled
from ..workers import ship

#: Words in a block.
WORDS = 1 << 18


def _generator(state: bytes | None = None, seed: int = SEED) -> np.random.MT19937:
    """At a kept state, or where ``random.Random(seed)`` starts."""
    own = np.frombuffer(state, np.uint32) if state else np.array(random.Random(seed).getstate()[1], np.uint32)
    made = np.random.MT19937(0)
    made.state = {"bit_generator": "MT19937", "state": {"key": own[:-1], "pos": int(own[-1])}}
    return made


def _block(words: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every word and phase that the block could start in: the phase after the word, and whether the word completes a draw."""
    n, phases = len(words), np.arange(len(sizes), dtype=np.int8)
    shift = np.array([32 - s.bit_length() for s in sizes], np.uint64)
    fits = (words[:, None] >> shift) < np.array(sizes, np.uint64)  # by word and phase before it
    after = np.where(fits, (phases + 1) % len(sizes), phases).astype(np.int8)
    step = 1
    while step < n:  # functions of the phase, composed over runs of words that double
        after[step:] = np.take_along_axis(after[step:], after[:-step].copy(), 1)
        step *= 2
    before = np.vstack([phases, after[:-1]])
    return after, np.take_along_axis(fits, before, 1)


def draws(spark, sizes: list[int], n: int, seed: int = SEED, words: int = WORDS) -> DataFrame:
    """(draw, pick): the ``n`` first picks of a loop that chooses from pools of these sizes in turn."""
    ship(spark)
    each = len(sizes)
    need = sum(n // each * 2 ** s.bit_length() / s + 2 ** s.bit_length() / s for s in sizes)
    blocks = int((need + 8 * need**0.5 * each) / words) + 1  # eight deviations above what is expected

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            made = _generator(seed=seed)
            for i in range(blocks):
                own = made.state["state"]
                yield pd.DataFrame({"block": [i], "state": [np.r_[own["key"], own["pos"]].astype(np.uint32).tobytes()]})
                made.random_raw(words, output=False)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, state in zip(f.block, f.state, strict=True):
                after, done = _block(_generator(state).random_raw(words), sizes)
                yield pd.DataFrame({"block": i, "phase": np.arange(each), "end": after[-1].astype(int), "n": done.sum(0)})

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "phase"])
        end, count, out, phase, draw = rows.end.to_numpy().reshape(-1, each), rows.n.to_numpy().reshape(-1, each), [], 0, 0
        for i in range(blocks):
            out.append((i, phase, draw))
            phase, draw = int(end[i, phase]), draw + int(count[i, phase])
        return pd.DataFrame(out, columns=["block", "phase", "draw"])

    def picks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for state, phase, first in zip(f.state, f.phase, f.draw, strict=True):
                raw = _generator(state).random_raw(words)
                after, done = _block(raw, sizes)
                at = np.flatnonzero(done[:, phase])
                before = np.where(at > 0, after[np.maximum(at - 1, 0), phase], phase)
                shift = np.array([32 - s.bit_length() for s in sizes], np.uint64)[before]
                yield pd.DataFrame({"draw": first + np.arange(len(at)), "pick": (raw[at] >> shift).astype(int)})

    # one task runs through the generator, a few nanoseconds a word, and keeps 2.5 KB a block
    kept = settled(spark.range(1).coalesce(1).mapInPandas(states, "block long, state binary"))
    dealt = kept.repartition(min(blocks, 4096), "block")
    at = dealt.mapInPandas(ends, "block long, phase int, end int, n long").groupBy().applyInPandas(starts, "block long, phase int, draw long")
    return beside(dealt, at, ["block"]).mapInPandas(picks, "draw long, pick int").where(F.col("draw") < n)


def seeded(base: DataFrame, order: list[str], pools: dict[str, list[str]], seed: int = SEED, words: int = WORDS) -> DataFrame:
    """Profiles in ``order`` -> (profile_id, group, name), the names that a loop over them draws: see ``decisions.seeded_names``.

    A group without names has its label, and takes no draw. Profiles are numbered by ranges of ``order``, which has to tell
    any two of them apart.
    """
    spark = base.sparkSession
    named = [g for g in GROUPS if pools.get(g)]
    numbered = ordered.running_sum(ordered.ranges(base.select("profile_id", *order), [], order), [], order, F.lit(1), "_at").select("profile_id", "_at")
    numbered = settled(numbered)
    tables = spark.createDataFrame([(g, named.index(g) if g in named else None, pools.get(g) or []) for g in GROUPS], "`group` string, turn int, pool array<string>")
    rows = numbered.crossJoin(F.broadcast(tables))  # a row a group: six
    if not named:
        return rows.select("profile_id", "group", F.col("group").alias("name"))
    found = draws(spark, [len(pools[g]) for g in named], numbered.count() * len(named), seed, words)
    rows = rows.withColumn("draw", F.col("_at") * len(named) + F.col("turn")).join(found, "draw", "left")
    name = F.coalesce(F.get("pool", F.col("pick")), F.raise_error(F.lit("too few words were drawn")).cast("string"))
    return rows.select("profile_id", "group", F.when(F.col("turn").isNull(), F.col("group")).otherwise(name).alias("name"))
