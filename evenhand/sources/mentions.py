"""Which of many labels a text mentions: one pass a text, however many labels there are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship


def mentions(rows: DataFrame, labels: Iterable[str], text: str = "content") -> DataFrame:
    """``rows`` with ``found``: the labels that occur anywhere in the text in lower case, sorted, each once.

    All labels go into one automaton, which each task builds once; it reports labels within and across each other, as a
    search for each of them would. The labels are the caller's and travel with the function: a pool or a few thousands. Null texts
    mention none. A column ``found`` of ``rows`` gives way.
    """
    ship(rows.sparkSession)
    labels, rows = sorted({x for x in labels if x}), rows.drop("found")
    at = F.lower(F.coalesce(F.col(text), F.lit("")))
    ready = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), at.alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for x in labels:
            machine.add_word(x, x)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({x for _, x in machine.iter(t)}) if labels else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["row", "found"])

    schema = T.StructType([ready.schema["row"], T.StructField("found", T.ArrayType(T.StringType()))])
    return ready.mapInArrow(run, schema).select("row.*", "found")
