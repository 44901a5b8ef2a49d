"""Decisions from a callable: anything that turns a prompt and a schema into a decision."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import beside
from ..workers import ship

#: (prompt, schema) -> decision
Decide = Callable[[str, dict], dict]


def ask(prompts: DataFrame, adapter: Callable[[], Decide], parallel: int = 8, in_flight: int = 1, retries: int = 0, wait: float = 0.5) -> DataFrame:
    """(.., prompt, schema) -> the same columns, ``decision`` as JSON text, and ``error``.

    ``adapter`` makes the callable inside each task, so connections needn't be sent; up to ``in_flight`` threads of a task
    use it at a time. ``parallel`` bounds the tasks. A call that fails is made again up to ``retries`` times, after ``wait``
    seconds and twice as long each time; if the last one fails too, the decision is empty, ``error`` says why, and the
    others go on.
    """
    ship(prompts.sparkSession)
    prompts = prompts.drop("decision", "error")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = adapter()

        def one(prompt: str, schema: str) -> tuple[str, str | None]:
            for attempt in range(retries + 1):
                try:
                    return json.dumps(call(prompt, json.loads(schema))), None
                except Exception as e:  # whatever the remote side does
                    said = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
            return "{}", said

        with ThreadPoolExecutor(in_flight) as pool:
            for f in frames:
                got = list(pool.map(one, f.prompt, f.schema))
                yield f.assign(decision=[d for d, _ in got], error=[e for _, e in got])

    schema = T.StructType([*prompts.schema.fields, T.StructField("decision", T.StringType()), T.StructField("error", T.StringType())])
    return prompts.repartition(parallel).mapInPandas(run, schema)


def decide(prompts: DataFrame, adapter: Callable[[], Decide], parallel: int = 8, **how) -> DataFrame:
    """``ask`` without its errors: a call that fails gives an empty decision."""
    return ask(prompts, adapter, parallel, **how).drop("error")


class Store:
    """Answers of a model in a folder that is only appended to, so that a run which is broken off can go on where it was.

    A prompt is known by its key and its text: if the text changes, it is asked again. ``key`` names the columns that
    identify a cell. Prompts are asked in waves, by a hash of the key, and each wave's answers are appended when it ends: at
    most the wave under way is lost. Answers that failed are kept too, but asked again by the next run.
    """

    def __init__(self, path: str, key: list[str]):
        self.path, self.key = path, key

    def _rows(self, spark) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return spark.read.parquet(self.path) if there.exists(path) and there.listStatus(path) else None

    def answers(self, spark) -> DataFrame | None:
        """The last answer of each prompt, one that did not fail if there is any; None before anything was asked."""
        rows = self._rows(spark)
        if rows is None:
            return None
        own = [c for c in rows.columns if c not in (*self.key, "asked")]
        best = F.max_by(F.struct(*own), F.struct(F.col("error").isNull(), F.col("asked"), F.col("decision")))
        return rows.groupBy(*self.key, F.col("asked_sha").alias("_sha")).agg(best.alias("r")).select(*self.key, *[f"r.{c}" for c in own])

    def missing(self, prompts: DataFrame) -> DataFrame:
        """Prompts without an answer that did not fail, with ``asked_sha``, the hash of their text."""
        prompts = prompts.withColumn("asked_sha", F.sha2("prompt", 256))
        rows = self._rows(prompts.sparkSession)
        if rows is None:
            return prompts
        done = rows.where("error is null").select(*self.key, "asked_sha").distinct()
        return beside(prompts, done, [*self.key, "asked_sha"], "left_anti")

    def fill(self, prompts: DataFrame, adapter: Callable[[], Decide], parallel: int = 8, wave: int = 10_000, **how) -> DataFrame:
        """Asks what is missing, about ``wave`` prompts at a time, and returns the answers of ``prompts``. Repeated keys are asked once.

        The schema of a prompt has to be in ``schema``; how calls are made, see ``ask``.
        """
        spark = prompts.sparkSession
        left = self.missing(prompts.dropDuplicates(self.key))
        waves = -(-left.count() // wave)
        for i in range(waves):
            due = self.missing(prompts.dropDuplicates(self.key)).where(F.pmod(F.xxhash64(*self.key), F.lit(waves)) == i)
            due = ask(due, adapter, parallel, **how).withColumn("asked", F.lit(time.time()))
            due.select(*self.key, "asked_sha", "decision", "error", "asked").write.mode("append").parquet(self.path)
        known = self.answers(spark)
        wanted = prompts.withColumn("asked_sha", F.sha2("prompt", 256))
        if known is None:
            return wanted.withColumns({"decision": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).drop("asked_sha")
        return beside(wanted, known, [*self.key, "asked_sha"], "left").drop("asked_sha")


def chat_completions(model: str, base_url: str | None = None, key: str | None = None, temperature: float = 0.0) -> Callable[[], Decide]:
    """An adapter for servers with a chat-completions API; its client library is needed only where this is used."""

    def make() -> Decide:
        from openai import OpenAI

        client = OpenAI(api_key=key, base_url=base_url)

        def call(prompt: str, schema: dict) -> dict:
            said = client.chat.completions.create(model=model, temperature=temperature, response_format={"type": "json_object"}, messages=[{"role": "system", "content": f"Answer with one JSON object with the fields {', '.join(schema['required'])}."}, {"role": "user", "content": prompt}])
            return json.loads(said.choices[0].message.content)

        return call

    return make
