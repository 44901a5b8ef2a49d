"""Traces that keep arriving: each batch is merged into the decisions so far by appending; the last one wins when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scenarios as S
from ..operators import ordered
from ..schema import TRACE


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new JSONL files of ``source``, appends parsed decisions to ``target`` by model and domain, and stops when all are read.

    ``ord`` joins the batch number and the row's place in file and line order, so a later batch wins over an earlier one and
    a later line over an earlier one. A batch that runs again after a failure overwrites its own folder.
    """
    rows = spark.readStream.schema(TRACE).json(source).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))

    def merge(batch: DataFrame, number: int) -> None:
        dims = F.broadcast(S.domains(batch.sparkSession).select("domain", "action_name", "score_name"))
        place = F.col("_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rises within a file, see decisions.trace
        rows = ordered.ranges(batch.withColumn("_place", place), [], ["_path", "_place"])
        rows = ordered.running_sum(rows, [], ["_path", "_place"], F.lit(1), "_at")
        found = rows.join(dims, "domain", "left").withColumns(S.parse(F.col("decision"), F.col("action_name"), F.col("score_name")))
        found = found.withColumn("ord", F.lit(number).cast("long") * (1 << 42) + F.col("_at"))
        keep = ["ord", "domain", "scaffold", "model", "profile_id", "group", "name", "action", "score", "tool_request"]
        found.select(*keep).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
