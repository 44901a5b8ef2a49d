"""Tables that a plan reads more than once and that have to be the same each time."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evenhand-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that driver and executors share, and read from there.

    Spark deals rows to ranges by a sample, so a plan that is evaluated twice may deal differently; what is settled can't. It
    also outlives lost executors. The folder is the one that ``spark.checkpoint.dir`` names; a session of one process may
    go without and gets a temporary one. The table goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_settled() -> None:
    """Removes what ``settled`` has written, while its session lives."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; nothing can be reached any more
            return


atexit.register(drop_settled)


def beside(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` on columns of the same names, nulls equal to each other; their other columns differ in name."""
    renamed = few.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)] or [F.lit(True)]
    for more in same[1:]:
        same[0] = same[0] & more
    return rows.join(renamed, same[0], how).drop(*[f"_on{i}" for i in range(len(on))])
