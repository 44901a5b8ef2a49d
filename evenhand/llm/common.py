"""What several operators of this folder share: shared scratch tables and small column expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

#: Words are maximal runs of anything but these six ASCII blanks.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a session that runs in one process may go without: it gets a temporary one. On a cluster that would be a
    different folder on each machine, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evenhand-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    What follows depends on files only, so a lost executor costs the tasks it ran and not the whole history. The shuffle
    files behind it are no longer needed; a collection lets Spark's cleaner remove them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` has written, or that read such ones only, once nothing needs them."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0].split(":", 1)[-1].replace("//", "") for f in table.inputFiles()}
        for spark, path in [w for w in _written if w[1].split(":", 1)[-1].replace("//", "") in folders]:
            _written.remove((spark, path))
            _delete(spark, path)


def drop_scratch() -> None:
    """Removes what ``cut`` has written in this process, while its session lives."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; nothing can be reached any more
            return


atexit.register(drop_scratch)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def whole_text(c: str | Column = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def python_ready(spark: SparkSession, rows: int = 512) -> None:
    """Sends this package to the workers, once a session, and bounds what goes to one of them at once.

    Long texts make large Arrow batches at the default of 10,000 rows.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
