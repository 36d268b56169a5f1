"""Helpers of the training-data operators: reading tables, shared scratch tables, session settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import prepare

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch; texts may be long, so a batch is kept small.
BATCH_ROWS = 1000
#: Ids and marks of texts that are broadcast at most.
MOST_SENT = 1 << 20
_OWN: list[str] = []
#: What operators remember from task to task in a worker process, by owner: how it is forgotten.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(owner: str, clear: Callable[[], None]) -> None:
    _REMEMBERED[owner] = clear


def only(owner: str) -> None:
    """Where a task starts: forget what other operators remember in this worker process, which a session uses for all of them."""
    for name, clear in _REMEMBERED.items():
        if name != owner:
            clear()


def slim() -> None:
    """Where a task ends that held large arrays: give the worker process's free memory back, as idle workers count against their executor."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tune(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset on one machine (tests) a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names the shared folder of a cluster")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sigloom-"))
        at = _OWN[0]
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sigloom-{tag}-{uuid.uuid4().hex}"


def keep(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """Few short rows to join with texts go to every task, so that texts need not move; beyond the counted bound texts are dealt by key."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("shuffle_hash")


def partitions(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def one_each(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One of the rows that share an id and a text, which the column text gives; told by its SHA-256, under a name that df does not have."""
    name = "_same"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return df.withColumn(name, F.sha2(text, 256)).dropDuplicates([id_col, name]).drop(name)
