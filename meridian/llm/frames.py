"""Shared DataFrame helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.words import give_back


_KEPT: set[str] = set()
_SCRATCH: list[list[str]] = []  # tables written inside the scratches that are open, innermost last


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one in the temporary folder only for a local master without that setting.

    On a cluster an unset folder raises ``RuntimeError``: what an executor writes to a disk of its own, others would never find.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/meridian-checkpoints"


def table_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is removed when the driver's JVM ends; ``clear`` removes it earlier."""
    folder = f"{shared_folder(spark)}/meridian-{spark.sparkContext.applicationId}"
    if folder not in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)  # holds only for a folder that exists
        _KEPT.add(folder)
    return folder


def clear(spark: SparkSession) -> None:
    """Remove all tables that ``written`` has made in this application; DataFrames over them can't be read any more."""
    folder = table_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_driver(spark: SparkSession) -> None:
    """Collect garbage on the driver: shuffle files and broadcasts of steps that are done go only then, and its heap shrinks."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession, keep: str) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, but for those named ``keep``. Whatever is used later may depend on those only."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        made = _SCRATCH.pop()
        kept = [p for p in made if p.rpartition("/")[2].rpartition("-")[0] == keep]
        if _SCRATCH:
            _SCRATCH[-1].extend(kept)
        for name in set(made) - set(kept):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        settle_driver(spark)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes for the actions inside: rows that carry whole sets are large."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of all texts of a column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows sorted by an integer ``column``, in tables that never split one of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1], "left"))
        if cut or (held and held[-1].column(column)[-1].as_py() != values[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()


def carried(docs: DataFrame, text_col: str, columns: tuple[str, ...]) -> tuple[DataFrame, str]:
    """``columns`` of ``docs`` and the text, and the name that the text has there; it is not sent twice."""
    if text_col in columns:
        return docs.select(*columns), text_col
    return docs.select(*columns, F.col(text_col).alias("__text")), "__text"


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, few: int = 100_000) -> DataFrame:
    """``docs`` without the rows named in ``gone`` (``id``, ``text_hash`` = xxhash64 of the text; nulls match nulls).

    The names are sent to all executors only if they are at most ``few``; else both sides are shuffled.
    """
    gone = written(gone.select("id", "text_hash").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= few else gone
    return docs.join(gone, docs[id_col].eqNullSafe(gone["id"]) & F.xxhash64(docs[text_col]).eqNullSafe(gone["text_hash"]), "left_anti")


def joined_by_few(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int, parts: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``counted`` (one row per key; ``n`` tells how many rows have it), left outer, without a hot key in any task.

    Keys with over a ``parts``-th of the ``total`` rows are fewer than ``parts`` whatever the data, so they are broadcast; no other key has more than that share, and those
    are joined by shuffle. Null keys match nothing and stay.
    """
    common = F.col(n) > total / parts
    hot = counted.where(common).drop(n)
    extra = [c for c in counted.columns if c not in (*keys, n)]
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"), *extra)), keys, "left")
    cold = marked.where("__hot IS NULL").select(*rows.columns).join(counted.where(~common).drop(n), keys, "left")
    return marked.where("__hot").select(*rows.columns, *extra).unionByName(cold.select(*rows.columns, *extra))
