"""Shared plumbing of the training-data operators.

Texts reach Python as Arrow batches; rows go back as Arrow batches, so nothing is
pickled row by row.  Intermediate tables are written below the folder that the
cluster names in ``spark.checkpoint.dir`` (every executor can read them back, so
a lost executor costs nothing but its running tasks).
"""

from __future__ import annotations

import ctypes
import os
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Python loops work on slices of a batch of about this many bytes of text.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A session that names none gets a folder of this machine, which only a local master can read
    back; on a cluster that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it.

    That serves local runs and shared file systems; elsewhere the package goes with
    ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage).

    The files are deleted when the driver's JVM ends, or by :func:`discard` before.
    """
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`staged`, with the place for :func:`discard`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{label}"
    at, fs = _folder(spark, path)
    fs.deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what :func:`written` wrote; nothing may read it any more."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; batches that give None vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A ``mapInArrow`` function that gives freed memory back to the system when its partition ends.

    Spark uses Python workers again for later stages, and allocators keep what they once had:
    without this an executor holds every worker's highest mark of all stages at once.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
            if trim is not None:
                trim(0)

    return whole


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_class(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id belongs to class 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` named by ``kept(id, raw)``, all columns, one of each repeated row.

    ``raw`` is :func:`raw_key` of the text.  The join and the choice among repeated
    rows need the same partitioning, so whole texts are shuffled once at most.
    """
    names = docs.columns
    # the row travels in one struct, so no column of its own can clash
    left = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(id_col).alias("id"), raw_key(text_col).alias("raw"))
    right = kept.select(F.col("id").alias("kid"), F.col("raw").alias("kraw")).distinct()
    joined = left.join(right, left["raw"].eqNullSafe(right["kraw"]) & left["id"].eqNullSafe(right["kid"]), "left_semi")
    one = Window.partitionBy("raw", "id").orderBy("raw")
    return joined.withColumn("n", F.row_number().over(one)).where("n = 1").select(*[F.col("row").getField(n).alias(n) for n in names])


def raw_key(text_col: str) -> Column:
    """64-bit hash of the text as it stands; tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
