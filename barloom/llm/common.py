"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its row count was measured and is at most this.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of text that go to a Python worker at once; long texts then stay within an executor's memory.
BATCH_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; every operator that hands texts to Python calls it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a new one on local masters only."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/barloom-shared"


class Scratch:
    """Written tables that cut lineage; a lost executor re-reads them instead of recomputing.

    ``save`` writes Parquet under the shared folder. ``drop`` deletes tables that no later plan reads;
    what is left goes when the driver's JVM exits.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        text_batches(spark)
        files, root = self._files(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def sweep(self) -> None:
        """Lets shuffle files of finished plans go: Spark deletes them once the driver has collected their plans."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)

    def _files(self, path: str):
        """The path's file system and the path, as Hadoop has them."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when df has at most ``rows`` rows; reads no more than one row beyond that per partition."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a measured row count; beyond it the join shuffles both sides."""
    return F.broadcast(df) if small_enough(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    Where every character is one byte, Spark's lower() is that same mapping and far cheaper than translate().
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def rows_of(batch, *columns: str) -> Iterator[tuple]:
    """Rows of an Arrow batch, converted a slice at a time so that long texts do not pile up as Python objects."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def give_back() -> None:
    """Hands memory that Python, Arrow and the C library hold but no longer use back to the system.

    Workers outlive their tasks; without this, what one operator's largest batch took still counts in the next one's.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


#: What tasks keep in this Python worker for the next ones of their operator, by (operator, key).
_KEPT: dict[tuple, object] = {}


def kept(operator: str, key, make):
    """``make()``, once for each Python worker until a task of another operator begins there."""
    if (operator, key) not in _KEPT:
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]


def forget(but: str | None = None) -> None:
    """Drops what tasks of other operators than ``but`` have kept."""
    if others := [k for k in _KEPT if k[0] != but]:
        for k in others:
            del _KEPT[k]
        give_back()


def thrifty(run, operator: str | None = None):
    """``run``, a function of Arrow batches, with give_back() when its task ends; what other operators kept goes before."""

    def task(batches):
        forget(operator)
        yield from run(batches)
        give_back()

    return task


def chunks_of(rows: Iterable[tuple], size: int, length) -> Iterator[list[tuple]]:
    """Groups rows until ``length`` of them adds up to ``size``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += length(row)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
