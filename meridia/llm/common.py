"""What the training-data operators share: tables, the label split, cut lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of ``documents``; pipeline stages take and return exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or DOCUMENT_COLUMNS)))


#: Bytes of a table that can be in a single row group.
ROW_GROUP = 128 << 20


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt to all cores where it is small and has fewer files than there are cores.

    A file of one row group is read by one task, whatever the number of cores. Tables
    above ``ROW_GROUP`` stay as they are: no text is shuffled for this at scale.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if size <= ROW_GROUP and len(frame.inputFiles()) < cores else frame


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or with underscores in front if the table has such a column already."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder
    takes its place; on a cluster it has to be set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="meridia-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(frame: DataFrame, name: str = "table") -> DataFrame:
    """``frame`` written as Parquet in the shared folder and read back.

    This cuts the lineage: an executor lost later costs a reread, no recomputation. The
    table is deleted when the driver ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    table_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    table_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(table_path)
    return spark.read.schema(frame.schema).parquet(path)


def repeated(frame: DataFrame, times: str, position: str, at_once: int = 10_000) -> DataFrame:
    """Each row of ``frame`` as often as ``times`` says, with ``position`` counting from 0.

    A row that is repeated more than ``at_once`` times is dealt to tasks in parts.
    """
    count, part, zero = F.col(times), fresh(frame, "_part"), F.lit(0).cast("long")
    few = frame.filter(count.between(1, at_once)).withColumn(position, F.explode(F.sequence(zero, count - 1)))
    many = frame.filter(count > at_once).withColumn(part, F.explode(F.sequence(zero, F.floor((count - 1) / at_once)))).repartition(part)
    low = F.col(part) * at_once
    many = many.withColumn(position, F.explode(F.sequence(low, F.least(low + at_once, count) - 1))).drop(part)
    return few.unionByName(many)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(work: Work) -> Work:
    """``work`` for ``mapInArrow``, after which the worker gives back what it doesn't use.

    Python workers live on after a task, beside the executor's heap, and allocators keep
    freed memory: without this each stage adds its peak to what the next one needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
