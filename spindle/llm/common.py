"""What the operators of this subpackage share: reading, materialising, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Intermediate tables that hold texts, which are packed closely.
TEXTS = {"norms", "met", "passed"}
#: While it is set, the shuffle files of a query go as soon as it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_sent: set[tuple[str, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (a test) gets a temporary one; a cluster has to set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spindle-"))
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage in a way that survives a lost executor, and keeps every later
    reader on the same rows even where partitioning or sampling could differ. The shuffle files
    of ``df`` are removed when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd" if name in TEXTS else None)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindle_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """One frame of the rows of all ``tables`` that materialise() wrote, of one schema; none of them is written again."""
    paths = [t._spindle_path for t in tables]
    out = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)
    out._spindle_path = paths
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for ``tables``; only for those that no frame still to be run reads."""
    for table_ in tables:
        paths = getattr(table_, "_spindle_path", None)
        for path in [paths] if isinstance(paths, str) else paths or []:
            spark = table_.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        table_._spindle_path = None


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark removes the shuffle files of frames that are gone only then."""
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's to all executors; returns the name that ``shipped`` takes there."""
    if (spark.sparkContext.applicationId, path) not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add((spark.sparkContext.applicationId, path))
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Where a file that was sent is on this executor."""
    return SparkFiles.get(name)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read; whatever else a table has is pruned at the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1].tolist() if offsets else [0]
    return (memoryview(data) if data is not None else memoryview(b"")), at


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece's texts have about ``limit`` bytes at most (one longer text is a piece of its own)."""
    for batch in batches:
        if not len(batch):
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        for i in range(1, len(batch) + 1):
            if i == len(batch) or at[i + 1] - at[start] > limit:
                yield batch.slice(start, i - start)
                start = i
