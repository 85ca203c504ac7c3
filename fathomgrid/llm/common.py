"""What the operators of this subpackage share: tables, shared storage, checked broadcasts, bounded batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of files that a task reads at least, if all cores then have a task.
SPLIT_BYTES = 32 << 20
#: Bytes of a file of a small table, and what such a table has at most.
FILE_BYTES, SMALL_BYTES = 16 << 20, 256 << 20
#: Rows of one key that a task ranks.
RANKED = 20_000
#: Python works on slices of at most so many bytes of text (or one longer text).
SLICE_BYTES = 1 << 18
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Rows and bytes that Spark sends a Python worker at a time, and rows that it reads of a Parquet file.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 1_000, 2 << 20, 512
#: Bytes of a row group that is written. A task holds one on the heap, and its columns outside the heap while it reads.
GROUP_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df in a session with small batches and row groups: no reader, writer or side of a Python stage holds many texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    conf.set("parquet.block.size", str(GROUP_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data, its small files read together."""
    return gathered(bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet")))


def gathered(df: DataFrame) -> DataFrame:
    """df in no more partitions than its files have SPLIT_BYTES (but one for each core): many tiny files are a burden.

    Files of the usual size are read as they are.
    """
    return df.coalesce(min(1 << 30, max(-(-planned_bytes(df) // SPLIT_BYTES), df.sparkSession.sparkContext.defaultParallelism)))


def planned_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size for: for a table, its files' bytes. Sizes tasks, never decides a result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names; without it there is no place for tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def materialize(df: DataFrame, files: int = 0, gather: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    A small table (see small_files) gets so many files at most, by a shuffle of its rows if gather is set, else by
    fewer tasks in its last stage. 0 leaves it as it is.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathomgrid-{uuid.uuid4().hex}"
    if files:
        df = df.repartition(files) if gather else df.coalesce(files)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_files(size: int) -> int:
    """How many files a table of about so many bytes should have; 0 if it isn't small."""
    return max(1, -(-size // FILE_BYTES)) if size <= SMALL_BYTES else 0


def fewer(files: int) -> int:
    """The same of a table of a few narrow rows for each row of one with so many files."""
    return min(files, max(1, files // 4))


def checked(small: DataFrame, row_bytes: int) -> DataFrame:
    """small with a broadcast hint if its counted size is below BROADCAST_BYTES, else as it is (a shuffled join)."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def text_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of all texts; sizes shards, never decides a result."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def salted(key: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty. What earlier batches and tasks left unused goes back to the system first."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts add up to at most so many bytes; a longer text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def numbered(values: np.ndarray, key: str) -> Column:
    """The value that a column of numbers from 0 on stands for."""
    return F.element_at(F.expr(f"array({', '.join(f'{int(v)}L' for v in values)})"), F.col(key).cast("int") + 1)


def rank_within(df: DataFrame, key: str, by: list[str], name: str, counts: np.ndarray) -> DataFrame:
    """df with a rank from 0 within each key, a number below len(counts) that counts[key] rows have.

    Each key is parted into as many salts as it has RANKED rows; counts by salt give each salt its first rank.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*by), numbered(np.maximum(1, -(-counts // RANKED)), key)))
    sizes = df.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_salt").orderBy(*by)))
    return ranked.join(first, [key, "_salt"]).withColumn(name, (F.col("_first") + F.col("_rn") - 1).cast("long")).drop("_rn", "_first", "_salt")
