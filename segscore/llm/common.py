"""Shared helpers: the folder for intermediate tables, column naming, Arrow batches, bounded filters."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Positions of a bitmap filter: 2,048 rows of 4 KB, 8 MB at most whatever goes into it.
POSITIONS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one of a local session (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="segscore-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, done: tuple[DataFrame, ...] = (), last: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, on storage that outlives executors.

    done: earlier saved tables that only df needed; their files go once df is written. last: shuffles of large rows end
    here, and collect() gives their files back.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    for x in done:
        folder = spark._jvm.org.apache.hadoop.fs.Path(x.path_)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    if last:
        del df
        collect(spark)
    return out


def collect(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nobody holds any more; else they stay until the driver's JVM
    happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def position(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("position"), key), F.lit(POSITIONS))


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with _maybe: true where the key may be among keys (one column); it is for all that are, and for a few others.

    keys become a bitmap of hashed positions, 8 MB at most at any size, so it can go to every executor. A join on the
    exact key follows in the caller, for the marked rows; the others, and the long texts in them, need no shuffle.
    """
    at = position(F.col(keys.columns[0]))
    bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("_bucket")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("int")).alias("_bits"))
    own = df.withColumn("_at", position(F.col(key)))
    joined = own.join(F.broadcast(bits), F.shiftright("_at", 15) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", ((F.col("_at") % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.select(*df.columns, F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df that marked() marks."""
    return marked(df, key, keys).where("_maybe").drop("_maybe")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the needed columns, under internal names that no extra column can clash with."""
    # A name that stays gets no alias: Spark would see two different plans where the result is used twice.
    return df.select(*(F.col(f"`{name}`") if alias == name else F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes of text, so that long texts don't multiply the memory in use."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, with the memory of its tables and memos given back to the system when a task ends.

    Python workers live on between tasks, and what an allocator keeps of an ended task would stand beside the JVM's heap
    in the stages that follow.
    """

    def go(batches: Batches) -> Batches:
        yield from run(batches)
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return go
