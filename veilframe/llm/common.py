"""What the operators share: reading tables, staging results, dense numbering."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session on one machine
    gets one of its own; on a cluster that would not be shared, so there it must be set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so a lost
    executor costs the tasks it ran since, not the stages before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to Python, so that long texts come few at a time.
BATCH_BYTES = 8 << 20


def release() -> None:
    """Hand freed memory back to the system: a worker process lives on, idle or for other
    stages, beside the executor's other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes (a session setting, which is only
    ever lowered); each task releases its memory when it ends."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not str(conf.get(name)).isdigit() or int(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def grown(schema: T.StructType, **kinds: str) -> T.StructType:
    """A new schema with more fields at the end (add() would change df.schema itself)."""
    made = T.StructType(list(schema.fields))
    for name, kind in kinds.items():
        made = made.add(name, kind)
    return made


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_index(df: DataFrame, keys: list, name: str) -> DataFrame:
    """df with idx, the place of each row (from 0, no gaps) in the order of keys.

    Rows are dealt by ranges of the keys, numbered inside each range and shifted by the
    number of rows in earlier ranges; only one count for each range reaches the driver.
    The keys should end in something unique, else ties are numbered in any order and one
    value is one range."""
    ranged = stage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    starts, seen = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        starts[r["_range"]] = seen
        seen += r["count"]
    offsets = [starts.get(i, 0) for i in range(max(starts, default=0) + 1)]
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range") + 1)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("idx", first + inside - 1).drop("_range")
