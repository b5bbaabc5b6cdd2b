"""Results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is not set, a session on one machine gets a folder of its
    own; a cluster has none that all its machines see, so there it must be set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end, errors or not, so what is made of them must
    have been written by then. One inside another has a folder of its own."""
    place = f"{shared_dir(spark)}/spans/{uuid.uuid4().hex}"
    token = _scratch.set(place)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Texts and findings that repeat take up to this many times their bytes in a file.
COMPRESSED = 100.0


def sized(spark: SparkSession) -> float:
    """Has the planner take a file as COMPRESSED times its bytes (a session setting, which is only
    ever raised), else a file of few bytes and millions of rows is sent whole to driver and
    executors. Gives the factor in force."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < COMPRESSED:
        spark.conf.set(name, str(COMPRESSED))
    return float(spark.conf.get(name))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: later steps neither repeat its work nor carry its plan."""
    spark = df.sparkSession
    sized(spark)
    path = f"{_scratch.get() or shared_dir(spark) + '/spans'}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table with fewer bytes than this for each core may come in too few tasks.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many tasks as there are cores: few bytes of text can be long work. The
    planner's estimate tells, so nothing is run for it; a large table comes in tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    factor = sized(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / factor
    return df.repartition(cores) if size < SMALL * cores else df
