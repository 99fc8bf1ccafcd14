"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept as cut
from ..session import scratch, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write to a Parquet table in the shared folder (column-compressed, smaller than a checkpoint) and read it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that store() made and nobody needs again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if os.path.basename(name).startswith("gridloom-") and root.split("://")[-1].strip("/") in name:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(name)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage. Only then does Spark let go of the broadcasts, shuffles and checkpoints of frames that nobody
    holds, and a JVM that isn't asked lets its heap grow to the limit first, however little of it is in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the decimal text of a key, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


__all__ = ["crc_mod", "cut", "drop_stored", "release", "store", "table"]
