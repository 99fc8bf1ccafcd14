"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process
    (tests, local runs) a temporary folder is made and set; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not named and known.isDefined():
        named = known.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once, with the lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
