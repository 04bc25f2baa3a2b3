"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once, into a table; plans that use it many times stay small.

    The planner takes a table for as large as its files, which are packed many times smaller than its
    rows, and would send it through the driver; so joins with it are merges.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # else the driver's heap grows by each plan, and shuffle files of finished plans stay
    return spark.read.schema(df.schema).parquet(path).hint("merge")
