"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder used where the session names none and all runs on one machine (tests).
LOCAL_DIR = "file:///tmp/wordloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a cluster it must be set, for executors share no other."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/wordloom-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
