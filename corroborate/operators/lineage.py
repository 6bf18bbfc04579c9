"""Cutting the lineage of tables that loops work on, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder spark.checkpoint.dir; a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
