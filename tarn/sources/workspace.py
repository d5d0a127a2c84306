"""Scratch folders that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's path under spark.checkpoint.dir; removed with the driver.

    Where that is unset, it is the machine's own temp folder if all runs on this machine, and an error on a cluster.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "tarn-scratch")
    top = top.rstrip("/")
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
