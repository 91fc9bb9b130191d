"""Where queries that write files put them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..sources.files import local_path


def new_path(spark: SparkSession, name: str) -> str:
    """A new file path in the folder that the cluster shares, removed when the driver ends; a temporary folder only in local mode, where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = os.path.join(local_path(shared), "surveys") if shared else tempfile.mkdtemp(prefix="surveys-")
    folder = os.path.join(folder, uuid.uuid4().hex)
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return os.path.join(folder, name)
