"""Cutting lineage through the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="fluxweave-")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation.

    Only local mode does without a named folder: the executors of a cluster share no other one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _local_dir(spark.sparkContext.applicationId)
    path = f"{folder.rstrip('/')}/fluxweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
