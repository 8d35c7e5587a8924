"""Streaming remap: field updates of a stream joined with weights that are computed once.

The mesh does not change, so each micro-batch is a stream-static join and an aggregation over (time, target).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerances import EPS


def remap_stream(updates: DataFrame, weights: DataFrame, fields: Sequence[str], *, time: str = "ts", delay: str = "10 minutes", min_volume: float = EPS) -> DataFrame:
    """updates: (time, id, fields), one row a source cell and time step; returns (time, tgt_id, fields) first order.

    A step's targets are complete once the watermark has passed it (append mode).
    """
    met = updates.withWatermark(time, delay).join(weights.where(F.abs("m0") >= min_volume).select("tgt_id", F.col("src_id").alias("id"), "m0"), "id")
    return met.groupBy(time, "tgt_id").agg(*[(F.sum(F.col(f) * F.col("m0")) / F.sum("m0")).alias(f) for f in fields])
