"""Particle sources: generated swarms and text files."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import axes


def cartesian(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], n: Sequence[int], *, perturb: float = 0.0, seed: int = 12345678) -> DataFrame:
    """Particles on a regular grid that includes both ends; ``perturb`` moves them by up to that share of the spacing."""
    total = math.prod(n)
    df, rest = spark.range(total), F.col("id")
    for d, a in enumerate(axes(len(n))):
        i = F.pmod(rest, F.lit(n[d])) if d < len(n) - 1 else rest
        step = (hi[d] - lo[d]) / max(n[d] - 1, 1)
        x = F.lit(float(lo[d])) + i * F.lit(float(step))
        if perturb:
            x = F.least(F.greatest(x + (F.rand(seed + d) * 2 - 1) * perturb * step, F.lit(float(lo[d]))), F.lit(float(hi[d])))
        df = df.withColumn(a, x)
        rest = F.floor(rest / n[d]).cast("long")
    return df


def random(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], n: int, *, seed: int = 12345678) -> DataFrame:
    return spark.range(n).withColumns({a: F.lit(float(lo[d])) + F.rand(seed + d) * (hi[d] - lo[d]) for d, a in enumerate(axes(len(lo)))})


def radial(spark: SparkSession, center: Sequence[float], radii: tuple[float, float], angles: tuple[float, float], n: tuple[int, int]) -> DataFrame:
    """Particles on n[0] circles of n[1] angles each, in 2-D."""
    nr, na = n
    r = F.lit(float(radii[0])) + F.floor(F.col("id") / na) * (radii[1] - radii[0]) / max(nr - 1, 1)
    t = F.lit(float(angles[0])) + F.pmod("id", F.lit(na)) * (angles[1] - angles[0]) / max(na - 1, 1)
    return spark.range(nr * na).withColumns({"x": center[0] + r * F.cos(t), "y": center[1] + r * F.sin(t)})


def read_csv(spark: SparkSession, path: str, dim: int, fields: Sequence[str] = ()) -> DataFrame:
    """x, y, .. and field columns by name from CSV with a header; ids by position in the file order of Spark."""
    from pyspark.sql import types as T

    head = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c.strip(), T.DoubleType()) for c in head])
    df = spark.read.schema(schema).option("header", True).csv(path)
    lower = {c.lower(): c for c in df.columns}
    return df.select(F.monotonically_increasing_id().alias("id"), *[F.col(lower[c.lower()]).alias(c) for c in [*axes(dim), *fields]])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)
