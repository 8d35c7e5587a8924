"""Interpolation: one grouped aggregation of the weights joined with source values, for any number of fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.tolerances import EPS


def _to_targets(targets: DataFrame, got: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every target; 0.0 where nothing reaches it."""
    left = targets.select("id", *keys)
    return left.join(got.withColumnRenamed("tgt_id", "id"), ["id", *keys], "left").fillna(0.0, subset=list(fields))


def first_order(weights: DataFrame, source: DataFrame, targets: DataFrame, fields: Sequence[str], *, min_volume: float = EPS, keys: Sequence[str] = ()) -> DataFrame:
    """sum(v m0) / sum(m0) over overlaps of at least ``min_volume``; array fields are averaged by component."""
    used = weights.where(F.abs("m0") >= min_volume)
    values = source.select(F.col("id").alias("src_id"), *fields, *keys)
    met = used.join(values, ["src_id", *keys])
    aggregates = []
    arrays = [f for f in fields if source.schema[f].dataType.typeName() == "array"]
    for f in fields:
        if f not in arrays:
            aggregates.append((F.sum(F.col(f) * F.col("m0")) / F.sum("m0")).alias(f))
    scalars = [f for f in fields if f not in arrays]
    got = met.groupBy("tgt_id", *keys).agg(*aggregates, F.sum("m0").alias("_m0")).drop("_m0")
    for f in arrays:
        each = met.select("tgt_id", *keys, "m0", F.posexplode(f).alias("_k", "_v")).groupBy("tgt_id", *keys, "_k").agg((F.sum(F.col("_v") * F.col("m0")) / F.sum("m0")).alias("_v"))
        back = each.groupBy("tgt_id", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias(f))
        got = got.join(back, ["tgt_id", *keys])
    return _to_targets(targets, got, scalars, keys)


def second_order(weights: DataFrame, source: DataFrame, gradients: DataFrame, targets: DataFrame, fields: Sequence[str], dim: int, *, min_volume: float = EPS, ref: str = "c", keys: Sequence[str] = ()) -> DataFrame:
    """Adds g . (x_overlap - x_ref) to the value; overlaps of at most ``min_volume`` are skipped."""
    used = weights.where(F.abs("m0") > min_volume)
    values = source.select(F.col("id").alias("src_id"), *fields, *keys, *[F.col(ref + a).alias("_r" + a) for a in axes(dim)])
    slopes = gradients.withColumnRenamed("id", "src_id")
    met = used.join(values, ["src_id", *keys]).join(slopes, ["src_id", *keys])
    terms = []
    for f in fields:
        v = F.col(f)
        for a in axes(dim):
            v = v + F.col(f"g_{f}_{a}") * (F.col("m1" + a) / F.col("m0") - F.col("_r" + a))
        terms.append((F.sum(v * F.col("m0")) / F.sum("m0")).alias(f))
    return _to_targets(targets, met.groupBy("tgt_id", *keys).agg(*terms), fields, keys)


def third_order(weights: DataFrame, source: DataFrame, fits: DataFrame, targets: DataFrame, field: str, dim: int, *, min_volume: float = EPS, ref: str = "c") -> DataFrame:
    """Adds the fitted quadratic at the overlap's centroid; divides by the target's volume."""
    used = weights.where(F.col("m0") > min_volume)
    values = source.select(F.col("id").alias("src_id"), field, *[F.col(ref + a).alias("_r" + a) for a in axes(dim)])
    met = used.join(values, "src_id").join(fits.withColumnRenamed("id", "src_id"), "src_id")
    d = [F.col("m1" + a) / F.col("m0") - F.col("_r" + a) for a in axes(dim)]
    v, k = F.col(field), 0
    for x in [*d, *[d[i] * d[j] for i in range(dim) for j in range(i, dim)]]:
        v, k = v + F.element_at("q", k + 1) * x, k + 1
    got = met.groupBy("tgt_id").agg(F.sum(v * F.col("m0")).alias("_s"))
    out = targets.select("id", "vol").join(got.withColumnRenamed("tgt_id", "id"), "id", "left")
    return out.select("id", F.coalesce(F.col("_s") / F.col("vol"), F.lit(0.0)).alias(field))


def coverage(weights: DataFrame, side: str = "target") -> DataFrame:
    """Overlap volume of each target (or source)."""
    key = "tgt_id" if side == "target" else "src_id"
    return weights.groupBy(F.col(key).alias("id")).agg(F.sum("m0").alias("covered"))


def error_norms(cells: DataFrame, value: str, exact: str, *, weighted: bool = True, p: float | None = None) -> DataFrame:
    """One row: l1, l2, linf (and lp), totals and extrema; NaN counts as 0."""
    clean = lambda c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    e = F.abs(clean(F.col(value)) - clean(F.col(exact)))
    w = F.col("vol") if weighted else F.lit(1.0)
    out = [
        F.sum(e * w).alias("l1"), F.sqrt(F.sum(e * e * w)).alias("l2"), F.max(e).alias("linf"), F.sum(clean(F.col(value)) * w).alias("total"),
        F.sum(clean(F.col(exact)) * w).alias("exact_total"), F.min(clean(F.col(value))).alias("lowest"), F.max(clean(F.col(value))).alias("highest"),
    ]
    if p is not None:
        out.append(F.pow(F.sum(F.pow(e, F.lit(float(p))) * w), F.lit(1.0 / p)).alias("lp"))
    return cells.agg(*out)


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, *, eps: float = 1e-12) -> DataFrame:
    """Rows that differ in value by more than eps both absolutely and relatively, or that one side lacks."""
    l, r = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))  # noqa: E741
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    scale = F.greatest(F.abs("left_value"), F.abs("right_value"))
    return l.join(r, list(keys), "full").where(F.col("left_value").isNull() | F.col("right_value").isNull() | ((gap > eps) & (gap > eps * scale)))
