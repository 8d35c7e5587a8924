"""Mismatch check and repair: global constraints as a few scalar aggregates and column updates.

With ``group`` (a part column) every rule works per part on the part's own totals.  Layers of empty cells depend on each
other one by one: the neighbours of up to ONE_TASK rows go through them in one task, more in a distributed step a layer
that reads the layer before only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tolerances import EMPTY_FIXUPS, EPS, PARTIAL_FIXUPS, Tolerances, one_of
from ..plans.storage import materialize


#: Neighbour pairs of empty cells that one task takes.
ONE_TASK = 1_000_000


@dataclass(frozen=True)
class Mismatch:
    source_volume: float
    target_volume: float
    overlap_volume: float
    found: bool


def check_mismatch(weights: DataFrame, source: DataFrame, target: DataFrame, tolerance: float = 100 * EPS) -> Mismatch:
    """Whether the overlaps fail to cover the source or the target volume."""
    vs, vt = (d.agg(F.sum("vol")).first()[0] or 0.0 for d in (source, target))
    vx = weights.agg(F.sum("m0")).first()[0] or 0.0
    off = lambda a, b: abs(a - b) > tolerance * abs(b)
    return Mismatch(vs, vt, vx, off(vx, vs) or off(vx, vt))


def _all(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> list[np.ndarray]:
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in columns] for b in batches if b.num_rows]
    return [np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(len(columns))]


def _layers_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, nbr, known) of empty cells and whether the neighbour is covered: the layer of each cell within reach."""
    cell, nbr, known = _all(batches, ("id", "nbr", "known"))
    ids, a = np.unique(cell, return_inverse=True)
    layer, k = np.zeros(len(ids), np.int32), 1
    if len(ids):
        layer[a[known.astype(bool)]] = 1
        b = np.minimum(np.searchsorted(ids, nbr), len(ids) - 1)
        inner = ids[b] == nbr
        a, b = a[inner], b[inner]
        while True:
            a, b = a[open_ := layer[a] == 0], b[open_]
            new = a[layer[b] == k]
            if not len(new):
                break
            k += 1
            layer[new] = k
    yield pa.RecordBatch.from_arrays([pa.array(ids[layer > 0].astype(np.int64)), pa.array(layer[layer > 0])], ["id", "layer"])


def empty_layers(target: DataFrame, weights: DataFrame, adjacency: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """id, covered, layer: 0 for covered cells, 1.. for empty ones by distance from them, null where out of reach."""
    covered = weights.groupBy(F.col("tgt_id").alias("id")).agg(F.sum("m0").alias("covered"))
    cells = materialize(target.select("id", "vol").join(covered, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0))))
    done = cells.where(F.abs("covered") >= EPS).select("id", F.lit(0).alias("layer"))
    left = materialize(cells.where(F.abs("covered") < EPS).select("id"))
    n_left, layer = left.count(), 0
    if not n_left:
        return cells.select("id", "covered").join(done, "id", "left")
    # neighbours of empty cells only: as small as the gap, however large the mesh
    known = done.select(F.col("id").alias("nbr"), F.lit(True).alias("known"))
    near = materialize(adjacency.join(left, "id", "left_semi").select("id", "nbr").join(known, "nbr", "left").select("id", "nbr", F.coalesce("known", F.lit(False)).alias("known")))
    if near.count() <= one_task:
        found = near.coalesce(1).mapInArrow(_layers_at_once, "id long, layer int")
        return cells.select("id", "covered").join(done.unionByName(found), "id", "left")
    front = near.where("known").select("id").distinct()
    while n_left:
        layer += 1
        new = materialize(front.join(left, "id", "left_semi").withColumn("layer", F.lit(layer)))
        found = new.count()
        if not found:
            break
        done = done.unionByName(new)
        left = materialize(left.join(new, "id", "left_anti"))
        front = near.where("not known").join(new.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id").distinct()
        n_left -= found
    return cells.select("id", "covered").join(done, "id", "left")


def _fill_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, layer, nbr, of, value) of empty cells, with their neighbours' layers and values: the means, layer by layer."""
    cell, layer, nbr, of, value = _all(batches, ("id", "layer", "nbr", "of", "value"))
    ids, a = np.unique(cell, return_inverse=True)
    mean = np.zeros(len(ids))
    for k in range(1, int(layer.max(initial=0)) + 1):
        row = np.flatnonzero((layer == k) & (of < k))
        got = value[row].astype(float)
        if k > 1:
            got = np.where(of[row] > 0, mean[np.minimum(np.searchsorted(ids, nbr[row]), len(ids) - 1)], got)
        count = np.bincount(a[row], minlength=len(ids))
        total = np.bincount(a[row], weights=got, minlength=len(ids))
        mean = np.where(count > 0, total / np.maximum(count, 1), mean)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(mean)], ["id", "_mean"])


def extrapolate(v: DataFrame, adjacency: DataFrame, field: str, one_task: int = ONE_TASK) -> DataFrame:
    """``v`` (id, layer, field, ..) with empty cells set to the mean of their neighbours in the layers before; only those
    cells are written again."""
    known, hollow = v.where("layer is null or layer = 0"), v.where("layer > 0")
    deepest = hollow.agg(F.max("layer")).first()[0] or 0
    if not deepest:
        return v
    near = materialize(adjacency.join(hollow.select("id", "layer"), "id").select("id", "layer", "nbr"))
    if near.count() <= one_task:
        beside = v.where("layer is not null").select(F.col("id").alias("nbr"), F.col("layer").alias("of"), F.col(field).cast("double").alias("value"))
        means = near.join(beside, "nbr").select("id", "layer", "nbr", "of", "value").coalesce(1).mapInArrow(_fill_at_once, "id long, _mean double")
        filled = hollow.join(means, "id", "left").withColumn(field, F.coalesce("_mean", F.lit(0.0))).select(v.columns)
        return known.unionByName(filled)
    front = known.where("layer = 0")
    for k in range(1, deepest + 1):
        cells = hollow.where(F.col("layer") == k)
        means = near.where(F.col("layer") == k).select("id", "nbr").join(front.select(F.col("id").alias("nbr"), F.col(field).alias("_nv")), "nbr").groupBy("id").agg(F.avg("_nv").alias("_mean"))
        front = materialize(cells.join(means, "id", "left").withColumn(field, F.coalesce("_mean", F.lit(0.0))).select(v.columns))
        known = known.unionByName(front)
    return known


def infer_bounds(source: DataFrame, field: str, tolerance: float = 100 * EPS) -> tuple[float, float]:
    """Source minimum and maximum; half the value on either side of a constant field."""
    lo, hi = source.agg(F.min(field), F.max(field)).first()
    if lo is None:
        return -math.inf, math.inf
    if (lo == hi) if lo == 0 else abs((hi - lo) / lo) < tolerance:
        lo, hi = lo - 0.5 * lo, hi + 0.5 * hi
    return lo, hi


def repair(values: DataFrame, target: DataFrame, source: DataFrame, layers: DataFrame, adjacency: DataFrame, field: str, *, partial: str = "globally_conservative",
           empty: str = "extrapolate", bounds: tuple[float, float] | None = None, max_iterations: int = 5, conservation: float = 100 * EPS, compat: bool = False) -> tuple[DataFrame, float]:
    """(id, field) repaired, and the relative conservation error that is left.

    ``compat`` lets the adjustable volume shrink from pass to pass, clamped cells again and again, with infinite steps
    where it reaches zero; the default counts clamped cells anew in each pass and stops when all are clamped.
    """
    partial, empty = one_of(partial, PARTIAL_FIXUPS), one_of(empty, EMPTY_FIXUPS)
    v = values.select("id", field).join(target.select("id", "vol"), "id").join(layers, "id")
    if partial == "locally_conservative":
        gap = F.abs(F.col("covered") - F.col("vol")) / F.col("vol") > Tolerances.volume_difference
        v = v.withColumn(field, F.when((F.abs("covered") >= EPS) & gap, F.col(field) * F.col("covered") / F.col("vol")).otherwise(F.col(field)))
    if empty != "leave_empty":
        v = extrapolate(materialize(v), adjacency, field)
    if partial != "globally_conservative":
        return v.select("id", field), math.nan
    lo, hi = bounds or infer_bounds(source, field)
    wanted = source.agg(F.sum(F.col(field) * F.col("vol"))).first()[0] or 0.0
    open_cell: Column = F.lit(True) if empty != "leave_empty" else F.abs("covered") >= EPS
    v = materialize(v.withColumn("_open", open_cell))
    start = v.agg(F.sum(F.col(field) * F.col("vol")).alias("s"), F.sum(F.when(F.col("_open"), F.col("vol"))).alias("w")).first()
    full = volume = start.w or 0.0
    diff = (start.s or 0.0) - wanted
    rel = _ratio(diff, wanted)
    step, passes = _ratio(diff, volume), 0
    shifts: list[float] = []

    def after(passes_: list[float]) -> Column:
        """The value after so many shifts and clamps: a fold over their array, so the plan grows by a number a pass."""
        held = F.lit(float(lo)), F.lit(float(hi))
        clamped = lambda x: F.when(x < held[0], held[0]).when(x > held[1], held[1]).otherwise(x)
        moved = F.aggregate(F.lit(passes_), F.col(field).cast("double"), lambda x, by: clamped(x - by))
        return F.when(F.col("_open"), moved).otherwise(F.col(field)) if passes_ else F.col(field)

    while abs(rel) > conservation and passes < max_iterations:
        seen = v.select("vol", "_open", after(shifts).alias("_was")).withColumn("_moved", F.col("_was") - F.lit(step))
        low, high = F.col("_open") & (F.col("_moved") < lo), F.col("_open") & (F.col("_moved") > hi)
        value = F.when(low, lo).when(high, hi).when(F.col("_open"), F.col("_moved")).otherwise(F.col("_was"))
        now = seen.agg(F.sum(value * F.col("vol")).alias("s"), F.coalesce(F.sum(F.when(low | high, F.col("vol"))), F.lit(0.0)).alias("c")).first()
        shifts.append(float(step))
        diff = now.s - wanted
        rel, passes = _ratio(diff, wanted), passes + 1
        volume = (volume if compat else full) - now.c
        if not compat and volume <= EPS * full:
            break
        step = _ratio(diff, volume)
    value = after(shifts)
    return v.select("id", value.alias(field)), rel


def _ratio(a: float, b: float) -> float:
    if b == 0:
        return 0.0 if a == 0 else math.copysign(math.inf, a)
    return a / b


def part_repair(parts: Sequence[tuple[DataFrame, DataFrame, DataFrame, DataFrame]], field: str, adjacency: DataFrame, **options) -> DataFrame:
    """Repair per part pair: (values, target cells, source cells, weights) of each; results put together."""
    out = None
    for values, target, source, weights in parts:
        inside = adjacency.join(target.select("id"), "id", "left_semi").join(target.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id", "nbr")
        if check_mismatch(weights, source, target).found:
            values, _ = repair(values, target, source, empty_layers(target, weights, inside), inside, field, **options)
        out = values.select("id", field) if out is None else out.unionByName(values.select("id", field))
    return out


def _over(a: Column, b: Column) -> Column:
    """a / b; nothing over nothing is 0, else infinite."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, 0.0).otherwise(F.signum(a) * F.lit(math.inf))


def part_state(target: DataFrame, source: DataFrame, weights: DataFrame, field: str, part: str, tolerance: float = 100 * EPS) -> DataFrame:
    """A row a part: whether its overlaps miss volume (``found``), the source's bounds (lo, hi) and its total (wanted)."""
    vt = target.groupBy(part).agg(F.sum("vol").alias("vt"))
    vs = source.groupBy(part).agg(F.sum("vol").alias("vs"), F.min(field).alias("lo"), F.max(field).alias("hi"), F.sum(F.col(field) * F.col("vol")).alias("wanted"))
    vx = weights.groupBy(part).agg(F.sum("m0").alias("vx"))
    all_ = vt.join(vs, part, "left").join(vx, part, "left").fillna(0.0, subset=["vs", "vx", "wanted"])
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance * F.abs(F.col(b))
    lo, hi = F.coalesce("lo", F.lit(-math.inf)), F.coalesce("hi", F.lit(math.inf))
    flat = F.when(F.col("lo") == 0, F.col("hi") == 0).otherwise(F.abs(_over(F.col("hi") - F.col("lo"), F.col("lo"))) < tolerance)
    return all_.select(part, (off("vx", "vs") | off("vx", "vt")).alias("found"), F.when(flat, lo - 0.5 * lo).otherwise(lo).alias("lo"), F.when(flat, hi + 0.5 * hi).otherwise(hi).alias("hi"), "wanted")


def repair_parts(values: DataFrame, target: DataFrame, source: DataFrame, weights: DataFrame, adjacency: DataFrame, field: str, *, part: str = "part", partial: str = "globally_conservative",
                 empty: str = "extrapolate", max_iterations: int = 5, conservation: float = 100 * EPS) -> tuple[DataFrame, DataFrame]:
    """Repair of all parts in one plan: (id, field) of every target cell, and (part, found, rel): the error that each part
    that needed repair keeps.

    Target, source and weights have the ``part`` column.  What a part needs to know is a row of a small table (bounds,
    total, shifts so far); a pass is one aggregation by part, however many parts there are.  Neighbours in another part
    don't count.
    """
    partial, empty = one_of(partial, PARTIAL_FIXUPS), one_of(empty, EMPTY_FIXUPS)
    state = materialize(part_state(target, source, weights, field, part))
    cells = target.select("id", part, "vol")
    inside = adjacency.join(cells.select("id", F.col(part).alias("_p")), "id").join(cells.select(F.col("id").alias("nbr"), F.col(part).alias("_q")), "nbr").where("_p = _q").select("id", "nbr")
    layers = empty_layers(target, weights, inside)
    v = values.select("id", field).join(cells, "id").join(layers, "id").join(state.select(part, "found"), part)
    if partial == "locally_conservative":
        gap = F.abs(F.col("covered") - F.col("vol")) / F.col("vol") > Tolerances.volume_difference
        v = v.withColumn(field, F.when(F.col("found") & (F.abs("covered") >= EPS) & gap, F.col(field) * F.col("covered") / F.col("vol")).otherwise(F.col(field)))
    if empty != "leave_empty":
        v = extrapolate(materialize(v), inside, field)
    if partial != "globally_conservative":
        return v.select("id", field), state.select(part, "found", F.lit(None).cast("double").alias("rel"))
    open_cell: Column = F.col("found") if empty != "leave_empty" else F.col("found") & (F.abs("covered") >= EPS)
    v = materialize(v.withColumn("_open", open_cell).select("id", part, "vol", field, "_open"))
    start = v.groupBy(part).agg(F.sum(F.col(field) * F.col("vol")).alias("s"), F.coalesce(F.sum(F.when(F.col("_open"), F.col("vol"))), F.lit(0.0)).alias("full"))
    diff = F.col("s") - F.col("wanted")
    rel = _over(diff, F.col("wanted"))
    known = ["found", "lo", "hi", "wanted", "full"]
    now = state.join(start, part).withColumns({"shifts": F.array().cast("array<double>"), "step": _over(diff, F.col("full")), "rel": rel})
    now = materialize(now.select(part, *known, "shifts", "step", "rel", (F.col("found") & (F.abs(rel) > conservation) & (F.col("full") > 0)).alias("live")))
    clamped = lambda x: F.when(x < F.col("lo"), F.col("lo")).when(x > F.col("hi"), F.col("hi")).otherwise(x)
    after = F.when(F.col("_open"), F.aggregate("shifts", F.col(field).cast("double"), lambda x, by: clamped(x - by))).otherwise(F.col(field))
    for _ in range(max_iterations):
        if now.where("live").isEmpty():
            break
        seen = v.join(now.where("live"), part).withColumn("_was", after).withColumn("_moved", F.col("_was") - F.col("step"))
        held = F.col("_open") & ((F.col("_moved") < F.col("lo")) | (F.col("_moved") > F.col("hi")))
        value = F.when(F.col("_open"), clamped(F.col("_moved"))).otherwise(F.col("_was"))
        sums = seen.groupBy(part).agg(F.sum(value * F.col("vol")).alias("s"), F.coalesce(F.sum(F.when(held, F.col("vol"))), F.lit(0.0)).alias("c"))
        free = F.col("full") - F.col("c")
        told = now.join(sums, part, "left").withColumn("_more", F.col("live"))
        pick = lambda new, old: F.when(F.col("_more"), new).otherwise(F.col(old))
        now = materialize(told.select(part, *known, pick(F.concat("shifts", F.array("step")), "shifts").alias("shifts"), pick(_over(diff, free), "step").alias("step"), pick(rel, "rel").alias("rel"), F.coalesce(F.col("_more") & (F.abs(rel) > conservation) & (free > EPS * F.col("full")), F.lit(False)).alias("live")))
    done = v.join(now.select(part, "lo", "hi", "shifts"), part).select("id", after.alias(field))
    return done, now.select(part, "found", "rel")
