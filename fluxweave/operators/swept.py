"""Swept-region weights: for meshes of one topology whose nodes have moved a little.

A face sweeps a region while it moves.  Regions that leave a cell carry its own material with a negative sign;
regions that it gains belong to the neighbour across the face.  Faces are independent rows, so this is an explode and
a per-row moment, never a spatial join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_moments
from ..functions.tolerances import EPS
from . import polyhedra


def edges_of_rings(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row an edge of each cell: id, the cells' ring length and the edge's ends before (a, b) and after (ta, tb)."""
    met = source.select("id", F.col("ring").alias("s")).join(target.select("id", F.col("ring").alias("t")), "id")
    n = F.size("s")
    at = lambda r, i: F.element_at(F.col(r), (F.pmod(i, n) + 1).cast("int"))
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("edge"), at("s", i).alias("a"), at("s", i + 1).alias("b"), at("t", i).alias("ta"), at("t", i + 1).alias("tb")))
    return met.select("id", F.explode(edge).alias("e")).select("id", "e.*")


def box_edge_neighbours(nx: int, ny: int) -> Column:
    """The neighbour across an edge of a logically rectangular mesh whose rings start at the lower left; null outside."""
    i, j, e = F.col("id") % nx, F.floor(F.col("id") / nx), F.col("edge")
    return (
        F.when((e == 0) & (j > 0), F.col("id") - nx).when((e == 1) & (i < nx - 1), F.col("id") + 1).when((e == 2) & (j < ny - 1), F.col("id") + nx).when((e == 3) & (i > 0), F.col("id") - 1)
    )


def swept_weights_2d(source: DataFrame, target: DataFrame, neighbour: Column, *, min_volume: float = EPS, check: bool = False) -> DataFrame:
    """(tgt_id, src_id, m0, m1x, m1y): each cell's own moments, and a row a swept region.  Weights may be negative.

    Boundary faces are skipped.  ``check`` raises where a gained region's centroid is outside the neighbour's box.
    """
    own = source.withColumn("_m", polygon_moments(F.col("ring"))).select(F.col("id").alias("tgt_id"), F.col("id").alias("src_id"), "_m.m0", "_m.m1x", "_m.m1y")
    faces = edges_of_rings(source, target).withColumn("nbr", neighbour).where("nbr is not null")
    swept = faces.withColumn("_m", polygon_moments(F.array("b", "a", "ta", "tb"))).where(F.abs("_m.m0") >= min_volume)
    gained = F.col("_m.m0") > 0
    rows = swept.select(F.col("id").alias("tgt_id"), F.when(gained, F.col("nbr")).otherwise(F.col("id")).alias("src_id"), "_m.m0", "_m.m1x", "_m.m1y")
    if check:
        box = source.select(F.col("id").alias("src_id"), *[f(F.transform("ring", _axis(a))).alias(a + e) for a in ("x", "y") for e, f in (("lo", F.array_min), ("hi", F.array_max))])
        inside = F.lit(True)
        for a in ("x", "y"):
            c = F.col("m1" + a) / F.col("m0")
            inside = inside & (c >= F.col(a + "lo") - 1e-12) & (c <= F.col(a + "hi") + 1e-12)
        met = rows.join(box, "src_id")
        bad = F.raise_error(F.concat(F.lit("the displacement of cell "), F.col("tgt_id").cast("string"), F.lit(" is too large")))
        rows = met.select("tgt_id", "src_id", F.when((F.col("m0") > 0) & ~inside, bad.cast("double")).otherwise(F.col("m0")).alias("m0"), "m1x", "m1y")
    return own.unionByName(rows)


def _axis(a: str):
    return lambda p: p[a]


def _between(before: pa.Array, after: pa.Array) -> polyhedra.Solids:
    """The bodies between two rings each: both rings and a side for each of their edges."""
    n = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64)
    rows, most = len(n), int(n.max(initial=3))
    k, start = np.arange(most), np.cumsum(n) - n
    padded = lambda c, at: c.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)[start[:, None] + np.where(k < n[:, None], at, 0)]
    back = np.maximum(n[:, None] - 1 - k, 0)
    after_k = np.where(k + 1 < n[:, None], k + 1, 0)
    p, q = padded(before, k), padded(after, k)
    faces, size = np.zeros((rows, 2 + most, max(most, 4), 3)), np.zeros((rows, 2 + most), np.int64)
    faces[:, 0, :most], faces[:, 1, :most], size[:, :2] = padded(before, back), q, n[:, None]
    size[:, 2:] = np.where(k < n[:, None], 4, 0)
    for v, ring in enumerate((p, np.take_along_axis(p, after_k[:, :, None], 1), np.take_along_axis(q, after_k[:, :, None], 1), q)):
        faces[:, 2:, v] = ring
    return polyhedra.Solids(np.where((np.arange(faces.shape[2]) < size[:, :, None])[..., None], faces, faces[:, :, :1]), size)


def swept_weights_3d(cells: DataFrame, faces: DataFrame, *, min_volume: float = EPS, check: bool = False) -> DataFrame:
    """cells: id, m0, m1x, m1y, m1z; faces: id, nbr, before, after (outward counter-clockwise rings of [x, y, z]).

    The swept region is the polyhedron between both rings.  ``check`` raises beyond 1.5 cell volumes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = polyhedra.body_moments(_between(batch.column("before"), batch.column("after")))
            id_, vol = batch.column("id"), batch.column("vol").to_numpy(zero_copy_only=False)
            if check and (far := np.flatnonzero(np.abs(m[:, 0]) > 1.5 * vol)).size:
                raise ValueError(f"the displacement of cell {id_[int(far[0])].as_py()} is too large")
            src = pc.if_else(pa.array(m[:, 0] > 0), batch.column("nbr"), id_)
            out = pa.RecordBatch.from_arrays([id_, src, *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(4))], ["tgt_id", "src_id", "m0", "m1x", "m1y", "m1z"])
            yield out.filter(pa.array(np.abs(m[:, 0]) >= min_volume))

    moved = faces.where("nbr is not null").join(cells.select("id", F.col("m0").alias("vol")), "id")
    rows = moved.mapInArrow(run, "tgt_id long, src_id long, m0 double, m1x double, m1y double, m1z double")
    return cells.select(F.col("id").alias("tgt_id"), F.col("id").alias("src_id"), "m0", "m1x", "m1y", "m1z").unionByName(rows)
