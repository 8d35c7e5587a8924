"""Multi-material remap: sparse (cell, material) rows throughout, so materials are a key and never a loop."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes, polygon_moments
from ..functions.tolerances import EPS
from . import polyhedra
from .gradient import gradients
from .intersect import _clip_rows, _padded, _ring_moments, intersect_boxes, intersect_polygons, intersect_polyhedral_meshes, offsets_of_area, ring_column


def pure_cells(cells: DataFrame, material: str) -> DataFrame:
    """(id, mat, volfrac 1, centroid, box) of cells that hold one material each; ``material`` is a SQL expression."""
    return cells.withColumn("mat", F.expr(material).cast("int")).withColumn("volfrac", F.lit(1.0))


def sampled_fractions(mesh: DataFrame, dim: int, material: str, samples: int = 16) -> DataFrame:
    """(id, mat, volfrac, c..) by counting a regular grid of sample points a cell in a material expression of x, y, z.

    Covers checkerboards, balls, rotors and any other analytic layout.
    """
    df = mesh.select("id", *[a + e for a in axes(dim) for e in ("lo", "hi")])
    for a in axes(dim):
        df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn(a, F.col(a + "lo") + (F.col("_k") + 0.5) / samples * (F.col(a + "hi") - F.col(a + "lo")))
    df = df.withColumn("mat", F.expr(material).cast("int"))
    return df.groupBy("id", "mat").agg((F.count("*") / F.lit(float(samples**dim))).alias("volfrac"), *[F.avg(a).alias("c" + a) for a in axes(dim)])


#: Material layouts as SQL over x, y (and z): expressions for ``sampled_fractions``.
LAYOUTS = {
    "checkerboard": "pmod(floor(x * 4) + floor(y * 4), 2)",
    "ball": "CASE WHEN pow(x - 0.5, 2) + pow(y - 0.5, 2) < 0.0625 THEN 1 ELSE 0 END",
    "rotor": "pmod(floor(4 * (atan2(y - 0.5, x - 0.5) + pi()) / pi()), 2)",
    "tjunction": "CASE WHEN x < 0.5 THEN 0 WHEN y > 0.5 THEN 1 ELSE 2 END",
}


_SOLID = "id long, mat int, points array<struct<x:double,y:double,z:double>>, facets array<array<int>>"


def half_space_polyhedra(mesh: DataFrame, cuts: Sequence[tuple[int, Sequence[tuple[float, float, float, float]]]]) -> DataFrame:
    """(id, mat, points, facets) exactly, of convex cells: a material is where a x + b y + c z >= d for all its (a, b, c, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _convex_cells(batch)
            for mat, spaces in cuts:
                body = whole
                for a, b, c, d in spaces:
                    length = float(np.sqrt(a * a + b * b + c * c))
                    body = polyhedra.cut(body, np.tile([-a / length, -b / length, -c / length], (batch.num_rows, 1)), np.full(batch.num_rows, -d / length))
                yield _solid_pieces(batch.column("id"), np.full(batch.num_rows, mat), body)

    return mesh.select("id", "points", "facets").mapInArrow(run, _SOLID)


def _convex_cells(batch: pa.RecordBatch) -> polyhedra.Solids:
    whole = polyhedra.load(batch.column("points"), batch.column("facets"))
    if (bent := np.flatnonzero(~polyhedra.convex(whole))).size:
        raise ValueError(f"cell {batch.column('id')[int(bent[0])].as_py()} is not convex with flat faces: cut it into such cells first")
    return whole


def _solid_pieces(ids: pa.Array, mat: np.ndarray, body: polyhedra.Solids) -> pa.RecordBatch:
    some = np.flatnonzero(polyhedra.moments(body.faces, body.faces[:, 0, 0])[:, 0] > EPS)
    points, facets = polyhedra.column(body.take(some))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(mat[some].astype(np.int32)), points, facets], ["id", "mat", "points", "facets"])


def half_plane_polygons(mesh: DataFrame, cuts: Sequence[tuple[int, Sequence[tuple[float, float, float]]]]) -> DataFrame:
    """(id, mat, ring) exactly: a material is where a x + b y >= c for all its (a, b, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _padded(batch.column("ring"))
            for mat, planes in cuts:
                p, n = whole
                for a, b, c in planes:
                    p, n = _clip_rows(p, n, np.tile([float(a), float(b)], (len(n), 1)), np.full(len(n), float(c)))
                yield _pieces(batch.column("id"), np.full(len(n), mat), p, n)

    return mesh.select("id", "ring").mapInArrow(run, "id long, mat int, ring array<struct<x:double,y:double>>")


def _with_slopes(mesh: DataFrame, fractions: DataFrame, adjacency: DataFrame, dim: int) -> DataFrame:
    """(id, parts): each cell's materials in order, with their fractions and the gradients of these."""
    held = fractions.select("id", "mat")  # a cell needs a material's fraction where it or a neighbour holds some of it
    around = held.unionByName(adjacency.join(held, "id").select(F.col("nbr").alias("id"), "mat")).distinct()
    cells = mesh.select("id", *["c" + a for a in axes(dim)], *[a + e for a in axes(dim) for e in ("lo", "hi")])
    dense = cells.join(around, "id").join(fractions.select("id", "mat", "volfrac"), ["id", "mat"], "left").fillna(0.0, subset=["volfrac"])
    slopes = gradients(dense, adjacency, ["volfrac"], dim, material="mat")
    rows = fractions.where(F.col("volfrac") > EPS).join(slopes, ["id", "mat"])
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("mat", "volfrac", *[F.col(f"g_volfrac_{a}").alias(f"g{a}") for a in axes(dim)]))).alias("parts"))


def reconstruct(mesh: DataFrame, fractions: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(id, mat, ring) by piecewise-linear interfaces from volume fractions (2-D).

    In each mixed cell materials are cut off one after the other, in order of their id, by a line whose normal is the
    least-squares gradient of the material's fraction and whose offset gives the right area.
    """
    grouped = _with_slopes(mesh, fractions, adjacency, 2).join(mesh.select("id", "ring"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = _padded(batch.column("ring"))
            size, flat = pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("parts").flatten()
            start, whole = np.cumsum(size) - size, _ring_moments(p, n, "cartesian")[:, 0]
            mat, frac, gx, gy = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mat", "volfrac", "gx", "gy"))
            for k in range(int(size.max(initial=0))):
                live = np.flatnonzero(size > k)
                at, last = start[live] + k, size[live] == k + 1
                own, m = p[live], n[live]
                cut = np.flatnonzero(~last)
                if len(cut):
                    normal = np.stack([gx[at[cut]], gy[at[cut]]], 1)
                    length = np.linalg.norm(normal, axis=1)
                    normal = np.where((length > 1e-14)[:, None], normal / np.maximum(length, 1e-300)[:, None], [1.0, 0.0])
                    q, c = own[cut], m[cut]
                    offset = offsets_of_area(q, c, normal, frac[at[cut]] * whole[live[cut]])
                    p, (rest, left) = p.copy(), _clip_rows(q, c, -normal, -offset)
                    q, c = _clip_rows(q, c, normal, offset)
                    own, m = _put(own, m, cut, q, c)
                    p, n = _put(p, n, live[cut], rest, left)
                yield _pieces(batch.column("id").take(pa.array(live)), mat[at], own, m)

    return grouped.mapInArrow(run, "id long, mat int, ring array<struct<x:double,y:double>>")


def reconstruct_solids(mesh: DataFrame, fractions: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(id, mat, points, facets) by planar interfaces from volume fractions in convex 3-D cells: the same order and normals as
    in the plane, and the offset that gives the right volume."""
    grouped = _with_slopes(mesh, fractions, adjacency, 3).join(mesh.select("id", "points", "facets"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = _convex_cells(batch)
            size, flat = pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("parts").flatten()
            start, whole, live = np.cumsum(size) - size, polyhedra.moments(rest.faces, rest.faces[:, 0, 0])[:, 0], np.arange(batch.num_rows)
            mat, frac, *g = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mat", "volfrac", "gx", "gy", "gz"))
            for k in range(int(size.max(initial=0))):
                last = size[live] == k + 1
                yield _solid_pieces(batch.column("id").take(pa.array(live[last])), mat[start[live[last]] + k], rest.take(np.flatnonzero(last)))
                rest, live = rest.take(np.flatnonzero(~last)), live[~last]
                if not len(live):
                    break
                at = start[live] + k
                normal = -np.stack([x[at] for x in g], 1)  # the material lies up its gradient
                length = np.linalg.norm(normal, axis=1)
                normal = np.where((length > 1e-14)[:, None], normal / np.maximum(length, 1e-300)[:, None], [-1.0, 0.0, 0.0])
                offset = polyhedra.offsets_of_volume(rest, normal, frac[at] * whole[live])
                yield _solid_pieces(batch.column("id").take(pa.array(live)), mat[at], polyhedra.cut(rest, normal, offset))
                rest = polyhedra.cut(rest, -normal, -offset)

    return grouped.mapInArrow(run, _SOLID)


def _put(p: np.ndarray, n: np.ndarray, at: np.ndarray, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded rings with those at ``at`` replaced."""
    width = max(p.shape[1], q.shape[1])
    wide = lambda r: np.concatenate([r, np.repeat(r[:, :1], width - r.shape[1], 1)], 1) if r.shape[1] < width else r
    p, n = wide(p).copy(), n.copy()
    p[at], n[at] = wide(q), c
    return p, n


def _pieces(ids: pa.Array, mat: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(id, mat, ring) of the rings that hold an area."""
    some = np.flatnonzero((n >= 3) & (_ring_moments(p, n, "cartesian")[:, 0] > EPS))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(mat[some].astype(np.int32)), ring_column(p[some], n[some])], ["id", "mat", "ring"])


def material_weights(target: DataFrame, pieces: DataFrame, dim: int = 2) -> DataFrame:
    """(tgt_id, src_id, mat, moments): material pieces against target cells; boxes where there are no rings."""
    if "points" in pieces.columns:
        of = lambda a: F.transform("points", lambda p: p[a])
        boxed = pieces.withColumns({a + e: f(of(a)) for a in axes(3) for e, f in (("lo", F.array_min), ("hi", F.array_max))})
        return intersect_polyhedral_meshes(target, boxed, carry=("mat",))
    if "ring" in pieces.columns:
        boxed = pieces
        for a in ("x", "y"):
            values = F.transform("ring", _axis(a))
            boxed = boxed.withColumns({a + "lo": F.array_min(values), a + "hi": F.array_max(values)})
        return intersect_polygons(target, boxed, carry=("mat",))
    pairs = intersect_boxes(target, pieces, dim)
    return pairs.join(pieces.select(F.col("id").alias("src_id"), "mat"), "src_id")


def _axis(a: str):
    return lambda p: p[a]


def material_cells(weights: DataFrame, target: DataFrame, dim: int, min_volume: float = EPS) -> DataFrame:
    """(id, mat, volfrac, c..) on the target: a cell has a material whose overlaps exceed the minimum volume."""
    sums = weights.groupBy(F.col("tgt_id").alias("id"), "mat").agg(F.sum("m0").alias("_m0"), *[F.sum("m1" + a).alias("_m1" + a) for a in axes(dim)])
    return sums.where(F.col("_m0") > min_volume).join(target.select("id", "vol"), "id").select("id", "mat", (F.col("_m0") / F.col("vol")).alias("volfrac"), *[(F.col("_m1" + a) / F.col("_m0")).alias("c" + a) for a in axes(dim)])


def remap_materials(weights: DataFrame, values: DataFrame, target: DataFrame, fields: Sequence[str], dim: int, *, slopes: DataFrame | None = None, min_volume: float = EPS) -> DataFrame:
    """Material fields (id, mat, c.., fields) on the target's (id, mat), first order or, with slopes, second."""
    used = weights.where(F.abs("m0") > min_volume)
    cols = ["c" + a for a in axes(dim) if slopes is not None]
    met = used.join(values.select(F.col("id").alias("src_id"), "mat", *cols, *fields), ["src_id", "mat"])
    if slopes is not None:
        met = met.join(slopes.withColumnRenamed("id", "src_id"), ["src_id", "mat"])
    out = []
    for f in fields:
        v = F.col(f)
        if slopes is not None:
            for a in axes(dim):
                v = v + F.col(f"g_{f}_{a}") * (F.col("m1" + a) / F.col("m0") - F.col("c" + a))
        out.append((F.sum(v * F.col("m0")) / F.sum("m0")).alias(f))
    got = met.groupBy(F.col("tgt_id").alias("id"), "mat").agg(*out)
    return material_cells(weights, target, dim, min_volume).join(got, ["id", "mat"])


def piece_centroids(pieces: DataFrame) -> DataFrame:
    """(id, mat, volume, c..) of ring or polyhedral pieces; a material may have several in a cell."""
    dim = 3 if "points" in pieces.columns else 2
    names = ["m0", *["m1" + a for a in axes(dim)]]
    if dim == 3:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = polyhedra.body_moments(polyhedra.load(batch.column("points"), batch.column("facets")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mat"), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(4))], ["id", "mat", *names])

        each = pieces.select("id", "mat", "points", "facets").mapInArrow(run, "id long, mat int, m0 double, m1x double, m1y double, m1z double")
    else:
        each = pieces.withColumn("_m", polygon_moments(F.col("ring"))).select("id", "mat", "_m.*")
    total = each.groupBy("id", "mat").agg(*[F.sum(c).alias("_" + c) for c in names]).where("_m0 > 0")
    return total.select("id", "mat", F.col("_m0").alias("volume"), *[(F.col("_m1" + a) / F.col("_m0")).alias("c" + a) for a in axes(dim)])


def material_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, mat, change) where a cell gained (``added``) or lost (``removed``) a material."""
    a, b = before.select("id", "mat", F.lit(True).alias("_a")), after.select("id", "mat", F.lit(True).alias("_b"))
    met = a.join(b, ["id", "mat"], "full").where("_a is null or _b is null")
    return met.select("id", "mat", F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))
