"""Per-pair geometry: overlap moments as rows (tgt_id, src_id, m0, m1x[, m1y[, m1z]]), the weights relation.

Boxes are plain column arithmetic.  Convex polygons clip a whole Arrow batch at once, one half-plane after the other;
other polygons are signed sums of triangles.  Polyhedra are clipped in batches too (see ``polyhedra``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes, moments
from ..functions.tolerances import Tolerances
from . import polyhedra
from .search import box_pairs


def intersect_boxes(target: DataFrame, source: DataFrame, dim: int, *, system: str = "cartesian", equal: tuple[str, ...] = (), pairs: DataFrame | None = None) -> DataFrame:
    """Weights of box meshes; pairs without volume are dropped.  Give ``pairs`` to reuse a search."""
    box = [a + e for a in axes(dim) for e in ("lo", "hi")]
    if pairs is None:
        met = box_pairs(target, source, dim, equal=equal, keep_target=[*box, *equal], keep_source=box)
    else:
        t = target.select(F.col("id").alias("tgt_id"), *[F.col(c).alias("t_" + c) for c in [*box, *equal]])
        s = source.select(F.col("id").alias("src_id"), *[F.col(c).alias("s_" + c) for c in box])
        met = pairs.join(t, "tgt_id").join(s, "src_id")
    lo = [F.greatest("t_" + a + "lo", "s_" + a + "lo") for a in axes(dim)]
    hi = [F.least("t_" + a + "hi", "s_" + a + "hi") for a in axes(dim)]
    wide = F.lit(True)
    for a, b in zip(lo, hi, strict=True):
        wide = wide & (b > a)
    m0, m1 = moments(lo, hi, system)
    out = met.where(wide).select("tgt_id", "src_id", *[F.col("t_" + c).alias(c) for c in equal], m0.alias("m0"), *[m.alias("m1" + a) for a, m in zip(axes(dim), m1, strict=True)])
    return out.where("m0 > 0")


# ---- polygons ----


def area_moments(p: np.ndarray) -> np.ndarray:
    """Signed [area, int x, int y] of a ring (n, 2)."""
    q = np.roll(p, -1, 0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return np.array([c.sum() / 2, ((p[:, 0] + q[:, 0]) * c).sum() / 6, ((p[:, 1] + q[:, 1]) * c).sum() / 6])


def second_moments(p: np.ndarray) -> tuple[float, float, float]:
    """int x^2, int xy, int y^2 of a ring."""
    q = np.roll(p, -1, 0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    xx = (c * (p[:, 0] ** 2 + p[:, 0] * q[:, 0] + q[:, 0] ** 2)).sum() / 12
    yy = (c * (p[:, 1] ** 2 + p[:, 1] * q[:, 1] + q[:, 1] ** 2)).sum() / 12
    xy = (c * (p[:, 0] * q[:, 1] + 2 * p[:, 0] * p[:, 1] + 2 * q[:, 0] * q[:, 1] + q[:, 0] * p[:, 1])).sum() / 24
    return xx, xy, yy


def clip(p: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    """The part of a ring with normal . x >= offset."""
    if len(p) < 3:
        return p[:0]
    d = p @ normal - offset
    inside = d >= 0
    if inside.all():
        return p
    if not inside.any():
        return p[:0]
    out = []
    for i in range(len(p)):
        j = (i + 1) % len(p)
        if inside[i]:
            out.append(p[i])
        if inside[i] != inside[j]:
            out.append(p[i] + (p[j] - p[i]) * (d[i] / (d[i] - d[j])))
    return np.array(out)


def convex(p: np.ndarray, tolerance: float) -> bool:
    a, b, c = p, np.roll(p, -1, 0), np.roll(p, -2, 0)
    cross = (b[:, 0] - a[:, 0]) * (c[:, 1] - b[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - b[:, 0])
    return bool((cross >= -tolerance * np.linalg.norm(b - a, axis=1)).all())


def _clip_to(p: np.ndarray, window: np.ndarray) -> np.ndarray:
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        normal = np.array([a[1] - b[1], b[0] - a[0]])  # to the left of a counter-clockwise edge
        p = clip(p, normal, float(normal @ a))
        if not len(p):
            break
    return p


def _ears(p: np.ndarray) -> list[np.ndarray]:
    """Triangles of a simple counter-clockwise ring."""
    left, out = list(range(len(p))), []
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    guard = 0
    while len(left) > 3 and guard < len(p) ** 2:
        guard += 1
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            if cross(p[i], p[j], p[m]) <= 0:
                continue
            if any(cross(p[i], p[j], p[v]) >= 0 and cross(p[j], p[m], p[v]) >= 0 and cross(p[m], p[i], p[v]) >= 0 for v in left if v not in (i, j, m)):
                continue
            out.append(p[[i, j, m]])
            left.pop(k)
            break
        else:
            raise ValueError("the ring is not simple")
    out.append(p[left])
    return out


def intersect_rings(source: np.ndarray, target: np.ndarray, system: str = "cartesian", tolerance: float | None = None) -> np.ndarray:
    """[m0, m1x, m1y] of the overlap.  A non-convex window is swapped for a convex one, else cut into triangles."""
    tolerance = Tolerances.min_absolute_distance(2) if tolerance is None else tolerance
    if convex(target, tolerance):
        parts = [(source, target)]
    elif convex(source, tolerance):
        parts = [(target, source)]
    else:
        parts = [(source, t) for t in _ears(target)]
    total = np.zeros(3)
    for p, window in parts:
        got = _clip_to(p, window)
        if len(got) < 3:
            continue
        m = area_moments(got)
        if system == "cylindrical_axisymmetric":  # x is the radius: weights 2 pi r
            xx, xy, _ = second_moments(got)
            m = 2 * np.pi * np.array([m[1], xx, xy])
        elif system != "cartesian":
            raise ValueError(system)
        total += m
    return total


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rings as (rows, most vertices, 2), and their lengths; places past the end hold the first vertex."""
    size, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
    xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1)
    start = np.cumsum(size) - size
    at = np.arange(int(size.max(initial=0)))
    return xy[start[:, None] + np.where(at < size[:, None], at, 0)], size


def ring_column(p: np.ndarray, n: np.ndarray) -> pa.Array:
    """Padded rings as a column of lists of points."""
    held = np.arange(p.shape[1]) < n[:, None]
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    xy = p[held]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"]))


def offsets_of_area(p: np.ndarray, n: np.ndarray, normal: np.ndarray, area: np.ndarray) -> np.ndarray:
    """For each ring the offset whose half-plane normal . x >= offset holds the given area of it.

    Between the heights of two vertices the area is a quadratic, which three cuts fix: the root has a closed form.
    """
    rows = np.arange(len(n))
    height = np.sort(p[:, :, 0] * normal[:, None, 0] + p[:, :, 1] * normal[:, None, 1], 1)[:, ::-1]  # padding repeats a vertex
    held = lambda offset: _ring_moments(*_clip_rows(p, n, normal, offset), "cartesian")[:, 0]
    at = np.stack([held(height[:, k]) for k in range(height.shape[1])], 1)
    k = np.minimum((at < area[:, None]).sum(1), height.shape[1] - 1)
    k = np.maximum(k, 1) if height.shape[1] > 1 else k
    top, bottom, a0, a1 = height[rows, k - 1], height[rows, k], at[rows, k - 1], at[rows, k]
    half = held((top + bottom) / 2)
    two, one, none = 2 * (a1 + a0 - 2 * half), 4 * half - 3 * a0 - a1, a0 - area
    root = one + np.sqrt(np.maximum(one * one - 4 * two * none, 0.0))
    t = np.clip(np.divide(-2 * none, root, out=np.zeros_like(root), where=root > 0), 0.0, 1.0)
    return top + (bottom - top) * t


def _convex_rows(p: np.ndarray, n: np.ndarray, tolerance: float) -> np.ndarray:
    at = np.arange(p.shape[1])
    step = lambda k: np.take_along_axis(p, ((at + k) % np.maximum(n[:, None], 1))[:, :, None], 1)
    ab, bc = step(1) - step(0), step(2) - step(1)
    cross = ab[:, :, 0] * bc[:, :, 1] - ab[:, :, 1] * bc[:, :, 0]
    return ((cross >= -tolerance * np.sqrt((ab**2).sum(2))) | (at >= n[:, None])).all(1)


def _clip_rows(p: np.ndarray, n: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ring's part with normal . x >= offset."""
    rows, most = p.shape[:2]
    at = np.arange(most)
    d = p[:, :, 0] * normal[:, None, 0] + p[:, :, 1] * normal[:, None, 1] - offset[:, None]
    valid = at < n[:, None]
    inside = d >= 0
    if (inside | ~valid).all():
        return p, n
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    q, e = np.take_along_axis(p, after[:, :, None], 1), np.take_along_axis(d, after, 1)
    crosses = valid & (inside != (e >= 0))
    met = p + (q - p) * np.divide(d, d - e, out=np.zeros_like(d), where=crosses)[:, :, None]
    points = np.stack([p, met], 2).reshape(rows, 2 * most, 2)
    sent = np.stack([valid & inside, crosses], 2).reshape(rows, 2 * most)
    count = sent.sum(1)
    out = np.zeros((rows, max(int(count.max(initial=0)), 1), 2))
    row, col = np.nonzero(sent)
    out[row, (np.cumsum(sent, 1) - 1)[row, col]] = points[row, col]
    first = np.arange(out.shape[1]) >= count[:, None]
    return np.where(first[:, :, None], out[:, :1], out), count


def _ring_moments(p: np.ndarray, n: np.ndarray, system: str) -> np.ndarray:
    """[m0, m1x, m1y] of each ring; places past the end repeat the first vertex and add nothing."""
    q = np.concatenate([p[:, 1:], p[:, :1]], 1)
    x, y, u, v = p[:, :, 0], p[:, :, 1], q[:, :, 0], q[:, :, 1]
    c = x * v - u * y
    area, mx, my = c.sum(1) / 2, ((x + u) * c).sum(1) / 6, ((y + v) * c).sum(1) / 6
    if system == "cylindrical_axisymmetric":  # x is the radius: weights 2 pi r
        xx, xy = (c * (x * x + x * u + u * u)).sum(1) / 12, (c * (x * v + 2 * x * y + 2 * u * v + u * y)).sum(1) / 24
        area, mx, my = 2 * np.pi * mx, 2 * np.pi * xx, 2 * np.pi * xy
    elif system != "cartesian":
        raise ValueError(system)
    return np.where((n >= 3)[:, None], np.stack([area, mx, my], 1), 0.0)


def intersect_ring_rows(source: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray], system: str = "cartesian") -> np.ndarray:
    """[m0, m1x, m1y] of each pair of rings (padded rows and their lengths)."""
    tolerance = Tolerances.min_absolute_distance(2)
    rows = len(source[1])
    total, left = np.zeros((rows, 3)), np.ones(rows, bool)
    for (window, w), (p, n) in ((target, source), (source, target)):
        at = np.flatnonzero(left & _convex_rows(window, w, tolerance)) if rows else np.zeros(0, np.int64)
        if not len(at):
            continue
        left[at] = False
        cut, size, window, w = p[at], n[at], window[at], w[at]
        for k in range(window.shape[1]):
            a, b = window[:, k], window[np.arange(len(at)), np.where(k + 1 < w, k + 1, 0)]
            normal = np.where((k < w)[:, None], np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]], 1), 0.0)  # to the left of a counter-clockwise edge; no edge cuts nothing
            cut, size = _clip_rows(cut, size, normal, (normal * a).sum(1))
        total[at] = _ring_moments(cut, size, system)
    # a window that is not convex is the signed sum of its triangles from the first vertex, whatever their order
    at = np.flatnonzero(left)
    if len(at):
        p, n, window, w = source[0][at], source[1][at], target[0][at], target[1][at]
        for k in range(1, int(w.max()) - 1):
            a, b, c = window[:, 0], window[:, k], window[np.arange(len(at)), np.where(k + 1 < w, k + 1, k)]
            sign = np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))
            some = np.flatnonzero(sign)
            turned = (sign < 0)[:, None]
            tri = np.stack([a, np.where(turned, c, b), np.where(turned, b, c)], 1)[some]
            cut, size = p[some], n[some]
            for e in range(3):
                u, v = tri[:, e], tri[:, (e + 1) % 3]
                normal = np.stack([u[:, 1] - v[:, 1], v[:, 0] - u[:, 0]], 1)
                cut, size = _clip_rows(cut, size, normal, (normal * u).sum(1))
            total[at[some]] += sign[some, None] * _ring_moments(cut, size, system)
    return total


def intersect_polygons(target: DataFrame, source: DataFrame, *, system: str = "cartesian", equal: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Weights of polygon meshes (``ring`` columns) in 2-D; ``carry`` keeps source columns such as a material."""
    met = box_pairs(target, source, 2, equal=equal, keep_target=["ring", *equal], keep_source=["ring", *carry])
    extra = [F.col("t_" + c).alias(c) for c in equal] + [F.col("s_" + c).alias(c) for c in carry]
    met = met.select("tgt_id", "src_id", *extra, "t_ring", "s_ring")
    names = [c for c in met.columns if c not in ("t_ring", "s_ring")]
    schema = ", ".join([f"{c} {met.schema[c].dataType.simpleString()}" for c in names] + ["m0 double", "m1x double", "m1y double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = intersect_ring_rows(_padded(batch.column("s_ring")), _padded(batch.column("t_ring")), system)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(3))], [*names, "m0", "m1x", "m1y"])
            yield out.filter(pa.array(m[:, 0] > 0))

    return met.mapInArrow(run, schema)


# ---- polyhedra ----


#: Corner order and outward facets of a box cell (fixed by the x-fastest corner numbering).
BOX_FACETS = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]


def intersect_polyhedral_meshes(target: DataFrame, source: DataFrame, *, equal: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Weights of 3-D meshes with ``points`` array<struct<x,y,z>> and ``facets`` array<array<int>> (counter-clockwise from
    outside); ``carry`` keeps source columns such as a material."""
    met = box_pairs(target, source, 3, closed=False, equal=equal, keep_target=["points", "facets", *equal], keep_source=["points", "facets", *carry])
    met = met.select("tgt_id", "src_id", *[F.col("t_" + c).alias(c) for c in equal], *[F.col("s_" + c).alias(c) for c in carry], "t_points", "t_facets", "s_points", "s_facets")
    names = [c for c in met.columns if not c.endswith(("_points", "_facets"))]
    schema = ", ".join([f"{c} {met.schema[c].dataType.simpleString()}" for c in names] + ["m0 double", "m1x double", "m1y double", "m1z double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, polyhedra.PAIRS):
                part = batch.slice(at, polyhedra.PAIRS)
                m = polyhedra.overlaps(polyhedra.load(part.column("s_points"), part.column("s_facets")), polyhedra.load(part.column("t_points"), part.column("t_facets")))
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(4))], [*names, "m0", "m1x", "m1y", "m1z"])
                yield out.filter(pa.array(m[:, 0] > 0))

    return met.mapInArrow(run, schema)


def intersect(target: DataFrame, source: DataFrame, dim: int, **options) -> DataFrame:
    """Weights of any mesh: polyhedra or polygons where such columns exist, else boxes."""
    if dim == 3 and "points" in target.columns:
        return intersect_polyhedral_meshes(target, source, **options)
    if dim == 2 and "ring" in target.columns and "ring" in source.columns:
        return intersect_polygons(target, source, **options)
    return intersect_boxes(target, source, dim, **options)


def reverse_weights(weights: DataFrame) -> DataFrame:
    """For each source its (target, moments), as one row a source."""
    moments_ = [c for c in weights.columns if c not in ("tgt_id", "src_id")]
    return weights.groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct("tgt_id", *moments_))).alias("targets"))
