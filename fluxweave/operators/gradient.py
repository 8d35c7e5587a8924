"""Least-squares gradients over node neighbours, limiters and quadratic fits.

Sums of a stencil are one aggregation over adjacency joined with values; all fields share it.  The 2x2 or 3x3 system
is solved in closed form, so everything stays in generated code; a singular stencil has a zero gradient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.tolerances import BOUNDARY_LIMITERS, LIMITERS, one_of


def _solve(a: dict[tuple[int, int], Column], b: list[Column]) -> list[Column]:
    """Cramer's rule for a symmetric system of up to three unknowns; zero where singular."""
    at = lambda i, j: a[min(i, j), max(i, j)]
    dim = len(b)
    if dim == 1:
        det = at(0, 0)
        top = [b[0]]
        scale = F.abs(at(0, 0))
    elif dim == 2:
        det = at(0, 0) * at(1, 1) - at(0, 1) * at(0, 1)
        top = [b[0] * at(1, 1) - b[1] * at(0, 1), at(0, 0) * b[1] - at(0, 1) * b[0]]
        scale = at(0, 0) * at(1, 1)
    else:
        minor = lambda p, q, r, s: p * s - q * r
        cof = [
            minor(at(1, 1), at(1, 2), at(1, 2), at(2, 2)), -minor(at(0, 1), at(1, 2), at(0, 2), at(2, 2)), minor(at(0, 1), at(1, 1), at(0, 2), at(1, 2)),
            minor(at(0, 0), at(0, 2), at(0, 2), at(2, 2)), -minor(at(0, 0), at(0, 1), at(0, 2), at(1, 2)), minor(at(0, 0), at(0, 1), at(0, 1), at(1, 1)),
        ]
        det = at(0, 0) * cof[0] + at(0, 1) * cof[1] + at(0, 2) * cof[2]
        top = [b[0] * cof[0] + b[1] * cof[1] + b[2] * cof[2], b[0] * cof[1] + b[1] * cof[3] + b[2] * cof[4], b[0] * cof[2] + b[1] * cof[4] + b[2] * cof[5]]
        scale = at(0, 0) * at(1, 1) * at(2, 2)
    good = F.abs(det) > 1e-13 * F.abs(scale)
    return [F.when(good, t / F.when(good, det)).otherwise(0.0) for t in top]


def _corners(cells: DataFrame, dim: int, ref: Sequence[str]) -> list[list[Column]]:
    """Offsets of a box's corners from the reference point."""
    out: list[list[Column]] = [[]]
    for a, r in zip(axes(dim), ref, strict=True):
        out = [[*c, F.col(a + e) - F.col(r)] for c in out for e in ("lo", "hi")]
    return out


def gradients(cells: DataFrame, adjacency: DataFrame, fields: Sequence[str], dim: int, *, limiter: str = "nolimiter", boundary_limiter: str = "bnd_nolimiter",
              ref: str = "c", part: str | None = None, material: str | None = None) -> DataFrame:
    """id (and material) with g_{field}_{axis} for every field.

    ``ref``: prefix of the reference point (``c`` centroids, ``p`` nodes).  ``part`` keeps stencils within a part;
    ``material`` keys cells by (id, material), with a row a material.
    """
    limiter, boundary_limiter = one_of(limiter, LIMITERS), one_of(boundary_limiter, BOUNDARY_LIMITERS)
    points, extra = [ref + a for a in axes(dim)], [c for c in (part, material) if c]
    near = cells.select(F.col("id").alias("nbr"), *[F.col(c).alias("_n_" + c) for c in [*points, *fields, *extra]])
    own = cells.select("id", *points, *fields, *extra)
    met = adjacency.join(own, "id").join(near, "nbr")
    for c in extra:
        met = met.where(F.col(c) == F.col("_n_" + c))
    dx = [F.col("_n_" + p) - F.col(p) for p in points]
    sums = [F.sum(dx[i] * dx[j]).alias(f"_a{i}{j}") for i in range(dim) for j in range(i, dim)]
    for f in fields:
        dv = F.col("_n_" + f) - F.col(f)
        sums += [F.sum(dx[i] * dv).alias(f"_b{i}_{f}") for i in range(dim)] + [F.min("_n_" + f).alias("_lo_" + f), F.max("_n_" + f).alias("_hi_" + f)]
    keys = ["id", *([material] if material else [])]
    stencil = met.groupBy(*keys).agg(*sums)
    vertices = "points" if dim == 3 else "ring"
    shape = [vertices] if vertices in cells.columns else [a + e for a in axes(dim) for e in ("lo", "hi")]
    df = cells.select(*keys, *points, *fields, *[c for c in shape if c in cells.columns], *(["is_boundary"] if "is_boundary" in cells.columns else [])).join(stencil, keys, "left")
    a = {(i, j): F.col(f"_a{i}{j}") for i in range(dim) for j in range(i, dim)}
    edge = F.col("is_boundary") if "is_boundary" in cells.columns else F.lit(False)
    for f in fields:
        solved = _solve(a, [F.col(f"_b{i}_{f}") for i in range(dim)])
        df = df.withColumns({f"_g{i}": F.coalesce(g, F.lit(0.0)) for i, g in enumerate(solved)})
        g = [F.col(f"_g{i}") for i in range(dim)]
        low, high = F.least("_lo_" + f, f), F.greatest("_hi_" + f, f)

        def slope(d: Column, f=f, low=low, high=high) -> Column:
            return F.when(d == 0, 1.0).otherwise((F.when(d > 0, high).otherwise(low) - F.col(f)) / F.when(d != 0, d))

        if shape == [vertices]:
            phi = F.aggregate(vertices, F.lit(1.0), _vertex_step(slope, g, points, axes(dim)))
        else:
            phi = F.least(F.lit(1.0), *[slope(sum((gi * c for gi, c in zip(g, corner, strict=True)), F.lit(0.0))) for corner in _corners(df, dim, points)])
        limited = F.coalesce(phi, F.lit(1.0))
        inner = limited if limiter == "barth_jespersen" else F.lit(1.0)
        outer = {"bnd_nolimiter": F.lit(1.0), "bnd_zero_gradient": F.lit(0.0), "bnd_barth_jespersen": limited}[boundary_limiter]
        df = df.withColumn("_phi", F.when(edge, outer).otherwise(inner))
        df = df.withColumns({f"g_{f}_{x}": F.col(f"_g{i}") * F.col("_phi") for i, x in enumerate(axes(dim))})
    return df.select(*keys, *[f"g_{f}_{x}" for f in fields for x in axes(dim)])


def _vertex_step(slope, g, points, names):
    return lambda acc, v: F.least(acc, slope(sum((gi * (v[a] - F.col(p)) for gi, a, p in zip(g, names, points, strict=True)), F.lit(0.0))))


def quadratic_fit(cells: DataFrame, adjacency: DataFrame, field: str, dim: int, *, limiter: str = "nolimiter", ref: str = "c") -> DataFrame:
    """id and ``q``: coefficients of the least-squares quadratic around each cell (x.., then xx, xy, .. yy, ..).

    v(x) = v0 + sum g_i dx_i + sum_{i<=j} h_ij dx_i dx_j.  Boundary cells, and stencils that are too small, fit a line.
    Coefficients are the minimum-norm solution; the limiter scales all of them by one factor over the stencil's points.
    """
    points, n_lin, n_all = [ref + a for a in axes(dim)], dim, dim * (dim + 3) // 2
    near = cells.select(F.col("id").alias("nbr"), *[F.col(p).alias("_n_" + p) for p in points], F.col(field).alias("_n_v"))
    own = cells.select("id", *points, F.col(field).alias("_v"), *(["is_boundary"] if "is_boundary" in cells.columns else [F.lit(False).alias("is_boundary")]))
    met = adjacency.join(own, "id").join(near, "nbr")
    stencil = F.sort_array(F.collect_list(F.struct(*[(F.col("_n_" + p) - F.col(p)).alias(f"d{i}") for i, p in enumerate(points)], (F.col("_n_v") - F.col("_v")).alias("dv"))))
    grouped = met.groupBy("id").agg(F.first("is_boundary").alias("edge"), stencil.alias("s"))  # a stencil is a few cells
    limiter = one_of(limiter, LIMITERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, s = batch.num_rows, batch.column("s")
            size, flat = pc.list_value_length(s).to_numpy(), s.flatten()
            row = np.repeat(np.arange(rows), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            full, v = np.zeros((rows, int(size.max(initial=0)), n_all)), np.zeros((rows, int(size.max(initial=0))))
            d = [flat.field(f"d{i}").to_numpy() for i in range(dim)]
            for k, x in enumerate([*d, *[d[i] * d[j] for i in range(dim) for j in range(i, dim)]]):
                full[row, at, k] = x
            v[row, at] = flat.field("dv").to_numpy()
            c, line = np.zeros((rows, n_all)), batch.column("edge").to_numpy(zero_copy_only=False).astype(bool) | (size < n_all)
            for part, use in ((np.flatnonzero(line), n_lin), (np.flatnonzero(~line), n_all)):
                if len(part):  # rows of zeros change no least-squares solution
                    c[part, :use] = (np.linalg.pinv(full[part, :, :use], rcond=np.finfo(float).eps * max(full.shape[1], use)) @ v[part][:, :, None])[:, :, 0]
            if limiter == "barth_jespersen" and rows:
                p = (full @ c[:, :, None])[:, :, 0] / 2
                bound = np.where(p > 0, v.max(1, initial=0.0)[:, None], v.min(1, initial=0.0)[:, None])
                c *= np.divide(bound, p, out=np.ones_like(p), where=p != 0).min(1, initial=1.0)[:, None]
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(n_all))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(c.ravel()))], ["id", "q"])

    fits = grouped.mapInArrow(run, "id long, q array<double>")
    return cells.select("id").join(fits, "id", "left").withColumn("q", F.coalesce("q", F.array_repeat(F.lit(0.0), n_all)))
