"""Particle (meshfree) operators: supports, accumulation of local regressions, estimates, integrals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..functions.kernels import basis, basis_size, faceted_weight, own_weight, weight
from ..sources import topology
from .search import point_pairs


def support(particles: DataFrame, dim: int, geometry: str) -> list[str]:
    """The columns that a particle's weights depend on: its place, lengths and, where used, facets, kernel and geometry."""
    facets = geometry == "faceted" or (geometry == "own" and "facets" in particles.columns)
    return [*axes(dim), *["h" + a for a in axes(dim)], *(["facets"] if facets else []), *(["kernel", "geometry"] if geometry == "own" else [])]


def pair_weights(target: DataFrame, source: DataFrame, dim: int, *, kernel_name: str = "b4", geometry: str = "elliptic", center: str = "gather", scale: float = 2.0, closed: bool = False) -> DataFrame:
    """(tgt_id, src_id, w, d{x,y,z}): unnormalised kernel weights of all pairs in reach; d is target minus source.

    Particles have columns x.., hx..; a faceted side also has ``facets``.  With geometry ``own``, each particle of the side
    that the weights are centred on has its kernel, its geometry (columns ``kernel`` and ``geometry``) and its lengths.
    Sources that stand for several particles of one place (``search.places``) give their pairs the number, ``_many``.
    """
    side, own = ("t_", target) if center == "gather" else ("s_", source)
    keep_t, keep_s = (support(own, dim, geometry), list(axes(dim))) if center == "gather" else (list(axes(dim)), support(own, dim, geometry))
    facets, many = "facets" in (keep_t if center == "gather" else keep_s), [c for c in ("_many",) if c in source.columns]
    met = point_pairs(target, source, dim, center=center, scale=scale, closed=closed, keep_target=keep_t, keep_source=[*keep_s, *many])
    t, s = [F.col("t_" + a) for a in axes(dim)], [F.col("s_" + a) for a in axes(dim)]
    mine, other = (t, s) if center == "gather" else (s, t)
    if geometry == "own":
        w = own_weight(F.col(side + "kernel"), F.col(side + "geometry"), t, s, [F.col(side + "h" + a) for a in axes(dim)], mine, other, F.col(side + "facets") if facets else None)
    elif geometry == "faceted":
        w = faceted_weight(kernel_name, mine, other, F.col(side + "facets"))
    else:
        w = weight(geometry, kernel_name, t, s, [F.col(side + "h" + a) for a in axes(dim)])
    return met.select("tgt_id", "src_id", w.alias("w"), *[(a - b).alias("d" + x) for a, b, x in zip(t, s, axes(dim), strict=True)], *[F.col("s_" + c).alias(c) for c in many])


def _mass(pairs: DataFrame):
    return F.col("w") * F.col("_many") if "_many" in pairs.columns else F.col("w")


def density(pairs: DataFrame, source: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Kernel density: sum(w v)."""
    met = pairs.join(source.select(F.col("id").alias("src_id"), *fields), "src_id")
    return met.groupBy(F.col("tgt_id").alias("id")).agg(*[F.sum(F.col("w") * F.col(f)).alias(f) for f in fields])


def shepard_estimate(pairs: DataFrame, source: DataFrame, targets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """sum(w v) / sum(w) per target in one aggregation; 0.0 without neighbours or weight."""
    met = pairs.join(source.select(F.col("id").alias("src_id"), *fields), "src_id")
    whole = F.sum(_mass(pairs))
    got = met.groupBy(F.col("tgt_id").alias("id")).agg(*[F.when(whole != 0, F.sum(F.col("w") * F.col(f)) / F.when(whole != 0, whole)).alias(f) for f in fields])
    return targets.select("id").join(got, "id", "left").fillna(0.0, subset=list(fields))


def local_regression(pairs: DataFrame, dim: int, basis_name: str = "unitary", operator: DataFrame | None = None) -> DataFrame:
    """(tgt_id, src_id, weights): for each basis term, the weight that estimates it (value, gradient, Hessian terms).

    One moment aggregation per target, one small solve per target, then a row's weights are w times the inverse moment
    matrix times the row's basis about the target.  Targets with fewer neighbours than basis terms get zero weights.
    ``operator`` (tgt_id, op array<array<double>>) maps the terms to those of an integral operator.
    """
    n = basis_size(basis_name, dim)
    d = [-F.col("d" + a) for a in axes(dim)]  # source minus target
    b = basis(basis_name, d)
    terms = [F.sum(_mass(pairs) * b[i] * b[j]).alias(f"_m{i}_{j}") for i in range(n) for j in range(i, n)]
    sums = pairs.groupBy("tgt_id").agg((F.sum("_many") if "_many" in pairs.columns else F.count("*")).alias("_k"), *terms)
    flat = sums.select("tgt_id", "_k", F.array(*[f"_m{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n)]).alias("_m"))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            m = batch.column("_m").flatten().to_numpy().reshape(rows, n, n)
            good = (batch.column("_k").to_numpy() >= n) & np.isfinite(m).all((1, 2))
            m = np.where(good[:, None, None], m, 0.0)
            scale = 1 / np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 1e-300))  # equilibrated, so small supports stay well posed
            scale = np.where(good[:, None], scale, 0.0)[:, :, None] * scale[:, None, :]
            out = (np.linalg.pinv(m * scale, rcond=1e-13, hermitian=True) * scale).reshape(rows, n * n) if rows else m.reshape(0, n * n)
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(n * n))
            yield pa.RecordBatch.from_arrays([batch.column("tgt_id"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["tgt_id", "_inv"])

    met = pairs.join(flat.mapInArrow(invert, "tgt_id long, _inv array<double>"), "tgt_id")
    rows = [sum((F.element_at("_inv", i * n + j + 1) * b[j] for j in range(n)), F.lit(0.0)) * F.col("w") for i in range(n)]
    out = met.select("tgt_id", "src_id", F.array(*rows).alias("weights"))
    if operator is None:
        return out
    applied = F.transform("op", lambda row: F.aggregate(F.zip_with(row, F.col("weights"), lambda a, c: a * c), F.lit(0.0), lambda s, x: s + x))
    return out.join(operator, "tgt_id").select("tgt_id", "src_id", applied.alias("weights"))


def estimate(weights: DataFrame, source: DataFrame, targets: DataFrame, fields: Sequence[str], derivative: int = 0) -> DataFrame:
    """sum(v * weights[derivative]) per target; 0.0 without neighbours."""
    met = weights.join(source.select(F.col("id").alias("src_id"), *fields), "src_id")
    got = met.groupBy(F.col("tgt_id").alias("id")).agg(*[F.sum(F.col(f) * F.element_at("weights", derivative + 1)).alias(f) for f in fields])
    return targets.select("id").join(got, "id", "left").fillna(0.0, subset=list(fields))


def neighbour_statistics(counts: DataFrame) -> DataFrame:
    """Of (tgt_id, n), as ``search.point_counts`` gives them."""
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def same_part(pairs: DataFrame, source: DataFrame, target: DataFrame, part: str, dim: int, tolerance: float) -> DataFrame:
    """Faceted scatter with a part field: a target takes the field of the last source (largest id) whose support holds
    it, else 0.0; pairs stay whose source field is nearer to it than the tolerance."""
    inside = pairs.withColumn("_step", faceted_weight("step", [F.col("s_" + a) for a in axes(dim)], [F.col("t_" + a) for a in axes(dim)], F.col("s_facets")))
    held = inside.join(source.select(F.col("id").alias("src_id"), F.col(part).alias("_p")), "src_id")
    of = held.where(F.col("_step") > 0).groupBy("tgt_id").agg(F.max_by("_p", "src_id").alias("_own"))
    return held.join(of, "tgt_id", "left").where(F.abs(F.col("_p") - F.coalesce("_own", F.lit(0.0))) < tolerance).drop("_p", "_own", "_step")


def facets_of_cells(cells: DataFrame, faces: DataFrame, dim: int, *, factor: float = 1.0, boundary_factor: float = 0.0) -> DataFrame:
    """id, centre, extents and ``facets`` ([outward unit normal..., h] a face) of cells for faceted supports.

    faces: id, n{x,y,z} outward unit normal, f{x,y,z} face centre, is_exterior.  h is factor times twice the distance
    from the cell centre to the face along the normal, with the boundary factor on exterior faces where it is positive;
    extents are twice the factor times the cell's box.
    """
    met = faces.join(cells.select("id", *["c" + a for a in axes(dim)]), "id")
    along = sum(((F.col("f" + a) - F.col("c" + a)) * F.col("n" + a) for a in axes(dim)), F.lit(0.0))
    f = F.when(F.col("is_exterior") & F.lit(boundary_factor > 0), F.lit(float(boundary_factor))).otherwise(F.lit(float(factor)))
    row = F.array(*[F.col("n" + a) for a in axes(dim)], f * 2 * along)
    facets = met.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("facets"))
    return cells.select("id", *[F.col("c" + a).alias(a) for a in axes(dim)], *[(factor * 2 * (F.col(a + "hi") - F.col(a + "lo"))).alias("h" + a) for a in axes(dim)]).join(facets, "id")


def box_faces(mesh: DataFrame, n: Sequence[int]) -> DataFrame:
    """Faces of a box mesh for ``facets_of_cells``."""
    dim, rows = len(n), []
    for d, a in enumerate(axes(dim)):
        for sign, e in ((-1.0, "lo"), (1.0, "hi")):
            normal = [F.lit(sign if k == d else 0.0).alias("n" + x) for k, x in enumerate(axes(dim))]
            middle = [(F.col(x + e) if k == d else F.col("c" + x)).alias("f" + x) for k, x in enumerate(axes(dim))]
            rows.append(F.struct(*normal, *middle, (F.col("i" + a) == (0 if sign < 0 else n[d] - 1)).alias("is_exterior")))
    return mesh.select("id", F.explode(F.array(*rows)).alias("f")).select("id", "f.*")


def polygon_faces(mesh: DataFrame) -> DataFrame:
    """Faces of a polygon mesh (of ``topology.polygon_cells``) for ``facets_of_cells``: each inner face once a side."""
    f = topology.faces(mesh).withColumn("is_exterior", F.col("right").isNull())
    side = lambda cell, sign: F.struct(F.col(cell).alias("id"), (sign * F.col("nx")).alias("nx"), (sign * F.col("ny")).alias("ny"))
    both = F.when(F.col("is_exterior"), F.array(side("left", 1.0))).otherwise(F.array(side("left", 1.0), side("right", -1.0)))
    return f.select(F.col("x").alias("fx"), F.col("y").alias("fy"), "is_exterior", F.explode(both).alias("s")).select("s.*", "fx", "fy", "is_exterior")


def scale_facets_at_jumps(particles: DataFrame, neighbours: DataFrame, field: str, tolerance: float, factor: float) -> DataFrame:
    """Field-aware supports: h of the facet (by position) towards a neighbour whose field differs by more than the tolerance is scaled.

    neighbours: id, facet (1-based), nbr.
    """
    far = neighbours.join(particles.select("id", F.col(field).alias("_v")), "id").join(particles.select(F.col("id").alias("nbr"), F.col(field).alias("_nv")), "nbr")
    cut = far.where(F.abs(F.col("_v") - F.col("_nv")) > tolerance).groupBy("id").agg(F.collect_set("facet").alias("_cut"))
    last = lambda f: F.element_at(f, -1)
    scaled = F.transform("facets", lambda f, i: F.when(F.array_contains(F.coalesce("_cut", F.array().cast("array<int>")), (i + 1).cast("int")), F.concat(F.slice(f, 1, F.size(f) - 1), F.array(last(f) * factor))).otherwise(f))
    return particles.join(cut, "id", "left").withColumn("facets", scaled).drop("_cut")


# ---- operators over polytopes ----

#: Shape by number of vertices and dimension.
SHAPES = {(2, 1): "interval", (3, 2): "triangle", (4, 2): "quadrilateral", (4, 3): "tetrahedron", (6, 3): "wedge", (8, 3): "hexahedron"}


def shape_of(vertices: int, dim: int) -> str:
    if (vertices, dim) not in SHAPES:
        raise ValueError(f"no integration domain of {vertices} vertices in {dim} dimensions")
    return SHAPES[vertices, dim]


def _simplices(points: np.ndarray) -> list[np.ndarray]:
    k, dim = points.shape
    cells = {
        "interval": [(0, 1)], "triangle": [(0, 1, 2)], "quadrilateral": [(0, 1, 2), (0, 2, 3)], "tetrahedron": [(0, 1, 2, 3)],
        "wedge": [(0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)], "hexahedron": [(0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6)],
    }[shape_of(k, dim)]
    return [points[list(c)] for c in cells]


def volume_integral(points: np.ndarray, basis_name: str) -> np.ndarray:
    """Integrals of the basis (about the origin) over a polytope, exact for its quadratics.

    Over a simplex, int x_i x_j = V (sum of vertices' outer products + outer product of their sums) / ((d+1)(d+2)).
    """
    dim = points.shape[1]
    if basis_name == "quadratic" and len(points) in (6, 8):
        raise ValueError("quadratic integrals cover simplices and quadrilaterals only")
    total = np.zeros(basis_size(basis_name, dim))
    for s in _simplices(points):
        volume = abs(np.linalg.det(s[1:] - s[0])) / [1, 1, 2, 6][dim]
        mean = s.mean(0)
        out = [volume]
        if basis_name != "unitary":
            out += list(volume * mean)
        if basis_name == "quadratic":
            second = volume * (s.T @ s + np.outer(s.sum(0), s.sum(0))) / ((dim + 1) * (dim + 2))
            out += [second[i, j] * (0.5 if i == j else 1.0) for i in range(dim) for j in range(i, dim)]
        total += np.array(out)
    return total


def integral_operator(domains: DataFrame, dim: int, basis_name: str) -> DataFrame:
    """(tgt_id, op): one row of the integrals of the basis about the target, from ``vertices`` array<array<double>> and its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            op = [[volume_integral(np.array(r["vertices"]) - np.array([r[a] for a in axes(dim)]), basis_name).tolist()] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(op, pa.list_(pa.list_(pa.float64())))], ["tgt_id", "op"])

    return domains.select("id", *axes(dim), "vertices").mapInArrow(run, "tgt_id long, op array<array<double>>")


def jet(basis_name: str, dim: int) -> list[list[tuple[int, tuple[int, ...]]]]:
    """Exponents: for each basis term and each derivative (in basis order) the (coefficient, powers) that is left."""
    powers = [tuple(0 for _ in range(dim))]
    if basis_name != "unitary":
        powers += [tuple(int(i == k) for i in range(dim)) for k in range(dim)]
    if basis_name == "quadratic":
        powers += [tuple(int(i == a) + int(i == b) for i in range(dim)) for a in range(dim) for b in range(a, dim)]
    out = []
    for p in powers:
        scale = 0.5 if max(p, default=0) == 2 else 1.0
        row = []
        for d in powers:
            left, c = [], scale
            for e, k in zip(p, d, strict=True):
                for s in range(k):
                    c *= e - s
                left.append(max(e - k, 0))
            row.append((c, tuple(left)))
        out.append(row)
    return out


def jet_at(basis_name: str, x: Sequence[float]) -> np.ndarray:
    """Matrix of the basis terms (rows) and their derivatives (columns) at a point."""
    return np.array([[c * np.prod([v**e for v, e in zip(x, left, strict=True)]) for c, left in row] for row in jet(basis_name, len(x))])


def inverse_jet_at(basis_name: str, x: Sequence[float]) -> np.ndarray:
    return jet_at(basis_name, [-v for v in x])


def transfer(basis_name: str, c: Sequence[float]) -> np.ndarray:
    """T with basis(x) = T basis(x - c)."""
    return jet_at(basis_name, c)

