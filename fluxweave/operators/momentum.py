"""Conservative momentum remap: cell-centred (CCH) and staggered (SGH), on box meshes (whose corners are quarters or eighths
of their cells) and on polygon meshes (whose corners come from their topology), with one material or many.

With materials a row is a (cell, material) pair: each has its own density, and moves with its cell's velocity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..plans.storage import materialize
from ..sources import topology
from . import materials
from .gradient import gradients
from .intersect import intersect
from .interpolate import second_order


def _specific(dim: int) -> list[str]:
    return ["density", *["momentum_" + a for a in axes(dim)]]


def remap_cch(source: DataFrame, target: DataFrame, adjacency: DataFrame, dim: int, *, limiter: str = "barth_jespersen") -> DataFrame:
    """source: cells with mass and u{x,y,z}; returns id, density, mass, u.. on the target."""
    s = source.withColumn("density", F.col("mass") / F.col("vol")).withColumns({"momentum_" + a: F.col("mass") * F.col("u" + a) / F.col("vol") for a in axes(dim)})
    fields = _specific(dim)
    out = second_order(intersect(target, s, dim), s, gradients(s, adjacency, fields, dim, limiter=limiter), target, fields, dim)
    out = out.join(target.select("id", "vol"), "id").withColumn("mass", F.col("density") * F.col("vol"))
    return out.select("id", "density", "mass", *[F.when(F.col("density") != 0, F.col("momentum_" + a) / F.when(F.col("density") != 0, F.col("density"))).otherwise(0.0).alias("u" + a) for a in axes(dim)])


def box_corners(mesh: DataFrame, n: Sequence[int]) -> DataFrame:
    """Corners of a box mesh: id (cell), node, vol, x.. (centroid): the part of the cell next to each of its nodes."""
    dim, corners = len(n), [()]
    for _ in range(dim):
        corners = [(*c, k) for c in corners for k in (0, 1)]
    rows = []
    for c in corners:
        node, stride, middle = F.lit(0).cast("long"), 1, []
        for a, k, m in zip(axes(dim), c, n, strict=True):
            node = node + (F.col("i" + a) + k) * stride
            stride *= m + 1
            middle.append(((F.col("c" + a) + F.col(a + ("hi" if k else "lo"))) / 2).alias(a))
        rows.append(F.struct(node.alias("node"), (F.col("vol") / 2**dim).alias("vol"), *middle))
    return mesh.select("id", F.explode(F.array(*rows)).alias("c")).select("id", "c.*")


def polygon_corners(mesh: DataFrame) -> DataFrame:
    """Corners of a polygon mesh (``ring`` and ``nodes``), as ``box_corners`` gives them."""
    return topology.corners(mesh).select(F.col("cell").alias("id"), "node", "vol", F.col("cx").alias("x"), F.col("cy").alias("y"))


def remap_sgh(source: DataFrame, corner_mass: DataFrame, node_velocity: DataFrame, target: DataFrame, source_adjacency: DataFrame, target_adjacency: DataFrame,
              target_corners: DataFrame, dim: int, *, limiter: str = "barth_jespersen") -> DataFrame:
    """corner_mass: id (cell), node, mass; node_velocity: node, u..; returns node, mass, u.. on the target's nodes."""
    met = corner_mass.join(node_velocity, "node").groupBy("id").agg(F.sum("mass").alias("_m"), *[F.sum(F.col("mass") * F.col("u" + a)).alias("_p" + a) for a in axes(dim)])
    s = source.join(met, "id").withColumn("density", F.col("_m") / F.col("vol")).withColumns({"momentum_" + a: F.col("_p" + a) / F.col("vol") for a in axes(dim)})
    fields = _specific(dim)
    cells = second_order(intersect(target, s, dim), s, gradients(s, source_adjacency, fields, dim, limiter=limiter), target, fields, dim)
    t = materialize(target.join(cells, "id"))  # its own stencils read it several times
    slopes = gradients(t, target_adjacency, fields, dim, limiter=limiter)
    each = target_corners.join(t.select("id", *fields, *["c" + a for a in axes(dim)]), "id").join(slopes, "id")
    at = {}
    for f in fields:
        v = F.col(f)
        for a in axes(dim):
            v = v + F.col(f"g_{f}_{a}") * (F.col(a) - F.col("c" + a))
        at[f] = F.sum(F.col("vol") * v)
    sums = each.groupBy("node").agg(*[v.alias(f) for f, v in at.items()])
    return sums.select("node", F.col("density").alias("mass"), *[(F.col("momentum_" + a) / F.col("density")).alias("u" + a) for a in axes(dim)])


def _velocity(dim: int) -> list:
    """u.. of sums of mass and momentum; nothing moves where there is no mass."""
    return [F.when(F.col("mass") != 0, F.col("momentum_" + a) / F.when(F.col("mass") != 0, F.col("mass"))).otherwise(0.0).alias("u" + a) for a in axes(dim)]


def _material_slopes(values: DataFrame, adjacency: DataFrame | None, fields: list[str], dim: int, limiter: str) -> DataFrame | None:
    return None if adjacency is None else gradients(values, adjacency, fields, dim, limiter=limiter, material="mat").fillna(0.0)


def remap_cch_materials(values: DataFrame, pieces: DataFrame, target: DataFrame, dim: int, *, adjacency: DataFrame | None = None, limiter: str = "nolimiter") -> tuple[DataFrame, DataFrame]:
    """values: (id, mat, density, u.., c..), density by the material's own volume; pieces: where the materials are.

    Returns (id, mat, volfrac, c.., density, mass, u..) of the target's materials and (id, mass, u..) of its cells, whose
    velocity is the one that keeps the momentum of all materials.  Second order with an adjacency.
    """
    fields = _specific(dim)
    s = values.withColumns({"momentum_" + a: F.col("density") * F.col("u" + a) for a in axes(dim)})
    got = materials.remap_materials(materials.material_weights(target, pieces, dim), s, target, fields, dim, slopes=_material_slopes(s, adjacency, fields, dim, limiter))
    part = F.col("volfrac") * F.col("vol")
    each = got.join(target.select("id", "vol"), "id").withColumns({"mass": F.col("density") * part, **{"momentum_" + a: F.col("momentum_" + a) * part for a in axes(dim)}})
    cells = each.groupBy("id").agg(*[F.sum(c).alias(c) for c in ["mass", *fields[1:]]])
    return each.select("id", "mat", "volfrac", *["c" + a for a in axes(dim)], "density", "mass", *_velocity(dim)), cells.select("id", "mass", *_velocity(dim))


def remap_sgh_materials(corner_mass: DataFrame, node_velocity: DataFrame, values: DataFrame, pieces: DataFrame, target: DataFrame, *, adjacency: DataFrame | None = None,
                        limiter: str = "nolimiter") -> tuple[DataFrame, DataFrame]:
    """Staggered momentum of materials between polygon meshes.

    corner_mass: (id, node, mat, mass); node_velocity: (node, u..); values: (id, mat, volume, c..) of the materials in the
    source's cells.  Returns the target's corners (cell, node, mat, volume, c.., mass, momentum_..) and its nodes
    (node, mass, u..).

    Material pieces meet the target's corners themselves, so a corner's mass and centroid are those of what lies in it, and
    a node gathers its corners.  Both totals are kept exactly, since corners cover their cells.
    """
    dim, fields = 2, _specific(2)
    met = corner_mass.join(node_velocity, "node").groupBy("id", "mat").agg(F.sum("mass").alias("_m"), *[F.sum(F.col("mass") * F.col("u" + a)).alias("_p" + a) for a in axes(dim)])
    s = values.join(met, ["id", "mat"]).withColumn("density", F.col("_m") / F.col("volume")).withColumns({"momentum_" + a: F.col("_p" + a) / F.col("volume") for a in axes(dim)})
    into = topology.corner_mesh(target)
    got = materials.remap_materials(materials.material_weights(into, pieces, dim), s, into, fields, dim, slopes=_material_slopes(s, adjacency, fields, dim, limiter))
    volume = F.col("volfrac") * F.col("vol")
    corners = got.join(into.select("id", "vol"), "id").select("id.cell", "id.node", "mat", volume.alias("volume"), *["c" + a for a in axes(dim)], (F.col("density") * volume).alias("mass"), *[(F.col(f) * volume).alias(f) for f in fields[1:]])
    nodes = corners.groupBy("node").agg(*[F.sum(c).alias(c) for c in ["mass", *fields[1:]]])
    return corners, nodes.select("node", "mass", *_velocity(dim))
