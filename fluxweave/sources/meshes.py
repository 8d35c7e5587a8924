"""Mesh sources: generated boxes, direct products, dual cells, adjacency, fields, moved meshes and stored meshes.

A box mesh is one row a cell: id, {x,y,z}lo/hi, vol, c{x,y,z}, is_boundary.  Ids count along x first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, axes, moments


def _index(dim: int, n: Sequence[int]) -> list[Column]:
    out, rest = [], F.col("id")
    for d in range(dim):
        out.append(F.pmod(rest, F.lit(n[d])) if d < dim - 1 else rest)
        rest = F.floor(rest / n[d]).cast("long")
    return out


def _finish(df: DataFrame, dim: int, n: Sequence[int], system: str) -> DataFrame:
    lo, hi = [F.col(a + "lo") for a in axes(dim)], [F.col(a + "hi") for a in axes(dim)]
    m0, m1 = moments(lo, hi, system)
    edge = F.lit(False)
    for a, k in zip(AXES, n, strict=False):
        edge = edge | (F.col("i" + a) == 0) | (F.col("i" + a) == k - 1)
    df = df.withColumn("vol", m0).withColumns({"c" + a: m / F.col("vol") for a, m in zip(axes(dim), m1, strict=True)})
    return df.withColumn("is_boundary", edge)


def box_mesh(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], n: Sequence[int], system: str = "cartesian") -> DataFrame:
    """A uniform mesh of prod(n) boxes."""
    dim, total = len(n), 1
    for k in n:
        total *= k
    df = spark.range(total).withColumns({"i" + a: i for a, i in zip(axes(dim), _index(dim, n), strict=True)})
    bounds = {}
    for d, a in enumerate(axes(dim)):
        width = hi[d] - lo[d]
        bounds[a + "lo"] = F.lit(float(lo[d])) + F.col("i" + a) * F.lit(float(width)) / F.lit(n[d])
        bounds[a + "hi"] = F.lit(float(lo[d])) + (F.col("i" + a) + 1) * F.lit(float(width)) / F.lit(n[d])
    return _finish(df.withColumns(bounds), dim, n, system)


def direct_product_mesh(spark: SparkSession, points: Sequence[Sequence[float]], system: str = "cartesian") -> DataFrame:
    """Cells between the sorted points of each axis."""
    dim, n, total = len(points), [len(p) - 1 for p in points], 1
    for k in n:
        total *= k
    df = spark.range(total).withColumns({"i" + a: i for a, i in zip(axes(dim), _index(dim, n), strict=True)})
    bounds = {}
    for a, p in zip(axes(dim), points, strict=True):
        held = F.array(*[F.lit(float(v)) for v in p])
        bounds[a + "lo"] = F.element_at(held, (F.col("i" + a) + 1).cast("int"))
        bounds[a + "hi"] = F.element_at(held, (F.col("i" + a) + 2).cast("int"))
    return _finish(df.withColumns(bounds), dim, n, system)


def node_mesh(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], n: Sequence[int]) -> DataFrame:
    """Dual cells of the nodes of a uniform box mesh: half cells at the boundary. px, py, pz are the nodes themselves."""
    dim, total = len(n), 1
    for k in n:
        total *= k + 1
    df = spark.range(total).withColumns({"i" + a: i for a, i in zip(axes(dim), _index(dim, [k + 1 for k in n]), strict=True)})
    out = {}
    for d, a in enumerate(axes(dim)):
        step = (hi[d] - lo[d]) / n[d]
        node = F.lit(float(lo[d])) + F.col("i" + a) * F.lit(float(step))
        out |= {"p" + a: node, a + "lo": F.greatest(node - step / 2, F.lit(float(lo[d]))), a + "hi": F.least(node + step / 2, F.lit(float(hi[d])))}
    return _finish(df.withColumns(out), dim, [k + 1 for k in n], "cartesian")


def box_adjacency(mesh: DataFrame, n: Sequence[int], kind: str = "node") -> DataFrame:
    """(id, nbr) of a logically rectangular mesh: cells that share a node, or a face. No join: neighbours follow from the indices."""
    dim = len(n)
    steps = [()]
    for _ in range(dim):
        steps = [(*s, k) for s in steps for k in (-1, 0, 1)]
    steps = [s for s in steps if any(s) and (kind == "node" or sum(map(abs, s)) == 1)]
    moved = mesh.select("id", *["i" + a for a in axes(dim)], F.explode(F.array(*[F.struct(*[F.lit(k).alias("d" + a) for a, k in zip(axes(dim), s, strict=True)]) for s in steps])).alias("s"))
    inside, nbr, stride = F.lit(True), F.lit(0).cast("long"), 1
    for d, a in enumerate(axes(dim)):
        j = F.col("i" + a) + F.col("s.d" + a)
        inside = inside & (j >= 0) & (j < n[d])
        nbr = nbr + j * stride
        stride *= n[d]
    return moved.where(inside).select("id", nbr.alias("nbr"))


def shared_adjacency(cell_parts: DataFrame) -> DataFrame:
    """(id, nbr) of any mesh from (id, part): cells that share a node or a face id."""
    a, b = cell_parts.select("id", "part"), cell_parts.select(F.col("id").alias("nbr"), "part")
    return a.join(b, "part").where("id <> nbr").select("id", "nbr").distinct()


def box_rings(mesh: DataFrame) -> DataFrame:
    """2-D boxes with a counter-clockwise ring."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return mesh.withColumn("ring", F.array(corner("xlo", "ylo"), corner("xhi", "ylo"), corner("xhi", "yhi"), corner("xlo", "yhi")))


def box_solids(mesh: DataFrame) -> DataFrame:
    """3-D boxes with their ``points`` (x fastest) and outward ``facets``."""
    from ..operators.intersect import BOX_FACETS

    corner = lambda a, b, c: F.struct(F.col("x" + a).alias("x"), F.col("y" + b).alias("y"), F.col("z" + c).alias("z"))
    points = F.array(*[corner(a, b, c) for c in ("lo", "hi") for b in ("lo", "hi") for a in ("lo", "hi")])
    return mesh.withColumns({"points": points, "facets": F.array(*[F.array(*[F.lit(k) for k in f]) for f in BOX_FACETS])})


def mapped_solids(mesh: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Polyhedra under a linear map: points, bounds, volume and centroid follow it."""
    row = lambda k, of: sum((F.lit(float(m)) * of(a) for m, a in zip(matrix[k], AXES, strict=True)), F.lit(0.0))
    points = F.transform("points", lambda p: F.struct(*[row(k, lambda a: p[a]).alias(x) for k, x in enumerate(AXES)]))
    a, b, c = matrix
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    centroid = {"c" + x: row(k, lambda s: F.col("c" + s)) for k, x in enumerate(AXES)}
    out = mesh.withColumns({"points": points, "vol": F.col("vol") * abs(det), **centroid})
    of = lambda x: F.transform("points", lambda p: p[x])
    return out.withColumns({x + e: f(of(x)) for x in AXES for e, f in (("lo", F.array_min), ("hi", F.array_max))})


def polygon_mesh(cells: DataFrame) -> DataFrame:
    """id and ring (counter-clockwise array<struct<x, y>>) with box bounds, volume and centroid."""
    from ..functions.geometry import polygon_moments

    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    df = cells.withColumns({"xlo": F.array_min(xs), "xhi": F.array_max(xs), "ylo": F.array_min(ys), "yhi": F.array_max(ys)})
    df = df.withColumn("_m", polygon_moments(F.col("ring")))
    return df.withColumns({"vol": F.col("_m.m0"), "cx": F.col("_m.m1x") / F.col("_m.m0"), "cy": F.col("_m.m1y") / F.col("_m.m0")}).drop("_m")


def translate(expression: str) -> str:
    """An analytic formula as Spark SQL: ``if (c) a; else b;`` becomes CASE WHEN, ^ becomes pow, && and || become AND and OR."""
    s = expression.strip().rstrip(";").strip()
    m = re.match(r"(?s)if\s*\(", s)
    if m:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(s[i], 0)
            i += 1
        condition, rest = s[m.end() : i - 1], s[i:].strip()
        parts = re.split(r"(?s);\s*else\b|\belse\b", rest, maxsplit=1)
        then, other = (p.strip().strip("{}").strip().rstrip(";") for p in parts) if len(parts) == 2 else (rest, "0.0")
        return f"CASE WHEN {translate(condition)} THEN {translate(then)} ELSE {translate(other)} END"
    s = s.replace("&&", " AND ").replace("||", " OR ")
    while (m := re.search(r"([A-Za-z_][\w.]*(?:\([^()]*\))?|[\d.]+|\([^()]*\))\s*\^\s*(-?[\w.]+|\([^()]*\))", s)) is not None:
        s = s[: m.start()] + f"pow({m[1]}, {m[2]})" + s[m.end() :]
    return s


def with_field(mesh: DataFrame, name: str, expression: str, dim: int, at: str = "c") -> DataFrame:
    """A field from a formula in x, y, z, at the centroids (``c``) or the nodes (``p``)."""
    sql = translate(expression)
    sql = re.sub(r"\b([xyz])\b", lambda m: f"{at}{m[1]}" if m[1] in axes(dim) else "0.0D", sql)
    return mesh.withColumn(name, F.expr(sql).cast("double"))


def move_nodes(nodes: DataFrame, shift: dict[str, Column], fixed: Column | None = None) -> DataFrame:
    """Nodes (x, y, z columns) moved by per-axis shifts; ``fixed`` nodes stay."""
    still = fixed if fixed is not None else F.lit(False)
    return nodes.withColumns({a: F.when(still, F.col(a)).otherwise(F.col(a) + s) for a, s in shift.items()})


def vortex(t: float, dt: float, period: float = 2.0) -> dict[str, Column]:
    """The single-vortex displacement of a step at time t: 2 sin(pi x)^2 sin(pi y) cos(pi y) and its counterpart, reversing over the period."""
    import math

    x, y, swing = F.col("x") * math.pi, F.col("y") * math.pi, math.cos(math.pi * t / period) * dt
    return {"x": -2 * F.sin(x) * F.sin(x) * F.sin(y) * F.cos(y) * swing, "y": 2 * F.sin(x) * F.cos(x) * F.sin(y) * F.sin(y) * swing}


def box_nodes(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], n: Sequence[int]) -> DataFrame:
    """Nodes of a uniform box mesh: id, indices and coordinates x, y, z."""
    df = node_mesh(spark, lo, hi, n)
    return df.select("id", *["i" + a for a in axes(len(n))], *[F.col("p" + a).alias(a) for a in axes(len(n))], "is_boundary")


def rings_from_nodes(nodes: DataFrame, n: Sequence[int]) -> DataFrame:
    """2-D quadrilaterals (id, ring) of a logically rectangular mesh from its (possibly moved) nodes, by one aggregation.

    Each node goes to the up to four cells around it with its place in their rings.
    """
    nx, ny = n
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate([(0, 0), (-1, 0), (-1, -1), (0, -1)])])
    each = nodes.withColumn("s", F.explode(corners)).withColumns({"cx": F.col("ix") + F.col("s.dx"), "cy": F.col("iy") + F.col("s.dy")})
    each = each.where((F.col("cx") >= 0) & (F.col("cx") < nx) & (F.col("cy") >= 0) & (F.col("cy") < ny))
    ring = F.array_sort(F.collect_list(F.struct(F.col("s.k").alias("k"), "x", "y")))
    return each.groupBy((F.col("cx") + F.col("cy") * nx).alias("id")).agg(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
