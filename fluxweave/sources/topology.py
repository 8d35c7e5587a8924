"""Polygon meshes given by tables of nodes and cells: sides, faces, corners, wedges, dual cells and adjacencies.

A mesh is two tables, ``nodes`` (id, x, y) and ``cells`` (id, nodes array<long>, counter-clockwise).  One join brings the
coordinates to the cells; all that follows is an expression over a cell's own arrays, or one aggregation on a node or a
face.  Nothing assumes a numbering or a shape.

A side is an edge of a cell; its two wedges are the triangles (end, middle of the edge, centroid).  A corner is the two
wedges of a cell at one of its nodes, and the dual cell of a node is the union of the corners around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_moments
from ..plans.storage import materialize
from .meshes import polygon_mesh


def polygon_cells(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with their ring, bounds, volume and centroid (columns of both tables' own stay on ``cells``)."""
    at = cells.select("id", F.posexplode("nodes").alias("k", "node")).join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    held = F.array_sort(F.collect_list(F.struct("k", "x", "y")))  # a cell's nodes
    rings = at.groupBy("id").agg(F.transform(held, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return polygon_mesh(cells.join(rings, "id"))


def sides(mesh: DataFrame) -> DataFrame:
    """(id, k, a, b, ax, ay, bx, by, cx, cy): the edges of each cell from node ``a`` to node ``b``."""
    n = F.size("ring")
    each = mesh.select("id", "cx", "cy", "nodes", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    after = F.pmod(F.col("k") + 1, F.size("ring"))
    point = lambda k: F.element_at("ring", (k + 1).cast("int"))
    node = lambda k: F.element_at("nodes", (k + 1).cast("int"))
    return each.select("id", "k", node(F.col("k")).alias("a"), node(after).alias("b"), point(F.col("k"))["x"].alias("ax"), point(F.col("k"))["y"].alias("ay"), point(after)["x"].alias("bx"), point(after)["y"].alias("by"), "cx", "cy")


def faces(mesh: DataFrame) -> DataFrame:
    """(lo, hi, left, right, x, y, nx, ny, length): a face by its nodes; ``left`` sees them in that order, ``right`` (null at
    the boundary) the other way; (nx, ny) is the unit normal out of ``left``, or of the only cell."""
    ahead = F.col("a") < F.col("b")
    pick = lambda p, q: F.when(ahead, F.col(p)).otherwise(F.col(q))
    ends = sides(mesh).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), ahead.alias("ahead"), "id", *[pick(p, q).alias(n) for p, q, n in (("ax", "bx", "lx"), ("ay", "by", "ly"), ("bx", "ax", "hx"), ("by", "ay", "hy"))])
    met = ends.groupBy("lo", "hi").agg(F.max(F.when(F.col("ahead"), F.col("id"))).alias("first"), F.max(F.when(~F.col("ahead"), F.col("id"))).alias("second"), *[F.first(c).alias(c) for c in ("lx", "ly", "hx", "hy")])
    length = F.sqrt(F.pow(F.col("hx") - F.col("lx"), 2.0) + F.pow(F.col("hy") - F.col("ly"), 2.0))
    sign = F.when(F.col("first").isNull(), -1.0).otherwise(1.0)
    out = met.withColumn("length", length)
    return out.select("lo", "hi", F.coalesce("first", "second").alias("left"), F.when(F.col("first").isNotNull(), F.col("second")).alias("right"), ((F.col("lx") + F.col("hx")) / 2).alias("x"), ((F.col("ly") + F.col("hy")) / 2).alias("y"),
                      (sign * (F.col("hy") - F.col("ly")) / F.col("length")).alias("nx"), (sign * (F.col("lx") - F.col("hx")) / F.col("length")).alias("ny"), "length")


def _triangle(*points: tuple[str | Column, str | Column]) -> Column:
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.array(*[F.struct(of(x).alias("x"), of(y).alias("y")) for x, y in points])


def wedges(mesh: DataFrame) -> DataFrame:
    """(cell, k, node, ring, vol, mx, my): both triangles of each side, with their first moments."""
    middle, centroid = ((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2), ("cx", "cy")
    both = F.array(F.struct(F.col("a").alias("node"), _triangle(("ax", "ay"), middle, centroid).alias("ring")), F.struct(F.col("b").alias("node"), _triangle(middle, ("bx", "by"), centroid).alias("ring")))
    each = sides(mesh).select(F.col("id").alias("cell"), "k", F.explode(both).alias("w")).select("cell", "k", "w.node", "w.ring")
    return each.withColumn("_m", polygon_moments(F.col("ring"))).select("cell", "k", "node", "ring", F.col("_m.m0").alias("vol"), F.col("_m.m1x").alias("mx"), F.col("_m.m1y").alias("my"))


def corners(mesh: DataFrame) -> DataFrame:
    """(cell, node, vol, cx, cy, ring): the share of each cell that belongs to each of its nodes.  No shuffle: a corner is in
    its cell's row."""
    n = F.size("ring")
    each = mesh.select(F.col("id").alias("cell"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), "nodes", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    p = lambda d: F.element_at("ring", (F.pmod(F.col("k") + d, F.size("ring")) + 1).cast("int"))
    half = lambda c, d: (p(0)[c] + p(d)[c]) / 2
    ring = _triangle((p(0)["x"], p(0)["y"]), (half("x", 1), half("y", 1)), ("_x", "_y"), (half("x", -1), half("y", -1)))
    out = each.select("cell", F.element_at("nodes", (F.col("k") + 1).cast("int")).alias("node"), polygon_moments(ring).alias("_m"), ring.alias("ring"))
    return out.select("cell", "node", F.col("_m.m0").alias("vol"), (F.col("_m.m1x") / F.col("_m.m0")).alias("cx"), (F.col("_m.m1y") / F.col("_m.m0")).alias("cy"), "ring")


def corner_mesh(mesh: DataFrame) -> DataFrame:
    """The corners as a polygon mesh of their own; a corner's id is a struct of its cell and its node."""
    return polygon_mesh(corners(mesh).select(F.struct("cell", "node").alias("id"), "ring"))


def dual_cells(mesh: DataFrame) -> DataFrame:
    """The cells around the nodes, as a polygon mesh: id (of the node), ring, px, py (the node), is_boundary, volume,
    centroid, bounds.

    One aggregation on the node: corners sorted by the direction of their leaving edge follow each other round the node.
    Each adds the middle of that edge and its cell's centroid; where an edge has no cell on its other side, the node
    itself comes in between.  The result is written once, since every stage of a remap reads it.
    """
    s = sides(mesh)
    out = s.select(F.col("a").alias("node"), "id", F.col("ax").alias("px"), F.col("ay").alias("py"), F.struct(F.col("b").alias("next"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("turn"), F.col("cx").alias("u"), F.col("cy").alias("v")).alias("leaving"), F.lit(None).alias("arriving"))
    into = s.select(F.col("b").alias("node"), "id", F.col("bx").alias("px"), F.col("by").alias("py"), F.lit(None).alias("leaving"), F.struct(F.col("a").alias("prev"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")).alias("arriving"))
    ends = out.unionByName(into)
    one = ends.groupBy("node", "id").agg(F.first("px").alias("px"), F.first("py").alias("py"), F.max("leaving").alias("l"), F.max("arriving").alias("r"))
    corner = F.struct(F.col("l.turn").alias("turn"), F.col("l.next").alias("next"), F.col("r.prev").alias("prev"), F.col("l.x").alias("x"), F.col("l.y").alias("y"), F.col("l.u").alias("u"), F.col("l.v").alias("v"), F.col("r.x").alias("rx"), F.col("r.y").alias("ry"))
    around = one.groupBy(F.col("node").alias("id")).agg(F.first("px").alias("px"), F.first("py").alias("py"), F.array_sort(F.collect_list(corner)).alias("c"))
    around = around.withColumns({"nexts": F.transform("c", lambda c: c["next"]), "prevs": F.transform("c", lambda c: c["prev"])})
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    node = F.array(point(F.col("px"), F.col("py")))
    part = lambda c: F.concat(F.when(F.array_contains(F.col("prevs"), c["next"]), none).otherwise(node), F.array(point(c["x"], c["y"]), point(c["u"], c["v"])), F.when(F.array_contains(F.col("nexts"), c["prev"]), none).otherwise(F.array(point(c["rx"], c["ry"]))))
    ring = F.flatten(F.transform("c", part))
    edge = F.size(F.array_except("nexts", "prevs")) > 0
    return polygon_mesh(materialize(around.select("id", "px", "py", edge.alias("is_boundary"), ring.alias("ring"))))


def node_neighbours(mesh: DataFrame) -> DataFrame:
    """(id, nbr) of nodes that share a cell: pairs within each cell's own list."""
    pairs = mesh.select(F.explode("nodes").alias("id"), "nodes").select("id", F.explode("nodes").alias("nbr"))
    return pairs.where("id <> nbr").distinct()


def cell_neighbours(mesh: DataFrame, kind: str = "node") -> DataFrame:
    """(id, nbr) of cells that share a node, or a face.  Cells round a node are a bounded list, from one aggregation."""
    if kind == "face":
        inner = faces(mesh).where("right is not null")
        return inner.select(F.col("left").alias("id"), F.col("right").alias("nbr")).unionByName(inner.select(F.col("right").alias("id"), F.col("left").alias("nbr"))).distinct()
    round_node = mesh.select("id", F.explode("nodes").alias("node")).groupBy("node").agg(F.collect_set("id").alias("cells"))
    return round_node.select(F.explode("cells").alias("id"), "cells").select("id", F.explode("cells").alias("nbr")).where("id <> nbr").distinct()


def boundary_cells(mesh: DataFrame) -> DataFrame:
    """``mesh`` with is_boundary: whether a cell has a face of its own alone."""
    edge = faces(mesh).where("right is null").select(F.col("left").alias("id")).distinct().withColumn("_edge", F.lit(True))
    return mesh.drop("is_boundary").join(edge, "id", "left").withColumn("is_boundary", F.coalesce("_edge", F.lit(False))).drop("_edge")
