import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.operators import gradient, intersect
from fluxweave.plans.remap import Options, Remapper, remap
from fluxweave.sources import meshes, topology


def random_mesh(spark, n, seed, name="id"):
    """A grid of n x n with moved inner nodes; some cells are triangles, some pairs of cells are merged to hexagons, one of
    them not convex."""
    rng = random.Random(seed)
    at = lambda i, j: i + j * (n + 1)
    nodes = [(at(i, j), (i + (rng.uniform(-0.25, 0.25) if 0 < i < n and 0 < j < n else 0)) / n, (j + (rng.uniform(-0.25, 0.25) if 0 < i < n and 0 < j < n else 0)) / n) for j in range(n + 1) for i in range(n + 1)]
    cells, skip = [], set()
    for j in range(n):
        for i in range(n):
            if (i, j) in skip:
                continue
            kind = rng.random()
            if kind < 0.3:
                cells += [[at(i, j), at(i + 1, j), at(i + 1, j + 1)], [at(i, j), at(i + 1, j + 1), at(i, j + 1)]]
            elif kind < 0.6 and i + 1 < n:
                skip.add((i + 1, j))
                cells.append([at(i, j), at(i + 1, j), at(i + 2, j), at(i + 2, j + 1), at(i + 1, j + 1), at(i, j + 1)])
            else:
                cells.append([at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)])
    rng.shuffle(cells)
    return spark.createDataFrame(nodes, "id long, x double, y double"), spark.createDataFrame([(7 * k + 3, c) for k, c in enumerate(cells)], "id long, nodes array<long>")


@pytest.fixture(scope="module")
def mesh(spark):
    nodes, cells = random_mesh(spark, 6, 1)
    return nodes, topology.polygon_cells(nodes, cells).cache()


def test_parts_add_up(spark, mesh):
    nodes, m = mesh
    assert m.agg(F.sum("vol")).first()[0] == pytest.approx(1)
    w, c, d = topology.wedges(m), topology.corners(m), topology.dual_cells(m)
    for parts, key, whole in ((w, "cell", m), (c, "cell", m), (c, "node", d), (w, "node", d)):
        gap = parts.groupBy(F.col(key).alias("id")).agg(F.sum("vol").alias("v")).join(whole, "id", "full").agg(F.max(F.abs(F.col("v") - F.col("vol")))).first()[0]
        assert gap < 1e-14
    moments = c.groupBy(F.col("node").alias("id")).agg((F.sum(F.col("vol") * F.col("cx")) / F.sum("vol")).alias("x")).join(d, "id")
    assert moments.agg(F.max(F.abs(F.col("x") - F.col("cx")))).first()[0] < 1e-13
    assert d.count() == nodes.count() - nodes.join(m.select(F.explode("nodes").alias("id")), "id", "left_anti").count()


def test_faces(mesh):
    _, m = mesh
    f, s = topology.faces(m), topology.sides(m)
    assert f.where("right is null").agg(F.sum("length")).first()[0] == pytest.approx(4)
    assert 2 * f.count() - f.where("right is null").count() == s.count()
    # the divergence of (x, 0) and (0, y) over each cell is twice its volume
    out = f.select(F.col("left").alias("id"), ((F.col("x") * F.col("nx") + F.col("y") * F.col("ny")) * F.col("length")).alias("v"))
    back = f.where("right is not null").select(F.col("right").alias("id"), (-(F.col("x") * F.col("nx") + F.col("y") * F.col("ny")) * F.col("length")).alias("v"))
    gap = out.unionByName(back).groupBy("id").agg(F.sum("v").alias("v")).join(m, "id").agg(F.max(F.abs(F.col("v") - 2 * F.col("vol")))).first()[0]
    assert gap < 1e-13


def test_neighbours(mesh):
    _, m = mesh
    rows = {r.id: r.nodes for r in m.collect()}
    near = {(a, b) for a, x in rows.items() for b, y in rows.items() if a != b and set(x) & set(y)}
    edges = lambda ns: {frozenset((p, q)) for p, q in zip(ns, ns[1:] + ns[:1], strict=True)}
    beside = {(a, b) for a, x in rows.items() for b, y in rows.items() if a != b and edges(x) & edges(y)}
    together = {(p, q) for x in rows.values() for p in x for q in x if p != q}
    pairs = lambda df: sorted(tuple(r) for r in df.select("id", "nbr").collect())
    assert pairs(topology.cell_neighbours(m)) == sorted(near) and pairs(topology.cell_neighbours(m, "face")) == sorted(beside)
    assert pairs(topology.node_neighbours(m)) == sorted(together)
    edge = {r.id for r in topology.boundary_cells(m).where("is_boundary").collect()}
    count = {}
    for a, x in rows.items():
        for e in edges(x):
            count.setdefault(e, []).append(a)
    assert edge == {c[0] for c in count.values() if len(c) == 1}


def test_dual_of_a_grid_is_the_box_dual(spark):
    n = 4
    boxes = meshes.box_nodes(spark, [0, 0], [1, 1], [n, n])
    cells = spark.range(n * n).select("id", (F.col("id") % n + F.floor(F.col("id") / n) * (n + 1)).alias("low")).select("id", F.array(*[(F.col("low") + k).cast("long") for k in (0, 1, n + 2, n + 1)]).alias("nodes"))
    dual = topology.dual_cells(topology.polygon_cells(boxes.select("id", "x", "y"), cells))
    want = meshes.node_mesh(spark, [0, 0], [1, 1], [n, n])
    both = dual.alias("a").join(want.alias("b"), "id")
    gap = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("vol", "cx", "cy", "px", "py", "xlo", "xhi", "ylo", "yhi")])
    assert both.count() == (n + 1) ** 2 and both.agg(F.max(gap)).first()[0] < 1e-14
    assert both.where("a.is_boundary <> b.is_boundary").count() == 0


def test_cells_that_touch_in_one_node(spark):
    """Two squares that share a corner only: its dual has a quarter of each."""
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (2, 1), (2, 2), (1, 2)])], "id long, x double, y double")
    cells = spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [2, 4, 5, 6])], "id long, nodes array<long>")
    dual = {r.id: (r.vol, r.is_boundary) for r in topology.dual_cells(topology.polygon_cells(nodes, cells)).collect()}
    assert dual[2] == (pytest.approx(0.5), True) and dual[0] == (pytest.approx(0.25), True)


def test_windows_that_are_not_convex():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        turn = np.sort(rng.uniform(0, 2 * math.pi, 9))
        rows.append([np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(0.2, 1, (9, 1)) + rng.uniform(-0.3, 0.3, 2) for _ in range(2)])
    s, t = (np.array([r[k] for r in rows]) for k in (0, 1))
    got = intersect.intersect_ring_rows((s, np.full(60, 9)), (t, np.full(60, 9)))
    for k in range(60):
        assert np.allclose(got[k], sum(intersect.intersect_rings(x, t[k]) for x in intersect._ears(s[k])), atol=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_node_fields_between_polygon_meshes(spark, mesh, order):
    _, m = mesh
    source = topology.dual_cells(m)
    target = topology.dual_cells(topology.polygon_cells(*random_mesh(spark, 5, 2)))
    source = source.withColumns({"one": F.lit(3.0), "line": 2 + F.col("px") - 3 * F.col("py")})
    r = Remapper(source, target, 2, source_adjacency=topology.node_neighbours(m), ref="p", options=Options(order=order, limiter="nolimiter", check_mismatch=False))
    got = r.interpolate(["one", "line"]).join(target, "id")
    assert got.agg(F.max(F.abs(F.col("one") - 3))).first()[0] < 1e-10
    assert r.weights().agg(F.sum("m0")).first()[0] == pytest.approx(1) and not r.mismatch().found
    if order > 1:  # a line at the overlaps is the line at the target's centroid
        assert got.agg(F.max(F.abs(F.col("line") - 2 - F.col("cx") + 3 * F.col("cy")))).first()[0] < 1e-10


def test_limited_node_gradients_keep_bounds(spark, mesh):
    _, m = mesh
    near = topology.node_neighbours(m)
    source = topology.dual_cells(m).withColumn("step", F.when(F.col("px") + F.col("py") < 1.05, 1.0).otherwise(-1.0))
    g = gradient.gradients(source, near, ["step"], 2, limiter="barth_jespersen", boundary_limiter="bnd_barth_jespersen", ref="p").join(source, "id")
    reach = F.transform("ring", lambda p: F.col("step") + F.col("g_step_x") * (p["x"] - F.col("px")) + F.col("g_step_y") * (p["y"] - F.col("py")))
    low, high = g.agg(F.min(F.array_min(reach)), F.max(F.array_max(reach))).first()
    assert low >= -1 - 1e-12 and high <= 1 + 1e-12 and g.where("g_step_x <> 0").count() > 0


def test_cell_fields_are_conserved_with_repair(spark, mesh):
    _, m = mesh
    source = topology.boundary_cells(m).withColumn("f", F.exp("cx") + F.col("cy"))
    shifted = random_mesh(spark, 5, 4)
    target = topology.polygon_cells(shifted[0].withColumn("x", F.col("x") + 0.15), shifted[1])
    got = remap(source, target, ["f"], 2, source_adjacency=topology.cell_neighbours(m), target_adjacency=topology.cell_neighbours(target)).join(target, "id")
    total = source.agg(F.sum(F.col("f") * F.col("vol"))).first()[0]
    assert got.agg(F.sum(F.col("f") * F.col("vol"))).first()[0] == pytest.approx(total)
