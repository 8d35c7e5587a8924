import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.operators import momentum
from fluxweave.plans.storage import materialize
from fluxweave.sources import topology

from .test_topology import random_mesh


@pytest.fixture(scope="module")
def both(spark):
    out = []
    for n, seed in ((6, 1), (5, 2)):
        nodes, cells = random_mesh(spark, n, seed)
        out.append((materialize(nodes), materialize(topology.polygon_cells(nodes, cells))))
    return out


def velocities(nodes, ux="x", uy="1.0"):
    return nodes.select(F.col("id").alias("node"), F.expr(ux).cast("double").alias("ux"), F.expr(uy).cast("double").alias("uy"))


def totals(df):
    return tuple(df.agg(F.sum("mass"), F.sum(F.col("mass") * F.col("ux")), F.sum(F.col("mass") * F.col("uy"))).first())


def test_corners_cover_their_cells(both):
    mesh = both[0][1]
    c = topology.corner_mesh(mesh).groupBy("id.cell").agg(F.sum("vol").alias("v"))
    assert c.join(mesh, F.col("cell") == F.col("id")).agg(F.max(F.abs(F.col("v") - F.col("vol")))).first()[0] < 1e-14


def test_staggered_momentum_of_polygons_is_conserved(both):
    (nodes, s), (_, t) = both
    corners = momentum.polygon_corners(s).withColumn("mass", (1 + F.col("x")) * F.col("vol"))
    got = momentum.remap_sgh(s, corners, velocities(nodes), t, topology.cell_neighbours(s), topology.cell_neighbours(t), momentum.polygon_corners(t), 2, limiter="barth_jespersen")
    assert totals(got) == pytest.approx(totals(corners.join(velocities(nodes), "node")), rel=1e-12)


def test_a_uniform_flow_stays_uniform(both):
    """Whatever the densities, one velocity everywhere is the same velocity afterwards."""
    (nodes, s), (_, t) = both
    corners = momentum.polygon_corners(s).withColumns({"mat": F.col("id") % 3, "mass": (1 + F.col("id") % 4) * F.col("vol")})
    held = s.withColumn("mat", F.col("id") % 3)
    _, got = momentum.remap_sgh_materials(corners, velocities(nodes, "3.0", "-2.0"), held.withColumnRenamed("vol", "volume"), held, t, adjacency=topology.cell_neighbours(s))
    for r in got.collect():
        assert (r.ux, r.uy) == pytest.approx((3.0, -2.0))


@pytest.mark.parametrize("second", [False, True])
def test_materials_at_corners_keep_mass_and_momentum_each(both, second):
    (nodes, s), (_, t) = both
    corners = momentum.polygon_corners(s).withColumns({"mat": F.col("id") % 3, "mass": (1 + F.col("x")) * F.col("vol")})
    held = s.withColumn("mat", F.col("id") % 3)
    got, at_nodes = momentum.remap_sgh_materials(corners, velocities(nodes), held.withColumnRenamed("vol", "volume"), held, t, adjacency=topology.cell_neighbours(s) if second else None)
    sums = lambda df, x: {r.mat: (r.m, r.p) for r in df.groupBy("mat").agg(F.sum("mass").alias("m"), F.sum(x).alias("p")).collect()}
    want = sums(corners.join(velocities(nodes), "node"), F.col("mass") * F.col("ux"))
    have = sums(got, F.col("momentum_x"))
    assert set(have) == set(want)
    for m, pair in want.items():
        assert have[m] == pytest.approx(pair, rel=1e-11)
    assert totals(at_nodes) == pytest.approx(totals(corners.join(velocities(nodes), "node")), rel=1e-11)


def test_materials_of_cells_keep_mass_and_momentum(both):
    (_, s), (_, t) = both
    held = s.withColumns({"mat": F.col("id") % 3, "density": 1 + F.col("cx"), "ux": F.col("cy"), "uy": F.lit(2.0)})
    parts, cells = momentum.remap_cch_materials(held, held, t, 2, adjacency=topology.cell_neighbours(s))
    want = totals(held.withColumn("mass", F.col("density") * F.col("vol")))
    assert totals(cells) == pytest.approx(want, rel=1e-11)
    assert totals(parts) == pytest.approx(want, rel=1e-11)
    share = np.array([r.s for r in parts.groupBy("id").agg(F.sum("volfrac").alias("s")).collect()])
    assert share == pytest.approx(np.ones(len(share)), abs=1e-12)
