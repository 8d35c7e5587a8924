import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.functions.geometry import polygon_moments
from fluxweave.operators import intersect, materials, repair
from fluxweave.plans.multi import MultiRemapper, Side
from fluxweave.plans.remap import Options
from fluxweave.sources import meshes, topology
from tests.test_topology import random_mesh

#: Three materials: left of a slanted line, and above and below another one to its right.
CUTS = [(1, [(-1.0, 0.3, -0.4)]), (2, [(1.0, -0.3, 0.4), (0.2, 1.0, 0.55)]), (3, [(1.0, -0.3, 0.4), (-0.2, -1.0, -0.55)])]


@pytest.fixture(scope="module")
def sides(spark):
    made = []
    for n, seed in ((6, 1), (5, 2)):
        m = topology.boundary_cells(topology.polygon_cells(*random_mesh(spark, n, seed))).cache()
        made.append(Side(m, topology.cell_neighbours(m).cache(), topology.dual_cells(m), topology.node_neighbours(m).cache()))
    return made


@pytest.fixture(scope="module")
def layout(spark, sides):
    source, _ = sides
    pieces = materials.half_plane_polygons(source.cells, CUTS).cache()
    held = materials.piece_centroids(pieces).join(source.cells.select("id", "vol"), "id")
    held = held.select("id", "mat", (F.col("volume") / F.col("vol")).alias("volfrac"), (F.col("mat") * 10.0).alias("flat"), (F.col("mat") + 2 * F.col("cx") - F.col("cy")).alias("line"))
    return pieces, held.cache()


def test_cell_node_and_material_fields_in_one_object(spark, sides, layout):
    source, target = sides
    pieces, held = layout
    source = Side(source.cells.withColumn("f", 1 + F.col("cx")), source.near, source.nodes.withColumn("g", 3 - F.col("py")), source.node_near)
    r = MultiRemapper(source, target, material=held, pieces=pieces, options=Options(limiter="nolimiter", check_mismatch=False))
    got = r.interpolate(cell=["f"], node=["g"], material=["flat", "line"])
    assert got["cell"].join(target.cells, "id").agg(F.max(F.abs(F.col("f") - 1 - F.col("cx")))).first()[0] < 1e-10
    assert got["node"].join(target.nodes, "id").agg(F.max(F.abs(F.col("g") - 3 + F.col("cy")))).first()[0] < 1e-10
    m = got["material"].join(target.cells.select("id", "vol"), "id")
    assert m.agg(F.max(F.abs(F.col("flat") - 10 * F.col("mat")))).first()[0] < 1e-10
    # each material's mass is that of the source, and fractions fill every target cell
    mass = lambda df, f: {x.mat: x.s for x in df.groupBy("mat").agg(F.sum(F.col(f) * F.col("volfrac") * F.col("vol")).alias("s")).collect()}
    want = held.join(source.cells.select("id", "vol"), "id")
    for f in ("flat", "line"):
        assert mass(m, f) == pytest.approx(mass(want, f))
    assert m.groupBy("id").agg(F.sum("volfrac").alias("v")).agg(F.max(F.abs(F.col("v") - 1))).first()[0] < 1e-12
    # a line in each material is kept where its stencil is not degenerate: everywhere but at slivers
    far = m.where(F.abs(F.col("line") - F.col("mat") - 2 * F.col("cx") + F.col("cy")) > 1e-9).count()
    assert far <= 0.2 * m.count()


def test_target_materials_follow_the_overlaps(spark, sides, layout):
    source, target = sides
    pieces, held = layout
    r = MultiRemapper(source, target, material=held, pieces=pieces, options=Options(order=1, check_mismatch=False))
    after = r.target_materials()
    exact = materials.half_plane_polygons(target.cells, CUTS).withColumn("a", polygon_moments(F.col("ring"))["m0"]).join(target.cells.select("id", "vol"), "id")
    both = after.join(exact.select("id", "mat", (F.col("a") / F.col("vol")).alias("want")), ["id", "mat"], "full")
    assert both.where("volfrac is null or want is null").count() == 0 and both.agg(F.max(F.abs(F.col("volfrac") - F.col("want")))).first()[0] < 1e-12
    before = target.cells.select("id").withColumn("mat", F.lit(1))
    changes = {(x.id, x.mat): x.change for x in materials.material_changes(before, after).collect()}
    had, has = {(x.id, 1) for x in before.collect()}, {(x.id, x.mat) for x in after.collect()}
    assert changes == {k: "added" for k in has - had} | {k: "removed" for k in had - has}


def test_interfaces_from_fractions_on_any_polygons(spark, sides, layout):
    source, target = sides
    _, held = layout
    seen = []

    def reconstructor(mesh, fractions, near):
        seen.append(fractions.columns)
        return materials.reconstruct(mesh, fractions, near)

    r = MultiRemapper(source, target, material=held, reconstructor=reconstructor, options=Options(order=1, check_mismatch=False))
    area = materials.piece_centroids(r.pieces()).join(source.cells.select("id", "vol"), "id").join(held, ["id", "mat"], "full")
    convex = source.cells.where(F.size("ring") <= 4).select("id")
    gap = area.join(convex, "id").where("volfrac > 1e-12").agg(F.max(F.abs(F.coalesce(F.col("volume") / F.col("vol"), F.lit(9.0)) - F.col("volfrac")))).first()[0]
    assert gap < 1e-12 and seen == [["id", "mat", "volfrac"]]
    got = r.interpolate(material=["flat"])["material"]
    assert got.agg(F.max(F.abs(F.col("flat") - 10 * F.col("mat")))).first()[0] < 1e-10


def test_offsets_of_area():
    rng = np.random.default_rng(2)
    turn = np.sort(rng.uniform(0, 2 * np.pi, (500, 7)), 1)
    p = np.stack([np.cos(turn), np.sin(turn)], 2) * rng.uniform(0.1, 3, (500, 1, 1))
    n = np.full(500, 7)
    angle = rng.uniform(0, 7, 500)
    normal = np.stack([np.cos(angle), np.sin(angle)], 1)
    whole = intersect._ring_moments(p, n, "cartesian")[:, 0]
    for share in (0.0, 1e-9, 0.3, 0.5, 1 - 1e-9, 1.0):
        offset = intersect.offsets_of_area(p, n, normal, share * whole)
        got = intersect._ring_moments(*intersect._clip_rows(p, n, normal, offset), "cartesian")[:, 0]
        assert np.abs(got - share * whole).max() <= 2e-13 * whole.max()


def test_missing_parts_are_named(sides, layout):
    source, target = sides
    with pytest.raises(ValueError, match="materials"):
        MultiRemapper(source, target).interpolate(material=["x"])
    with pytest.raises(ValueError, match="around the nodes"):
        MultiRemapper(Side(source.cells), target).interpolate(node=["x"])
    with pytest.raises(ValueError, match="order"):
        MultiRemapper(source, target, material=layout[1]).interpolate(material=["flat"], options=Options(order=3))


def test_repair_of_many_passes_keeps_its_plan_small(spark):
    n = 12
    t = meshes.box_mesh(spark, [0, 0], [1, 1], [n, n])
    v = t.select("id", (F.sin(F.col("cx") * 9) + F.pmod(F.col("id"), F.lit(7)) / 5).alias("f")).cache()
    source = t.join(v, "id").withColumn("f", F.col("f") * 1.2)
    layers = t.select("id", F.col("vol").alias("covered"), F.lit(0).alias("layer"))
    out, rel = repair.repair(v, t, source, layers, meshes.box_adjacency(t, [n, n]), "f", max_iterations=30, conservation=-1.0, bounds=(-0.5, 1.9))
    values = np.array([r.f for r in v.orderBy("id").collect()])
    wanted, vol, step_volume = 1.2 * values.sum() / n**2, 1 / n**2, 1.0
    for _ in range(30):
        moved = values - (values.sum() * vol - wanted) / step_volume
        held = (moved < -0.5) | (moved > 1.9)
        values, step_volume = np.clip(moved, -0.5, 1.9), 1.0 - held.sum() * vol
    assert np.allclose([r.f for r in out.orderBy("id").collect()], values, atol=1e-12) and abs(rel) < 1e-12
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


MAP = [[1.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.1, 0.0, 1.0]]
SPACES = [(1, [(-1.0, 0.2, 0.1, -0.5)]), (2, [(1.0, -0.2, -0.1, 0.5), (0.1, 0.3, 1.0, 0.7)]), (3, [(1.0, -0.2, -0.1, 0.5), (-0.1, -0.3, -1.0, -0.7)])]


@pytest.fixture(scope="module")
def solid_sides(spark):
    made = []
    for n in (4, 3):
        boxes = meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [n, n, n])
        made.append(Side(meshes.mapped_solids(meshes.box_solids(boxes), MAP).cache(), meshes.box_adjacency(boxes, [n, n, n]).cache()))
    return made


def test_material_fields_in_three_dimensions(spark, solid_sides):
    source, target = solid_sides
    pieces = materials.half_space_polyhedra(source.cells, SPACES).cache()
    held = materials.piece_centroids(pieces).join(source.cells.select("id", "vol"), "id")
    assert held.groupBy("id").agg(F.sum("volume").alias("v"), F.first("vol").alias("vol")).agg(F.max(F.abs(F.col("v") - F.col("vol")))).first()[0] < 1e-14
    held = held.select("id", "mat", (F.col("volume") / F.col("vol")).alias("volfrac"), (F.col("mat") + F.col("cx") - 2 * F.col("cz")).alias("line")).cache()
    r = MultiRemapper(source, target, 3, material=held, pieces=pieces, options=Options(limiter="nolimiter", check_mismatch=False))
    got = r.interpolate(material=["line"])["material"].join(target.cells.select("id", "vol"), "id").cache()
    mass = lambda df: {x.mat: x.s for x in df.groupBy("mat").agg(F.sum(F.col("line") * F.col("volfrac") * F.col("vol")).alias("s")).collect()}
    assert mass(got) == pytest.approx(mass(held.join(source.cells.select("id", "vol"), "id")))
    exact = materials.piece_centroids(materials.half_space_polyhedra(target.cells, SPACES)).join(target.cells.select("id", "vol"), "id")
    both = got.join(exact.select("id", "mat", (F.col("volume") / F.col("vol")).alias("want")), ["id", "mat"], "full")
    assert both.agg(F.max(F.abs(F.coalesce("volfrac", F.lit(0.0)) - F.coalesce("want", F.lit(0.0))))).first()[0] < 1e-11
    far = got.where(F.abs(F.col("line") - F.col("mat") - F.col("cx") + 2 * F.col("cz")) > 1e-9).count()
    assert far <= 0.2 * got.count()


def test_interfaces_in_three_dimensions_keep_fractions(spark, solid_sides):
    source, _ = solid_sides
    held = materials.piece_centroids(materials.half_space_polyhedra(source.cells, SPACES)).join(source.cells.select("id", "vol"), "id").select("id", "mat", (F.col("volume") / F.col("vol")).alias("volfrac")).cache()
    pieces = materials.reconstruct_solids(source.cells, held, source.near)
    area = materials.piece_centroids(pieces).join(source.cells.select("id", "vol"), "id").join(held, ["id", "mat"], "full")
    assert area.agg(F.max(F.abs(F.coalesce(F.col("volume") / F.col("vol"), F.lit(0.0)) - F.col("volfrac")))).first()[0] < 1e-12


def test_cells_that_are_bent_are_named(spark):
    boxes = meshes.box_solids(meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [1, 1, 1]))
    bent = boxes.withColumn("points", F.transform("points", lambda p: F.when((p["x"] == 1) & (p["y"] == 1) & (p["z"] == 1), F.struct((p["x"] + 0.2).alias("x"), p["y"].alias("y"), p["z"].alias("z"))).otherwise(p)))
    with pytest.raises(Exception, match="not convex"):
        materials.half_space_polyhedra(bent, SPACES).count()


def test_cuts_and_volumes_of_random_bodies():
    from fluxweave.operators import polyhedra
    from tests.test_polyhedra import BOX, CUBE, TET, WEDGE, shaped, solids

    rng = np.random.default_rng(6)
    s = solids([shaped(rng, [(CUBE, BOX), TET, WEDGE][k % 3]) for k in range(120)])
    normal = rng.normal(size=(120, 3))
    normal[:30] = polyhedra.planes(s)[0][:30, 0]  # along a face
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    whole = polyhedra.body_moments(s)
    for share in (1e-6, 0.2, 0.5, 0.9):
        offset = polyhedra.offsets_of_volume(s, normal, share * whole[:, 0])
        below, above = polyhedra.body_moments(polyhedra.cut(s, normal, offset)), polyhedra.body_moments(polyhedra.cut(s, -normal, -offset))
        assert np.abs(below[:, 0] - share * whole[:, 0]).max() < 1e-12
        assert np.abs(below + above - whole).max() < 1e-12
