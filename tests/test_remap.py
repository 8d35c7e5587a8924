"""Analytic oracles of the mesh remap: error norms, conservation, bounds, repairs."""

import math

import pytest
from pyspark.sql import functions as F

from fluxweave.operators import gradient, interpolate, intersect, materials, momentum, repair, search, swept
from fluxweave.plans.remap import ONE_CALL, Options, Remapper, remap
from fluxweave.sources import meshes

FIELDS = {2: {"const": "10000", "lin": "100*(x+y)", "quad": "9*x^2+1600*y^2"}, 3: {"const": "10000", "lin": "100*(x+y+z)", "quad": "9*x^2+1600*y^2+250000*z^2"}}


def box(spark, dim, n, lo=0.0, hi=1.0):
    return meshes.box_mesh(spark, [lo] * dim, [hi] * dim, [n] * dim)


def with_fields(mesh, dim):
    for name, formula in FIELDS[dim].items():
        mesh = meshes.with_field(mesh, name, formula, dim)
    return mesh


def l2(spark, dim, order, offset, limiter="nolimiter"):
    s = with_fields(box(spark, dim, 5), dim)
    t = box(spark, dim, 4, *((0.2, 1.2) if offset else (0.0, 1.0)))
    near, near_t = meshes.box_adjacency(s, [5] * dim), meshes.box_adjacency(t, [4] * dim)
    names = list(FIELDS[dim])
    got = remap(s, t, names, dim, source_adjacency=near, target_adjacency=near_t, options=Options(order=order, limiter=limiter))
    exact = with_fields(t, dim).select("id", "vol", *[F.col(f).alias("e_" + f) for f in names])
    met = got.join(exact, "id")
    row = met.agg(*[F.sqrt(F.sum(F.pow(F.col(f) - F.col("e_" + f), 2.0))).alias(f) for f in names], *[F.sum(F.col(f) * F.col("vol")).alias("m_" + f) for f in names]).first()
    mass = s.agg(*[F.sum(F.col(f) * F.col("vol")).alias(f) for f in names]).first()
    for f in names:
        assert row["m_" + f] == pytest.approx(mass[f], rel=1e-9)
    return [row[f] for f in names]


@pytest.mark.parametrize(
    ("dim", "order", "offset", "expected"),
    [
        (2, 1, False, [0, 6.3245553203367573, 83.644493615838698]),
        (2, 2, False, [0, 0, 12.484585705981344]),
        (2, 1, True, [0, 166.01204775557699, 1864.3054259128905]),
        (2, 2, True, [0, 161.86414056238655, 1724.7774423007857]),
        (3, 1, False, [0, 15.491933384829508, 26139.462467794965]),
        (3, 2, False, [0, 0, 3904.3739523156646]),
        (3, 2, True, [0, 483.73546489791454, 538971.52673063509]),
    ],
)
def test_error_norms(spark, dim, order, offset, expected):
    assert l2(spark, dim, order, offset) == pytest.approx(expected, abs=1e-6, rel=1e-9)


@pytest.mark.parametrize(("order", "limiter", "expected"), [(1, "nolimiter", 5.022128), (2, "nolimiter", 4.779890), (2, "barth_jespersen", 5.013543)])
def test_step_limiter(spark, order, limiter, expected):
    norm = 0.8192319205190405
    a, b = 1.0 * norm, 0.7 * norm
    step = F.when(a * F.col("cx") + b * F.col("cy") >= 0.5 * a + 0.5 * b, 1.0).otherwise(-1.0)
    s, t = box(spark, 2, 11).withColumn("v", step), box(spark, 2, 18)
    got = remap(s, t, ["v"], 2, source_adjacency=meshes.box_adjacency(s, [11, 11]), options=Options(order=order, limiter=limiter, check_mismatch=False))
    e = got.join(t.select("id", "cx", "cy"), "id").agg(F.sqrt(F.sum(F.pow(F.col("v") - step, 2.0)))).first()[0]
    assert e == pytest.approx(expected, abs=2e-6)


@pytest.mark.parametrize(
    ("partial", "empty", "expected"),
    [
        ("constant", "extrapolate", (1.0, 1.0)), ("constant", "leave_empty", (1.0, 0.0)), ("locally_conservative", "extrapolate", (0.4, 0.4)),
        ("locally_conservative", "leave_empty", (0.4, 0.0)), ("globally_conservative", "extrapolate", (0.6, 0.6)), ("shifted_conservative", "leave_empty", (1.2, 0.0)),
    ],
)
def test_repair_table(spark, partial, empty, expected):
    s = meshes.box_mesh(spark, [-0.8, 0], [0.4, 1], [1, 1]).withColumn("v", F.lit(1.0))
    t = meshes.box_mesh(spark, [0, 0], [2, 1], [2, 1])
    got = remap(s, t, ["v"], 2, target_adjacency=meshes.box_adjacency(t, [2, 1]), options=Options(order=1, partial=partial, empty=empty), bounds={"v": (0.0, 1e308)})
    assert [r.v for r in got.orderBy("id").collect()] == pytest.approx(list(expected), abs=1e-12)


@pytest.mark.parametrize(("compat", "partial", "expected"), [(True, "globally_conservative", 1.5), (False, "globally_conservative", 0.5), (False, "constant", 0.0), (False, "locally_conservative", 0.0)])
def test_disjoint_meshes(spark, compat, partial, expected):
    s = box(spark, 2, 3).withColumn("v", F.lit(1.0))
    t = box(spark, 2, 2, 2.0, 4.0)
    got = remap(s, t, ["v"], 2, target_adjacency=meshes.box_adjacency(t, [2, 2]), options=Options(order=1, partial=partial, compat=compat))
    assert [r.v for r in got.collect()] == pytest.approx([expected] * 4, abs=1e-12)


def test_search_of_a_three_by_three_mesh(spark):
    got = {}
    for r in search.box_pairs(box(spark, 2, 2), box(spark, 2, 3), 2, closed=False).collect():
        got.setdefault(r.tgt_id, set()).add(r.src_id)
    for tx in (0, 1):
        for ty in (0, 1):
            b = tx + 3 * ty
            assert got[tx + 2 * ty] == {b, b + 1, b + 3, b + 4}


def test_bins_agree_with_the_range_join_for_uneven_boxes(spark):
    import random

    rng = random.Random(5)

    def boxes(n):
        rows = []
        for i in range(n):
            x, y, w, h = rng.random(), rng.random(), rng.choice([1e-3, 0.01, 0.3, 2.0]), rng.choice([1e-3, 0.05, 1.0])
            rows.append((i, x, x + w, y, y + h))
        return spark.createDataFrame(rows, "id long, xlo double, xhi double, ylo double, yhi double")

    a, b = boxes(60), boxes(80)
    for closed in (True, False):
        got = sorted(map(tuple, search.box_pairs(a, b, 2, closed=closed).collect()))
        assert got == sorted(map(tuple, search.theta_pairs(a, b, 2, closed=closed).collect()))
        assert len(got) == len(set(got))


def test_direct_product_search_agrees_with_boxes(spark):
    axis_s, axis_t = [0, 0.2, 0.8, 1], [0, 0.4, 0.6, 1]
    s, t = meshes.direct_product_mesh(spark, [axis_s, axis_s]), meshes.direct_product_mesh(spark, [axis_t, axis_t])
    got = sorted(map(tuple, search.direct_product_pairs(t, [axis_s, axis_s]).collect()))
    assert got == sorted(map(tuple, search.box_pairs(t, s, 2, closed=False).collect()))


@pytest.mark.parametrize(("system", "dim"), [("cartesian", 1), ("cylindrical_radial", 1), ("spherical_radial", 1), ("cylindrical_axisymmetric", 2), ("cylindrical_polar", 2), ("cylindrical_3d", 3)])
def test_moments_of_coordinate_systems_add_up(spark, system, dim):
    points = [[0, 0.2, 0.8, 1]] * dim
    other = [[0, 0.4, 0.6, 1]] * dim
    s, t = meshes.direct_product_mesh(spark, points, system), meshes.direct_product_mesh(spark, other, system)
    w = intersect.intersect_boxes(t, s, dim, system=system)
    m = repair.check_mismatch(w, s, t)
    assert not m.found
    whole = {"cartesian": 1, "cylindrical_radial": math.pi, "spherical_radial": 4 * math.pi / 3, "cylindrical_axisymmetric": math.pi, "cylindrical_polar": 0.5, "cylindrical_3d": 0.5}[system]
    assert m.source_volume == pytest.approx(whole, rel=1e-12)


def test_spherical_boxes_in_three_dimensions_are_refused(spark):
    with pytest.raises(ValueError):
        meshes.direct_product_mesh(spark, [[0, 1]] * 3, "spherical_radial")


def test_gradient_is_exact_for_linear_fields(spark):
    s = meshes.with_field(box(spark, 3, 4), "v", "1+2*x-3*y+5*z", 3)
    for r in gradient.gradients(s, meshes.box_adjacency(s, [4, 4, 4]), ["v"], 3).collect():
        assert (r.g_v_x, r.g_v_y, r.g_v_z) == pytest.approx((2, -3, 5), abs=1e-9)


def test_gradient_of_a_single_cell_is_zero(spark):
    s = box(spark, 2, 1).withColumn("v", F.lit(3.0))
    assert gradient.gradients(s, meshes.box_adjacency(s, [1, 1]), ["v"], 2).first().g_v_x == 0.0


def test_limited_remap_keeps_bounds(spark):
    s = box(spark, 2, 8).withColumn("v", F.when(F.col("ix") == 3, 5.0).otherwise(1.0))
    t = box(spark, 2, 11)
    o = Options(limiter="barth_jespersen", boundary_limiter="bnd_barth_jespersen", check_mismatch=False)
    lo, hi = remap(s, t, ["v"], 2, source_adjacency=meshes.box_adjacency(s, [8, 8]), options=o).agg(F.min("v"), F.max("v")).first()
    assert lo >= 1 - 1e-9
    assert hi <= 5 + 1e-9


def test_third_order_reproduces_quadratics_inside(spark):
    s = meshes.with_field(box(spark, 2, 8), "v", "1+x+2*y+3*x^2+x*y-y^2", 2)
    t = box(spark, 2, 8, 0.25, 0.75)
    near = meshes.box_adjacency(s, [8, 8])
    got = remap(s, t, ["v"], 2, source_adjacency=near, options=Options(order=3, limiter="nolimiter", check_mismatch=False))
    exact = meshes.with_field(t, "e", "1+x+2*y+3*x^2+x*y-y^2", 2)
    assert got.join(exact, "id").agg(F.max(F.abs(F.col("v") - F.col("e")))).first()[0] < 1e-6


def test_polygons_agree_with_boxes_and_non_convex_windows_work(spark):
    import numpy as np

    s, t = box(spark, 2, 5), box(spark, 2, 4)
    a = intersect.intersect_boxes(t, s, 2).groupBy("tgt_id").agg(F.sum("m0").alias("m"), F.sum("m1x").alias("x"))
    b = intersect.intersect_polygons(meshes.box_rings(t), meshes.box_rings(s)).groupBy("tgt_id").agg(F.sum("m0").alias("m"), F.sum("m1x").alias("x"))
    for x, y in zip(a.orderBy("tgt_id").collect(), b.orderBy("tgt_id").collect(), strict=True):
        assert tuple(x) == pytest.approx(tuple(y))
    star = np.array([[0, 0], [2, 0], [2, 2], [1, 0.5], [0, 2]], float)
    square = np.array([[0, 0], [2, 0], [2, 1], [0, 1]], float)
    both = intersect.intersect_rings(star, star)
    assert both[0] == pytest.approx(intersect.area_moments(star)[0])
    assert intersect.intersect_rings(square, star)[0] == pytest.approx(intersect.intersect_rings(star, square)[0])


def test_polyhedra_cover_the_cube(spark):
    from fluxweave import catalog

    w = catalog.QUERIES["intersect_polyhedra"](spark, "")
    row = w.agg(F.sum("m0"), F.sum("m1x"), F.sum("m1z")).first()
    assert tuple(row) == pytest.approx((1, 0.5, 0.5), abs=1e-6)


def test_swept_remap_conserves_and_keeps_constants_and_linears(spark):
    n = [6, 6]
    nodes = meshes.box_nodes(spark, [0, 0], [1, 1], n)
    after = meshes.move_nodes(nodes, {"x": 0.03 * F.sin(F.col("y") * 6), "y": 0.02 * F.cos(F.col("x") * 5)}, F.col("is_boundary"))
    s, t = meshes.polygon_mesh(meshes.rings_from_nodes(nodes, n)), meshes.polygon_mesh(meshes.rings_from_nodes(after, n))
    s = s.withColumn("one", F.lit(2.0)).withColumn("lin", F.col("cx") + 3 * F.col("cy"))
    near = meshes.box_adjacency(meshes.box_mesh(spark, [0, 0], [1, 1], n), n)
    w = swept.swept_weights_2d(s, t, swept.box_edge_neighbours(6, 6))
    got = Remapper(s, t, 2, source_adjacency=near, weights=w, options=Options(limiter="nolimiter", check_mismatch=False)).interpolate(["one", "lin"])
    row = got.join(t, "id").agg(F.max(F.abs(F.col("one") - 2)), F.max(F.abs(F.col("lin") - F.col("cx") - 3 * F.col("cy"))), F.sum(F.col("lin") * F.col("vol"))).first()
    assert row[0] < 1e-12
    assert row[1] < 1e-9
    assert row[2] == pytest.approx(s.agg(F.sum(F.col("lin") * F.col("vol"))).first()[0])


def test_swept_faces_in_three_dimensions(spark):
    cells = spark.createDataFrame([(0, 1.0, 0.5, 0.5, 0.5), (1, 1.0, 1.5, 0.5, 0.5)], "id long, m0 double, m1x double, m1y double, m1z double")
    before = [[1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [1.0, 1.0, 1.0], [1.0, 0.0, 1.0]]
    after = [[1.25, y, z] for _, y, z in before]
    faces = spark.createDataFrame([(0, 1, before, after), (1, 0, before[::-1], after[::-1])], "id long, nbr long, before array<array<double>>, after array<array<double>>")
    got = {(r.tgt_id, r.src_id): 0.0 for r in swept.swept_weights_3d(cells, faces).collect()}
    for r in swept.swept_weights_3d(cells, faces).collect():
        got[r.tgt_id, r.src_id] += r.m0
    assert got[0, 0] == pytest.approx(1.0)
    assert got[0, 1] == pytest.approx(0.25)
    assert got[1, 1] == pytest.approx(0.75)


def test_parts_do_not_mix(spark):
    s, t = box(spark, 2, 5), box(spark, 2, 5)
    tag = lambda d: d.withColumn("part", (F.col("cx") < 0.5).cast("int")).withColumn("rho", F.when(F.col("cx") < 0.5, 100.0).otherwise(1.0))
    got = Remapper(tag(s), tag(t).drop("rho"), 2, part="part", options=Options(order=1, check_mismatch=False)).interpolate({"rho": "density"})
    assert {round(r.density, 9) for r in got.collect()} == {100.0, 1.0}


def test_materials_keep_exact_volumes(spark):
    s, t = meshes.box_rings(box(spark, 2, 5)), meshes.box_rings(box(spark, 2, 4))
    left, top = (-1.0, 0.0, -0.5), (0.0, 1.0, 0.5)
    cuts = [(0, [left]), (1, [(1.0, 0.0, 0.5), top]), (2, [(1.0, 0.0, 0.5), (0.0, -1.0, -0.5)])]
    pieces = materials.half_plane_polygons(s, cuts)
    w = materials.material_weights(t, pieces)
    got = materials.material_cells(w, t, 2).join(t.select("id", "vol"), "id").groupBy("mat").agg(F.sum(F.col("volfrac") * F.col("vol")).alias("v"))
    assert {r.mat: round(r.v, 9) for r in got.collect()} == {0: 0.5, 1: 0.25, 2: 0.25}


def test_reconstruction_matches_fractions(spark):
    from fluxweave.functions.geometry import polygon_moments

    s = meshes.box_rings(box(spark, 2, 8))
    f = materials.sampled_fractions(s, 2, materials.LAYOUTS["ball"])
    pieces = materials.reconstruct(s, f, meshes.box_adjacency(s, [8, 8])).withColumn("a", polygon_moments(F.col("ring"))["m0"]).join(s.select("id", "vol"), "id")
    gap = pieces.join(f, ["id", "mat"]).agg(F.max(F.abs(F.col("a") / F.col("vol") - F.col("volfrac")))).first()[0]
    assert gap < 1e-9


def test_momentum_is_conserved_both_ways(spark):
    s, t = box(spark, 2, 6), box(spark, 2, 5)
    near, near_t = meshes.box_adjacency(s, [6, 6]), meshes.box_adjacency(t, [5, 5])
    cells = s.withColumns({"mass": (1 + F.col("cx")) * F.col("vol"), "ux": F.col("cy"), "uy": F.lit(1.0)})
    got = momentum.remap_cch(cells, t, near, 2).agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("ux")).alias("p")).first()
    want = cells.agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("ux")).alias("p")).first()
    assert tuple(got) == pytest.approx(tuple(want))
    corners = momentum.box_corners(s, [6, 6]).withColumn("mass", (1 + F.col("x")) * F.col("vol"))
    nodes = meshes.box_nodes(spark, [0, 0], [1, 1], [6, 6]).select(F.col("id").alias("node"), F.col("x").alias("ux"), F.lit(1.0).alias("uy"))
    out = momentum.remap_sgh(s, corners.select("id", "node", "mass"), nodes, t, near, near_t, momentum.box_corners(t, [5, 5]), 2)
    got = out.agg(F.sum("mass"), F.sum(F.col("mass") * F.col("ux")), F.sum(F.col("mass") * F.col("uy"))).first()
    want = corners.join(nodes, "node").agg(F.sum("mass"), F.sum(F.col("mass") * F.col("ux")), F.sum(F.col("mass") * F.col("uy"))).first()
    assert tuple(got) == pytest.approx(tuple(want))


def test_node_fields_and_vector_fields(spark):
    s = meshes.node_mesh(spark, [0, 0], [1, 1], [5, 5]).withColumn("v", F.col("px") + F.col("py"))
    t = meshes.node_mesh(spark, [0, 0], [1, 1], [4, 4])
    w = intersect.intersect_boxes(t, s, 2)
    assert not repair.check_mismatch(w, s, t).found
    got = interpolate.first_order(w, s.withColumn("two", F.array("v", F.col("v") * 2)), t, ["v", "two"])
    for r in got.collect():
        assert r.two == pytest.approx([r.v, 2 * r.v])


def test_compare_finds_only_real_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1e9)], "id long, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, 1e9 + 1e-4)], "id long, v double")
    assert interpolate.compare(a, b, ["id"], "v").count() == 0
    assert interpolate.compare(a, b.where("id = 1"), ["id"], "v").count() == 1


def test_partitioning_does_not_change_results(spark):
    s = box(spark, 2, 5).withColumn("v", F.col("cx"))
    t = box(spark, 2, 4)
    o = Options(order=1, check_mismatch=False)
    a = remap(s, t, ["v"], 2, options=o).orderBy("id").collect()
    b = remap(s.repartition(7), t.repartition(3), ["v"], 2, options=o).orderBy("id").collect()
    assert [r.v for r in a] == pytest.approx([r.v for r in b])
    assert ONE_CALL.partial == "globally_conservative"


def test_batched_clipping_against_single_pairs():
    """Convex and other rings of different lengths, batch against pair by pair."""
    import numpy as np

    from fluxweave.operators import intersect

    rng, rings = np.random.default_rng(5), []
    for k in range(120):
        n = int(rng.integers(3, 9))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = 1.0 if k % 3 else rng.uniform(0.4, 1.2, n)  # every third one is a star
        rings.append(rng.uniform(0, 1.5, 2) + np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1))

    def padded(each):
        most = max(map(len, each))
        return np.stack([np.concatenate([r, np.repeat(r[:1], most - len(r), 0)]) for r in each]), np.array([len(r) for r in each])

    def single(s, t, system):
        try:
            return intersect.intersect_rings(s, t, system)
        except ValueError:  # the angles of a star may leave its centre outside
            return None

    for system in ("cartesian", "cylindrical_axisymmetric"):
        pairs = [(s, t, m) for s, t in zip(rings, rings[1:] + rings[:1], strict=True) if (m := single(s, t, system)) is not None]
        assert len(pairs) > 100
        got = intersect.intersect_ring_rows(padded([p[0] for p in pairs]), padded([p[1] for p in pairs]), system)
        assert np.abs(got - np.array([p[2] for p in pairs])).max() < 1e-12


def test_phases_are_timed(spark, tmp_path):
    import json

    from fluxweave.plans.remap import Options, Remapper
    from fluxweave.plans.timing import Phases
    from fluxweave.sources import meshes

    phases = Phases()
    s = meshes.with_field(meshes.box_mesh(spark, [0, 0], [1, 1], [5, 5]), "f", "1 + x", 2)
    t = meshes.box_mesh(spark, [0.2, 0.2], [1.2, 1.2], [4, 4])
    Remapper(s, t, 2, target_adjacency=meshes.box_adjacency(t, [4, 4]), options=Options(order=1), phases=phases).interpolate(["f"]).count()
    assert {"intersect", "mismatch", "layers", "interpolate"} <= set(phases.seconds)
    assert sum(phases.shares().values()) == pytest.approx(100)
    assert [r.phase for r in phases.frame(spark).collect()] == list(phases.seconds)
    phases.append(str(tmp_path / "t.dat"), cells=25)
    assert json.loads((tmp_path / "t.dat").read_text())["cells"] == 25


def test_layers_in_one_task_and_step_by_step(spark):
    """Both ways through the layers of empty cells agree, cells out of reach included."""
    from pyspark.sql import functions as F

    from fluxweave.operators import intersect, repair
    from fluxweave.sources import meshes

    s = meshes.box_mesh(spark, [0, 0], [1, 1], [9, 9])
    t = meshes.box_mesh(spark, [0.5, 0.4], [2.0, 1.6], [12, 10])
    near = meshes.box_adjacency(t, [12, 10]).where("id < 110 and nbr < 110")  # the last row is cut off
    w = intersect.intersect_boxes(t, s, 2)
    found = [sorted(tuple(r) for r in repair.empty_layers(t, w, near, k).select("id", F.coalesce("layer", F.lit(-1))).collect()) for k in (0, 10**6)]
    assert found[0] == found[1]
    assert {x for _, x in found[0]} >= {-1, 0, 1, 2, 5}
    v = repair.empty_layers(t, w, near).withColumn("f", F.when(F.col("layer") == 0, F.sin(F.col("id"))).otherwise(0.0))
    filled = [sorted((r.id, round(r.f, 9)) for r in repair.extrapolate(v, near, "f", k).collect()) for k in (0, 10**6)]
    assert filled[0] == filled[1]
    assert len(filled[0]) == 120
