"""Particle operators: reproduction of polynomials, kernels, integrals, facets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave import catalog
from fluxweave.functions import kernels
from fluxweave.operators import particles, search
from fluxweave.plans.remap import mesh_swarm_mesh, swarm_remap
from fluxweave.sources import meshes, topology
from fluxweave.sources import particles as swarms


def with_h(df, dim, h):
    return df.withColumns({"h" + a: F.lit(h) for a in "xyz"[:dim]})


@pytest.mark.parametrize("center", ["gather", "scatter"])
@pytest.mark.parametrize(("dim", "basis", "formula"), [(1, "linear", "1+2*x"), (2, "unitary", "7"), (2, "linear", "1+2*x-y"), (2, "quadratic", "x^2+x*y-3*y^2+1"), (3, "linear", "x+y+z")])
def test_polynomials_are_reproduced(spark, dim, basis, formula, center):
    n = {1: 20, 2: 9, 3: 5}[dim]
    s = with_h(swarms.cartesian(spark, [0] * dim, [1] * dim, [n] * dim, perturb=0.2), dim, 2.0 / n)
    t = with_h(swarms.cartesian(spark, [0.1] * dim, [0.9] * dim, [4] * dim), dim, 2.0 / n)
    f = lambda df, name: meshes.with_field(df, name, formula, dim, at="")
    s = f(s, "v").persist()
    got = swarm_remap(s, t, ["v"], dim, basis=basis, center=center).join(f(t, "e"), "id")
    assert got.agg(F.max(F.abs(F.col("v") - F.col("e")))).first()[0] < 1e-8


def test_derivatives_are_estimated(spark):
    s = meshes.with_field(with_h(swarms.cartesian(spark, [0, 0], [1, 1], [9, 9]), 2, 0.2), "v", "x^2+3*y", 2, at="")
    t = with_h(swarms.cartesian(spark, [0.2, 0.2], [0.8, 0.8], [3, 3]), 2, 0.2)
    got = swarm_remap(s, t, ["v"], 2, basis="quadratic", derivative=1).join(t, "id")
    assert got.agg(F.max(F.abs(F.col("v") - 2 * F.col("x")))).first()[0] < 1e-8


def test_too_few_neighbours_give_zero(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 5.0)], "id long, x double, y double, hx double, hy double, v double")
    t = spark.createDataFrame([(0, 0.1, 0.1, 1.0, 1.0), (1, 9.0, 9.0, 1.0, 1.0)], "id long, x double, y double, hx double, hy double")
    assert [r.v for r in swarm_remap(s, t, ["v"], 2, basis="linear").orderBy("id").collect()] == [0.0, 0.0]
    assert [r.v for r in swarm_remap(s, t, {"v": "w"}, 2).withColumnRenamed("w", "v").orderBy("id").collect()] == [5.0, 0.0]


@pytest.mark.parametrize("name", ["b4", "epanechnikov", "polyramp"])
def test_derivatives_of_kernels(spark, name):
    e = 1e-6
    x = spark.range(-190, 191).select((F.col("id") / 100 + 0.00311).alias("x")).where("x > 0.01 or x < -0.01")
    x = x.where("abs(abs(x) - 1) > 0.01") if name != "polyramp" else x.where("x > 0.01 and abs(x - 1) > 0.01")
    for d in (0, 1):
        slope = (kernels.kernel(name, F.col("x") + e, d) - kernels.kernel(name, F.col("x") - e, d)) / (2 * e)
        assert x.agg(F.max(F.abs(slope - kernels.kernel(name, F.col("x"), d + 1)))).first()[0] < 1e-4
    if name == "b4":
        slope = (kernels.b4_integral(F.col("x") + e) - kernels.b4_integral(F.col("x") - e)) / (2 * e)
        assert x.agg(F.max(F.abs(slope - kernels.kernel("b4", F.col("x")) * 2 / 3))).first()[0] < 1e-4


def test_integrals_of_polytopes():
    square = np.array([[0, 0], [2, 0], [2, 1], [0, 1]], float)
    assert particles.volume_integral(square, "quadratic") == pytest.approx([2, 2, 1, 4 / 3, 1, 1 / 3])
    assert particles.volume_integral(np.array([[0.0], [3.0]]), "linear") == pytest.approx([3, 4.5])
    tet = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    assert particles.volume_integral(tet, "linear") == pytest.approx([1 / 6, 1 / 24, 1 / 24, 1 / 24])
    cube = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]], float)
    assert particles.volume_integral(cube, "linear") == pytest.approx([1, 0.5, 0.5, 0.5])
    wedge = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 2], [1, 0, 2], [0, 1, 2]], float)
    assert particles.volume_integral(wedge, "unitary") == pytest.approx([1])
    with pytest.raises(ValueError):
        particles.volume_integral(cube, "quadratic")
    with pytest.raises(ValueError):
        particles.shape_of(5, 3)


@pytest.mark.parametrize(("basis", "dim"), [("unitary", 1), ("linear", 2), ("quadratic", 2), ("quadratic", 3)])
def test_jets(basis, dim):
    rng = np.random.default_rng(1)
    x, c = rng.random(dim), rng.random(dim)
    value = lambda p: np.array([float(v) for v in kernels.basis(basis, list(p))])
    j = particles.jet_at(basis, x)
    assert j[:, 0] == pytest.approx(value(x))
    assert particles.inverse_jet_at(basis, x) @ j == pytest.approx(np.eye(len(j)))
    assert particles.transfer(basis, c) @ value(x - c) == pytest.approx(value(x))


def test_operator_regression_integrates_linear_fields(spark):
    s = meshes.with_field(with_h(swarms.cartesian(spark, [0, 0], [1, 1], [9, 9]), 2, 0.3), "v", "1+2*x+4*y", 2, at="")
    t = meshes.box_mesh(spark, [0, 0], [1, 1], [4, 4])
    corner = F.array(*[F.array(F.col("x" + a), F.col("y" + b)) for a, b in (("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi"))])
    goal = with_h(t.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), corner.alias("vertices")), 2, 0.3)
    got = swarm_remap(s, goal, ["v"], 2, basis="linear", estimator="operator_regression", operator=particles.integral_operator(goal, 2, "linear")).join(t, "id")
    assert got.agg(F.max(F.abs(F.col("v") - F.col("vol") * (1 + 2 * F.col("cx") + 4 * F.col("cy"))))).first()[0] < 1e-9


def test_facets_of_boxes(spark):
    m = meshes.box_mesh(spark, [0, 0], [1, 1], [2, 2])
    p = particles.facets_of_cells(m, particles.box_faces(m, [2, 2]), 2, factor=1.5, boundary_factor=0.5)
    r = p.where("id = 0").first()
    assert (r.x, r.y, r.hx, r.hy) == (0.25, 0.25, 1.5, 1.5)
    assert sorted(map(tuple, r.facets)) == [(-1.0, 0.0, 0.25), (0.0, -1.0, 0.25), (0.0, 1.0, 0.75), (1.0, 0.0, 0.75)]


def test_faceted_parts_follow_the_last_support(spark):
    m = meshes.box_mesh(spark, [0, 0], [1, 1], [4, 1])
    s = particles.facets_of_cells(m, particles.box_faces(m, [4, 1]), 2).join(m.select("id", F.when(F.col("cx") < 0.5, 1.0).otherwise(2.0).alias("part"), F.col("cx").alias("v")), "id")
    t = m.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    got = swarm_remap(s, t, ["part"], 2, kernel="step", geometry="faceted", center="scatter", part="part", part_tolerance=0.5)
    assert {r.part for r in got.collect()} <= {1.0, 2.0}


def test_constants_through_particles(spark):
    s = meshes.box_mesh(spark, [0, 0], [1, 1], [10, 10]).withColumn("v", F.lit(3.0))
    got = mesh_swarm_mesh(s, meshes.box_mesh(spark, [0, 0], [1, 1], [7, 7]), ["v"], 2)
    assert {round(r.v, 12) for r in got.collect()} == {3.0}


def test_wrong_choices_are_refused(spark):
    s = with_h(swarms.random(spark, [0, 0], [1, 1], 5), 2, 0.1)
    with pytest.raises(ValueError):
        swarm_remap(s, s, [], 2, geometry="faceted")
    with pytest.raises(ValueError):
        swarm_remap(s, s, [], 2, part="p")


@pytest.mark.parametrize("center", ["gather", "scatter"])
def test_particles_of_any_kernel_in_one_swarm(spark, center):
    """Each particle's own kernel and geometry gives what the runs with one kernel give for it."""
    s = with_h(swarms.cartesian(spark, [0, 0], [1, 1], [7, 7], perturb=0.2), 2, 0.2).withColumn("v", F.col("x") + 2 * F.col("y")).persist()
    t = with_h(swarms.cartesian(spark, [0.1, 0.1], [0.9, 0.9], [5, 5]), 2, 0.2)
    kinds = [("b4", "elliptic"), ("epanechnikov", "tensor"), ("polyramp", "faceted"), ("square", "elliptic"), ("step", "faceted")]
    facets = F.array(*[F.array(F.lit(a), F.lit(b), F.lit(0.15)) for a, b in ((-1.0, 0.0), (0.0, -1.0), (0.0, 1.0), (1.0, 0.0))])
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    give = lambda df: df.withColumns({"kernel": pick(0), "geometry": pick(1), "facets": facets})
    a, b = (give(t), s) if center == "gather" else (t, give(s))
    got = {(r.tgt_id, r.src_id): r.w for r in particles.pair_weights(a, b, 2, geometry="own", center=center).collect()}
    want = {}
    for i, (k, g) in enumerate(kinds):
        one = particles.pair_weights(*(x.where(f"id % {len(kinds)} = {i}") if x is (a if center == "gather" else b) else x for x in (a, b)), 2, kernel_name=k, geometry=g, center=center)
        want |= {(r.tgt_id, r.src_id): r.w for r in one.collect()}
    assert got == want
    assert len(got) > 100


def test_unnamed_kernels_have_defaults_and_unknown_ones_raise(spark):
    s = with_h(swarms.cartesian(spark, [0, 0], [1, 1], [5, 5]), 2, 0.3).withColumn("v", F.col("x"))
    t = with_h(swarms.cartesian(spark, [0.2, 0.2], [0.8, 0.8], [3, 3]), 2, 0.3)
    null = F.lit(None).cast("string")
    own = swarm_remap(s, t.withColumns({"kernel": null, "geometry": null}), ["v"], 2, basis="linear", geometry="own")
    assert {r.id: r.v for r in own.collect()} == pytest.approx({r.id: r.v for r in swarm_remap(s, t, ["v"], 2, basis="linear").collect()})
    with pytest.raises(Exception, match="no weight of kernel and geometry b4 faceted"):
        swarm_remap(s, t.withColumns({"kernel": F.lit("b4"), "geometry": F.lit("faceted")}), ["v"], 2, geometry="own").collect()


def test_facets_of_polygon_cells(spark):
    """Triangles and a pentagon: unit normals outward, h twice the distance to the face, the boundary factor on outer faces."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 1.0, 3.0), (4, 0.0, 2.0), (5, 4.0, 1.0)], "id long, x double, y double")
    cells = spark.createDataFrame([(0, [0, 1, 2, 3, 4]), (1, [1, 5, 2])], "id long, nodes array<long>")
    mesh = topology.polygon_cells(nodes, cells).persist()
    got = {r.id: r for r in particles.facets_of_cells(mesh, particles.polygon_faces(mesh), 2, factor=1.5, boundary_factor=0.5).collect()}
    assert [len(got[i].facets) for i in (0, 1)] == [5, 3]
    rings = {0: [(0, 0), (2, 0), (2, 2), (1, 3), (0, 2)], 1: [(2, 0), (4, 1), (2, 2)]}
    for i, r in got.items():
        for nx, ny, h in r.facets:
            assert nx * nx + ny * ny == pytest.approx(1)
            ends = max(nx * (x - r.x) + ny * (y - r.y) for x, y in rings[i])
            inner = (i, round(nx), round(ny)) in {(0, 1, 0), (1, -1, 0)} and abs(ny) < 1e-12
            assert h == pytest.approx(2 * ends * (1.5 if inner else 0.5))
    assert (got[0].hx, got[0].hy, got[1].hx) == (6.0, 9.0, 6.0)


def _crowd(spark, n, places, field=False):
    """Particles at few places of the unit square, with unlike values and ids."""
    df = spark.range(n).select("id", ((F.col("id") % places + 0.5) / places).alias("x"), (F.col("id") % 3 / 4.0).alias("y"), F.lit(0.2).alias("hx"), F.lit(0.2).alias("hy"))
    return df.withColumn("v", (F.col("id") * 7 % 11).cast("double")) if field else df


def _met(monkeypatch):
    """The number of pairs that each search makes."""
    made, real = [], search.point_pairs

    def counted(*args, **kwargs):
        made.append(real(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(search, "point_pairs", counted)
    monkeypatch.setattr(particles, "point_pairs", counted)
    return made


@pytest.mark.parametrize("center", ["gather", "scatter"])
@pytest.mark.parametrize(("estimator", "basis", "derivative"), [("kernel_density", "unitary", 0), ("local_regression", "unitary", 0), ("local_regression", "linear", 1)])
def test_particles_of_one_place_meet_others_as_one(spark, monkeypatch, center, estimator, basis, derivative):
    s, t = _crowd(spark, 900, 5, field=True).withColumn("x", F.when(F.col("id") == 8, None).otherwise(F.col("x"))), _crowd(spark, 400, 4).withColumn("x", F.when(F.col("id") == 7, None).otherwise(F.col("x")))
    made = _met(monkeypatch)
    got = {r.id: r.v for r in swarm_remap(s, t, ["v"], 2, center=center, estimator=estimator, basis=basis, derivative=derivative).collect()}
    assert made[0].count() <= 15 * 12  # 900 x 400 particles, but 15 x 12 places
    pairs = particles.pair_weights(t, s, 2, center=center)
    if estimator == "kernel_density":
        want = t.select("id").join(particles.density(pairs, s, ["v"]), "id", "left").fillna(0.0)
    elif basis == "unitary":
        want = particles.shepard_estimate(pairs, s, t, ["v"])
    else:
        want = particles.estimate(particles.local_regression(pairs, 2, basis), s, t, ["v"], derivative)
    want = {r.id: r.v for r in want.collect()}
    assert len(want) == 400 and any(want.values())
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("center", ["gather", "scatter"])
def test_few_places_are_too_few_neighbours_only_by_their_particles(spark, center):
    """The count of neighbours is that of particles, as in the SQL: three of one place are enough, two are not."""
    row = "id long, x double, y double, hx double, hy double, v double"
    t = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0)], row)
    for n, want in ((3, 5.0), (2, 0.0)):
        s = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 1.0, 5.0) for i in range(n)], row)
        assert swarm_remap(s, t, ["v"], 2, basis="linear", center=center).first().v == pytest.approx(want)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("center", ["gather", "scatter"])
def test_counts_of_pairs_are_those_of_places(spark, monkeypatch, center, closed):
    s, t = _crowd(spark, 900, 5), _crowd(spark, 400, 4)
    want = search.point_pairs(t, s, 2, center=center, closed=closed).groupBy("tgt_id").agg(F.count("*").alias("n"), F.sum("src_id").alias("total"))
    made = _met(monkeypatch)
    got = search.point_counts(t, s, 2, center=center, closed=closed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert made[0].count() <= 15 * 12


@pytest.mark.parametrize("name", ["search_points_gather", "search_points_bins", "search_points_scatter", "swarm_neighbours", "swarm_density", "swarm_mixed_kernels"])
def test_pairs_of_queries_stay_when_customers_repeat(spark, monkeypatch, tmp_path, name):
    made, results = _met(monkeypatch), []
    for times in (1, 4):
        for table, p, n in (("customer", "c_cust", 150), ("supplier", "s_supp", 12)):
            rows = spark.range(n * times).select((F.col("id") % n + F.floor(F.col("id") / n) * 192).alias(f"{p}key"), (F.col("id") % n * 37 % 1009 * 1.0).alias(f"{p[:1]}_acctbal"))
            rows.write.parquet(f"{tmp_path}/{times}/{table}.parquet")
        made.clear()
        assert catalog.QUERIES[name](spark, f"{tmp_path}/{times}").count()
        results.append(made[0].count())
    assert results[0] == results[1] > 0
