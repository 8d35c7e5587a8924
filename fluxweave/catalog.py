"""Registered queries of the remap engine, each with its SQL where SQL can express it.

Grids come from lineitem, intervals from events, swarms from customer and supplier; results are rounded to six
decimals because sums of doubles depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .operators import gradient, interpolate, intersect, materials, momentum, particles, repair, search, swept
from .plans import oracle as q
from .plans.multi import MultiRemapper, Side
from .plans.remap import Options, Remapper, mesh_swarm_mesh, remap, swarm_remap
from .plans.storage import materialize
from .sources import meshes, tables, topology

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

N, M = 16, 12
OFFSET = ((0.2, 0.2), (1.2, 1.2))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _shifted(df: DataFrame, *values: str, digits: int = 4, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rounded after a shift of 0.3 of the last digit: binary fractions can be exact halves, but not shifted ones."""
    return df.select(*keys, *[F.round(F.col(v) + float(f"3e-{digits + 1}"), digits).alias(v) for v in values])


def _rounded(df: DataFrame, *values: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return df.select(*keys, *[_r(F.col(v)).alias(v) for v in values])


def _source(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return tables.lineitem_grid(spark, sf_dir, n)


def _target(spark: SparkSession, box=((0, 0), (1, 1))) -> DataFrame:
    return meshes.box_mesh(spark, list(box[0]), list(box[1]), [M, M])


def _near(mesh: DataFrame, n: int, kind: str = "node") -> DataFrame:
    return meshes.box_adjacency(mesh, [n, n], kind)


S, T, W = q.source(N), q.grid("t", M), q.weights()
T_OFF = q.grid("t", M, *OFFSET)


# ---- sources ----


@query(f"WITH {S} SELECT id, ix::BIGINT AS ix, iy::BIGINT AS iy, {q.r('vol')} AS vol, {q.r('cx')} AS cx, {q.r('cy')} AS cy, edge AS is_boundary, qty, price FROM s")
def mesh_with_fields(spark, sf_dir):
    return _rounded(_source(spark, sf_dir), "vol", "cx", "cy", keys=("id", "ix", "iy", "is_boundary", "qty", "price"))


@query(f"WITH {T} SELECT id, {q.r('CASE WHEN sqrt(cx*cx + cy*cy) < 0.7::DOUBLE THEN 100.0 ELSE 9 * pow(cx, 2) + 1600 * pow(cy, 2) END')} AS f FROM t")
def analytic_field(spark, sf_dir):
    return _rounded(meshes.with_field(_target(spark), "f", "if (sqrt(x*x + y*y) < 0.7) 100; else 9*x^2 + 1600*y^2;", 2), "f")


@query(f"""WITH {q.grid("s", N)} SELECT c.id, n.id AS nbr FROM s c JOIN s n ON abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1 AND n.id <> c.id""")
def node_adjacency(spark, sf_dir):
    return _near(meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), N)


@query(f"""WITH {q.grid("s", N)} SELECT c.id, n.id AS nbr FROM s c JOIN s n ON abs(n.ix - c.ix) + abs(n.iy - c.iy) = 1""")
def face_adjacency(spark, sf_dir):
    return _near(meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), N, "face")


# ---- search ----

_COUNT = "SELECT tgt_id, count(*) AS n, sum(src_id)::BIGINT AS total FROM p GROUP BY tgt_id"


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tgt_id").agg(F.count("*").alias("n"), F.sum("src_id").alias("total"))


def _meets(op: str) -> str:
    return f"p AS (SELECT t.id AS tgt_id, s.id AS src_id FROM t JOIN s ON greatest(t.xlo, s.xlo) {op} least(t.xhi, s.xhi) AND greatest(t.ylo, s.ylo) {op} least(t.yhi, s.yhi))"


@query(f"WITH {q.grid('s', 16)}, {q.grid('t', 8)}, {_meets('<=')} {_COUNT}")
def search_boxes_closed(spark, sf_dir):
    return _counted(search.box_pairs(meshes.box_mesh(spark, [0, 0], [1, 1], [8, 8]), meshes.box_mesh(spark, [0, 0], [1, 1], [16, 16]), 2))


@query(f"WITH {q.grid('s', 16)}, {q.grid('t', 8)}, {_meets('<')} {_COUNT}")
def search_boxes_strict(spark, sf_dir):
    return _counted(search.box_pairs(meshes.box_mesh(spark, [0, 0], [1, 1], [8, 8]), meshes.box_mesh(spark, [0, 0], [1, 1], [16, 16]), 2, closed=False))


@query(f"WITH {q.grid('s', 16)}, {q.grid('t', 8, *OFFSET)}, {_meets('<')} {_COUNT}")
def search_direct_product(spark, sf_dir):
    axis = [k / 16 for k in range(17)]
    return _counted(search.direct_product_pairs(meshes.box_mesh(spark, [0.2, 0.2], [1.2, 1.2], [8, 8]), [axis, axis]))


@query(f"WITH {q.customers(0.0)}, {q.grid('s', N)} SELECT cu.id AS point_id, s.id FROM cu JOIN s ON x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi")
def locate_points(spark, sf_dir):
    return search.locate_points(tables.customer_swarm(spark, sf_dir, 0.0).select("id", "x", "y"), meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), 2)


@query(f"WITH {q.grid('s', N)}, p AS (SELECT c.id AS tgt_id, n.id AS src_id FROM s c JOIN s n ON abs(n.ix - c.ix) + abs(n.iy - c.iy) <= 1) {_COUNT}")
def search_swept_faces(spark, sf_dir):
    mesh = meshes.box_mesh(spark, [0, 0], [1, 1], [N, N])
    return _counted(search.adjacent_pairs(_near(mesh, N, "face"), mesh))


def _near_points(side: str, op: str, k: str = "2") -> str:
    return f"p AS (SELECT su.id AS tgt_id, cu.id AS src_id FROM su JOIN cu ON abs(su.x - cu.x) {op} {k} * {side}.h AND abs(su.y - cu.y) {op} {k} * {side}.h)"


@query(f"WITH {q.customers(0.03125)}, {q.suppliers(0.0625)}, {_near_points('su', '<')} {_COUNT}")
def search_points_gather(spark, sf_dir):
    return search.point_counts(tables.supplier_swarm(spark, sf_dir, 0.0625), tables.customer_swarm(spark, sf_dir, 0.03125), 2)


@query(f"WITH {q.customers(0.03125)}, {q.suppliers(0.0625)}, {_near_points('cu', '<')} {_COUNT}")
def search_points_scatter(spark, sf_dir):
    return search.point_counts(tables.supplier_swarm(spark, sf_dir, 0.0625), tables.customer_swarm(spark, sf_dir, 0.03125), 2, center="scatter")


@query(f"WITH {q.customers(0.03125)}, {q.suppliers(0.0625)}, {_near_points('su', '<=')} {_COUNT}")
def search_points_bins(spark, sf_dir):
    return search.point_counts(tables.supplier_swarm(spark, sf_dir, 0.0625), tables.customer_swarm(spark, sf_dir, 0.03125), 2, closed=True)


# ---- intersect ----

#: These moments are multiples of 2**-13 / 27: thirteen digits hold the dyadic ones exactly, so none is a tie.
_WEIGHTS = f"WITH {q.grid('s', N)}, {T}, {W} SELECT tgt_id, src_id, round(m0, 13) AS m0, round(m1x, 13) AS m1x, round(m1y, 13) AS m1y FROM w WHERE m0 > 1e-12"


def _shown(w: DataFrame, digits: int = 11) -> DataFrame:
    return w.where("m0 > 1e-12").select("tgt_id", "src_id", *[F.round(c, digits).alias(c) for c in w.columns if c.startswith("m")])


@query(_WEIGHTS)
def intersect_boxes(spark, sf_dir):
    return _shown(intersect.intersect_boxes(_target(spark), meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), 2), 13)


@query(_WEIGHTS)
def intersect_polygons(spark, sf_dir):
    return _shown(intersect.intersect_polygons(meshes.box_rings(_target(spark)), meshes.box_rings(meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]))), 13)


@query(
    f"""WITH {q.grid("s", 4)}, {q.grid("t", 3)}, {W}, z AS (SELECT a.k AS tk, b.k AS sk, greatest(a.k / 3::DOUBLE, b.k / 4::DOUBLE) AS lo, least((a.k + 1) / 3::DOUBLE, (b.k + 1) / 4::DOUBLE) AS hi
    FROM (SELECT unnest(range(3)) AS k) a, (SELECT unnest(range(4)) AS k) b)
    SELECT tgt_id + 9 * tk AS tgt_id, src_id + 16 * sk AS src_id, round(m0 * (hi - lo), 11) AS m0, round(m1x * (hi - lo), 11) AS m1x, round(m1y * (hi - lo), 11) AS m1y, round(m0 * (hi - lo) * (hi + lo) / 2, 11) AS m1z
    FROM w, z WHERE hi - lo > 1e-9 AND m0 > 1e-12"""
)
def intersect_polyhedra(spark, sf_dir):
    def solid(n):
        return meshes.box_solids(meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [n, n, n]))

    return _shown(intersect.intersect_polyhedral_meshes(solid(3), solid(4)))


@query(
    f"""WITH {q.grid("s", N)}, {T}, x AS (SELECT t.id AS tgt_id, s.id AS src_id, greatest(t.xlo, s.xlo) AS a, least(t.xhi, s.xhi) AS b, greatest(t.ylo, s.ylo) AS c, least(t.yhi, s.yhi) AS d
    FROM t JOIN s ON greatest(t.xlo, s.xlo) < least(t.xhi, s.xhi) AND greatest(t.ylo, s.ylo) < least(t.yhi, s.yhi))
    SELECT tgt_id, src_id, round(2 * pi() * (b * b - a * a) / 2 * (d - c), 11) AS m0, round(2 * pi() * (pow(b, 3) - pow(a, 3)) / 3 * (d - c), 11) AS m1x, round(2 * pi() * (b * b - a * a) / 2 * (d * d - c * c) / 2, 11) AS m1y
    FROM x WHERE 2 * pi() * (b * b - a * a) / 2 * (d - c) > 1e-12"""
)
def intersect_axisymmetric(spark, sf_dir):
    return _shown(intersect.intersect_boxes(_target(spark), meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), 2, system="cylindrical_axisymmetric"))


@query(f"WITH {q.grid('s', N)}, {T}, {W} SELECT src_id, count(*) AS n, {q.r('sum(m0)')} AS covered FROM w WHERE m0 > 1e-12 GROUP BY src_id")
def reverse_weights(spark, sf_dir):
    w = intersect.intersect_boxes(_target(spark), meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), 2).where("m0 > 1e-12")
    back = intersect.reverse_weights(w)
    return back.select("src_id", F.size("targets").cast("long").alias("n"), _r(F.aggregate("targets", F.lit(0.0), lambda s, x: s + x["m0"])).alias("covered"))


# ---- gradients ----


@query(f"WITH {S}, {q.gradients(['price', 'qty'], False)} SELECT id, {q.r('gx_price')} AS g_price_x, {q.r('gy_price')} AS g_price_y, {q.r('gx_qty')} AS g_qty_x, {q.r('gy_qty')} AS g_qty_y FROM g")
def gradients_unlimited(spark, sf_dir):
    s = _source(spark, sf_dir)
    return _rounded(gradient.gradients(s, _near(s, N), ["price", "qty"], 2), "g_price_x", "g_price_y", "g_qty_x", "g_qty_y")


@query(f"WITH {S}, {q.gradients(['price'], True)} SELECT id, {q.r('gx_price')} AS g_price_x, {q.r('gy_price')} AS g_price_y FROM g")
def gradients_limited(spark, sf_dir):
    s = _source(spark, sf_dir)
    return _rounded(gradient.gradients(s, _near(s, N), ["price"], 2, limiter="barth_jespersen"), "g_price_x", "g_price_y")


def _at_boundary(spark, sf_dir, rule: str) -> DataFrame:
    s = _source(spark, sf_dir)
    return _rounded(gradient.gradients(s, _near(s, N), ["price"], 2, limiter="barth_jespersen", boundary_limiter=rule), "g_price_x", "g_price_y")


@query(f"WITH {S}, {q.gradients(['price'], True, edge='0.0')} SELECT id, {q.r('gx_price')} AS g_price_x, {q.r('gy_price')} AS g_price_y FROM g")
def gradients_zero_at_boundary(spark, sf_dir):
    return _at_boundary(spark, sf_dir, "bnd_zero_gradient")


@query(f"WITH {S}, {q.gradients(['price'], True, edge='')} SELECT id, {q.r('gx_price')} AS g_price_x, {q.r('gy_price')} AS g_price_y FROM g")
def gradients_limited_at_boundary(spark, sf_dir):
    return _at_boundary(spark, sf_dir, "bnd_barth_jespersen")


_FIT = ", ".join(f"(round({c}, 3) + 0.0)" for c in ("gx", "gy", "hxx", "hxy", "hyy"))


@query(f"WITH {S}, {q.quadratics('price')} SELECT id, [{_FIT}] AS q FROM f")
def quadratic_fit(spark, sf_dir):
    s = _source(spark, sf_dir)
    return gradient.quadratic_fit(s, _near(s, N), "price", 2).select("id", F.transform("q", lambda v: F.round(v, 3) + F.lit(0.0)).alias("q"))


# ---- interpolate ----


@query(f"WITH {S}, {T}, {W}, {q.first_order(['price', 'qty'])} SELECT id, {q.r('price')} AS price, {q.r('qty')} AS qty FROM o")
def remap_2d_order1(spark, sf_dir):
    return _rounded(remap(_source(spark, sf_dir), _target(spark), ["price", "qty"], 2, options=Options(order=1, check_mismatch=False)), "price", "qty")


def _order2(spark, sf_dir, limiter, fields, **more):
    s = _source(spark, sf_dir)
    return _rounded(remap(s, _target(spark), fields, 2, source_adjacency=_near(s, N), options=Options(limiter=limiter, check_mismatch=False), **more), *fields)


@query(f"WITH {S}, {T}, {W}, {q.gradients(['price', 'qty'], False)}, {q.second_order(['price', 'qty'])} SELECT id, {q.r('price')} AS price, {q.r('qty')} AS qty FROM o")
def remap_2d_order2(spark, sf_dir):
    return _order2(spark, sf_dir, "nolimiter", ["price", "qty"])


@query(f"WITH {S}, {T}, {W}, {q.gradients(['price', 'qty'], True)}, {q.second_order(['price', 'qty'])} SELECT id, {q.r('price')} AS price, {q.r('qty')} AS qty FROM o")
def remap_2d_order2_limited(spark, sf_dir):
    return _order2(spark, sf_dir, "barth_jespersen", ["price", "qty"])


@query(
    f"""WITH {S}, {T}, {W}, {q.quadratics("price")}, d AS (SELECT tgt_id, src_id, m0, m1x / m0 - cx AS dx, m1y / m0 - cy AS dy, price FROM w JOIN s ON s.id = src_id WHERE m0 > 2.220446049250313e-16),
    v AS (SELECT tgt_id, sum(m0 * (price + gx * dx + gy * dy + hxx * dx * dx + hxy * dx * dy + hyy * dy * dy)) AS m FROM d JOIN f ON f.id = src_id GROUP BY tgt_id)
    SELECT t.id, {q.shifted('coalesce(m / vol, 0.0)')} AS price FROM t LEFT JOIN v ON tgt_id = t.id"""
)
def remap_2d_order3(spark, sf_dir):
    s = _source(spark, sf_dir)
    return _shifted(remap(s, _target(spark), ["price"], 2, source_adjacency=_near(s, N), options=Options(order=3, limiter="nolimiter", check_mismatch=False)), "price")


@query(
    """WITH d AS (SELECT floor(epoch_us(ts) / 86400000000)::BIGINT AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1),
    b AS (SELECT min(day) AS lo, max(day) + 1 AS hi FROM d),
    t AS (SELECT k AS id, lo + 1.5::DOUBLE * k AS xlo, lo + 1.5::DOUBLE * (k + 1) AS xhi FROM b, LATERAL (SELECT unnest(range(ceil((hi - lo) / 1.5)::BIGINT)) AS k)),
    v AS (SELECT t.id, sum(n * (least(xhi, day + 1.0) - greatest(xlo, day))) / sum(least(xhi, day + 1.0) - greatest(xlo, day)) AS n FROM t JOIN d ON greatest(xlo, day::DOUBLE) < least(xhi, day + 1.0::DOUBLE) GROUP BY t.id)
    SELECT t.id, (round(coalesce(n, 0.0), 6) + 0.0) AS n FROM t LEFT JOIN v USING (id)"""
)
def remap_1d_events(spark, sf_dir):
    days = tables.event_days(spark, sf_dir)
    lo, hi = days.agg(F.min("xlo"), F.max("xhi")).first()
    import math

    k = math.ceil((hi - lo) / 1.5)
    target = meshes.box_mesh(spark, [lo], [lo + 1.5 * k], [k])
    return _rounded(remap(days, target, ["n"], 1, options=Options(order=1, check_mismatch=False)), "n")


@query(
    f"""WITH {q.grid("s", 8)}, {q.grid("t", 6)}, {q.weights()}, sz AS (SELECT unnest(range(8)) AS k), tz AS (SELECT unnest(range(6)) AS k),
    z AS (SELECT tz.k AS tk, sz.k AS sk, least((tz.k + 1) / 6::DOUBLE, (sz.k + 1) / 8::DOUBLE) - greatest(tz.k / 6::DOUBLE, sz.k / 8::DOUBLE) AS h FROM tz, sz),
    v AS (SELECT tgt_id + 36 * tk AS id, sum(((src_id * 7 + sk * 3) % 11) * m0 * h) / sum(m0 * h) AS f FROM w, z WHERE h > 1e-9 GROUP BY 1) SELECT id, {q.r("f")} AS f FROM v"""
)
def remap_3d_order1(spark, sf_dir):
    s = meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [8, 8, 8])
    s = s.withColumn("f", (((F.col("ix") + 8 * F.col("iy")) * 7 + F.col("iz") * 3) % 11).cast("double"))
    return _rounded(remap(s, meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [6, 6, 6]), ["f"], 3, options=Options(order=1, check_mismatch=False)), "f")


@query(
    f"""WITH {S}, n0 AS (SELECT id, id % {N + 1} AS ix, id // {N + 1} AS iy FROM (SELECT unnest(range({(N + 1) ** 2})) AS id)),
    ns AS (SELECT id, greatest(ix / {N}::DOUBLE - 0.5 / {N}, 0.0) AS xlo, least(ix / {N}::DOUBLE + 0.5 / {N}, 1.0) AS xhi, greatest(iy / {N}::DOUBLE - 0.5 / {N}, 0.0) AS ylo, least(iy / {N}::DOUBLE + 0.5 / {N}, 1.0) AS yhi, ((ix * 5 + iy * 3) % 17)::DOUBLE AS f FROM n0),
    m0 AS (SELECT id, id % {M + 1} AS ix, id // {M + 1} AS iy FROM (SELECT unnest(range({(M + 1) ** 2})) AS id)),
    nt AS (SELECT id, greatest(ix / {M}::DOUBLE - 0.5 / {M}, 0.0) AS xlo, least(ix / {M}::DOUBLE + 0.5 / {M}, 1.0) AS xhi, greatest(iy / {M}::DOUBLE - 0.5 / {M}, 0.0) AS ylo, least(iy / {M}::DOUBLE + 0.5 / {M}, 1.0) AS yhi FROM m0),
    {q.weights(t="nt", s="ns")} SELECT tgt_id AS id, {q.r("sum(f * m0) / sum(m0)")} AS f FROM w JOIN ns ON ns.id = src_id GROUP BY tgt_id"""
)
def remap_nodes(spark, sf_dir):
    s = meshes.node_mesh(spark, [0, 0], [1, 1], [N, N]).withColumn("f", ((F.col("ix") * 5 + F.col("iy") * 3) % 17).cast("double"))
    return _rounded(remap(s, meshes.node_mesh(spark, [0, 0], [1, 1], [M, M]), ["f"], 2, ref="p", options=Options(order=1, check_mismatch=False)), "f")


def _node_grid(name: str, n: int) -> str:
    """Cells around the nodes of a grid, with the nodes as their reference points."""
    return f"""{name} AS (SELECT id, ix, iy, ix / {n}::DOUBLE AS cx, iy / {n}::DOUBLE AS cy, greatest(ix / {n}::DOUBLE - 0.5 / {n}, 0.0) AS xlo, least(ix / {n}::DOUBLE + 0.5 / {n}, 1.0) AS xhi,
      greatest(iy / {n}::DOUBLE - 0.5 / {n}, 0.0) AS ylo, least(iy / {n}::DOUBLE + 0.5 / {n}, 1.0) AS yhi, false AS edge, ((ix * 5 + iy * 3) % 17)::DOUBLE AS f
      FROM (SELECT id, id % {n + 1} AS ix, id // {n + 1} AS iy FROM (SELECT unnest(range({(n + 1) ** 2})) AS id)))"""


@query(f"WITH {_node_grid('ns', N)}, {_node_grid('nt', M)}, {q.weights(t='nt', s='ns')}, {q.gradients(['f'], False, 'ns')}, {q.second_order(['f'], s='ns', t='nt')} SELECT id, {q.shifted('f', 6)} AS f FROM o")
def remap_nodes_order2(spark, sf_dir):
    s = meshes.node_mesh(spark, [0, 0], [1, 1], [N, N]).withColumn("f", ((F.col("ix") * 5 + F.col("iy") * 3) % 17).cast("double"))
    o = Options(order=2, limiter="nolimiter", check_mismatch=False)
    return _shifted(remap(s, meshes.node_mesh(spark, [0, 0], [1, 1], [M, M]), ["f"], 2, ref="p", source_adjacency=meshes.box_adjacency(s, [N + 1, N + 1]), options=o), "f", digits=6)


_MAP = [[1.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.1, 0.0, 1.0]]


def _blocks_sql() -> str:
    at = lambda c, k: f"least(floor({c} * {k}), {k} - 1)"
    grid = lambda t, k: f"{t} AS (SELECT id, id % k AS ix, id // k % k AS iy, id // (k * k) AS iz, 1.0::DOUBLE / k AS h, k FROM (SELECT {k} AS k, unnest(range({k} * {k} * {k})) AS id FROM z))"
    d = {a: f"(n.i{a} - c.i{a}) * c.h" for a in "xyz"}
    sums = ", ".join([f"sum({d[a]} * {d[b]}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")] + [f"sum({d[a]} * (n.v - c.v)) AS b{a}" for a in "xz"] + [f"sum({d['y']} * (n.v - c.v)) AS b_y"])
    top = {"x": "bx * c0 + b_y * c1 + bz * c2", "y": "bx * c1 + b_y * c3 + bz * c4", "z": "bx * c2 + b_y * c4 + bz * c5"}
    slope = lambda u, v, w: f"(gx * {u} + gy * {v} + gz * {w}) * h / 2"
    each = [slope(u, v, w) for u in (-1, 1) for v in (-1, 1) for w in (-1, 1)]
    phi = ", ".join(f"CASE WHEN {e} = 0 THEN 1.0 WHEN {e} > 0 THEN (hi - v) / ({e}) ELSE (lo - v) / ({e}) END" for e in each)
    lo, hi = (lambda a: f"greatest(t.i{a} * t.h, s.i{a} * s.h)"), (lambda a: f"least((t.i{a} + 1) * t.h, (s.i{a} + 1) * s.h)")
    meet = " AND ".join(f"t.i{a} * s.k < (s.i{a} + 1) * t.k AND s.i{a} * t.k < (t.i{a} + 1) * s.k" for a in "xyz")
    return f"""z AS (SELECT greatest(3, floor(pow(count(*) / 256.0, 1 / 3.0::DOUBLE)))::BIGINT AS n, greatest(2, floor(pow(count(*) / 256.0, 1 / 3.0::DOUBLE) * 0.75::DOUBLE))::BIGINT AS m FROM lineitem),
    {grid('s0', 'n')}, {grid('t', 'm')},
    sv AS (SELECT ({at('(l_quantity - 1) / 49', 'n')} + {at('l_discount / 0.1::DOUBLE', 'n')} * n + {at('l_tax / 0.08::DOUBLE', 'n')} * n * n)::BIGINT AS id, floor(avg(l_extendedprice))::DOUBLE AS v FROM lineitem, z GROUP BY 1),
    s AS (SELECT s0.*, coalesce(v, 0.0) AS v, least(ix, iy, iz) = 0 OR greatest(ix, iy, iz) = k - 1 AS edge FROM s0 LEFT JOIN sv USING (id)),
    gs AS (SELECT c.id, {sums}, least(min(n.v), min(c.v)) AS lo, greatest(max(n.v), max(c.v)) AS hi FROM s c JOIN s n ON abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1 AND abs(n.iz - c.iz) <= 1 AND n.id <> c.id GROUP BY c.id),
    cf AS (SELECT id, lo, hi, bx, b_y, bz, xx, xy, xz, yy * zz - yz * yz AS c0, xz * yz - xy * zz AS c1, xy * yz - xz * yy AS c2, xx * zz - xz * xz AS c3, xy * xz - xx * yz AS c4, xx * yy - xy * xy AS c5 FROM gs),
    gr AS (SELECT id, lo, hi, {', '.join(f'({top[a]}) / (xx * c0 + xy * c1 + xz * c2) AS g{a}' for a in 'xyz')} FROM cf),
    g AS (SELECT s.*, gx, gy, gz, CASE WHEN edge THEN 1.0 ELSE least(1.0, {phi}) END AS phi FROM s JOIN gr USING (id)),
    w AS (SELECT t.id, s.v, s.phi * (gx * (ox - (s.ix + 0.5) * s.h) + gy * (oy - (s.iy + 0.5) * s.h) + gz * (oz - (s.iz + 0.5) * s.h)) AS more, m0, ox, oy, oz FROM (
      SELECT t.id, s.id AS src, {' * '.join(f'({hi(a)} - {lo(a)})' for a in 'xyz')} AS m0, {', '.join(f'({hi(a)} + {lo(a)}) / 2 AS o{a}' for a in 'xyz')} FROM t JOIN s ON {meet}) t JOIN g s ON s.id = src)"""


@query(f"""WITH {_blocks_sql()} SELECT id, count(*) AS n, {q.shifted('sum(m0 * v) / sum(m0)', 3)} AS price, {q.shifted('sum(m0 * (v + more)) / sum(m0)', 3)} AS limited, {q.shifted('sum(m0 * (ox + 0.3::DOUBLE * oy)) / sum(m0)', 8)} AS cx FROM w GROUP BY id""")
def remap_polyhedra(spark, sf_dir):
    """Polyhedra that no axis is parallel to, first and second order: the cells of lineitem's cube under a linear map, which
    leaves shares of volume and limited lines as they are."""
    rows = tables.table(spark, sf_dir, "lineitem").count()
    n, m = max(3, math.floor(math.pow(rows / 256, 1 / 3))), max(2, math.floor(math.pow(rows / 256, 1 / 3) * 0.75))
    boxes = materialize(tables.lineitem_blocks(spark, sf_dir, n))
    s = materialize(meshes.mapped_solids(meshes.box_solids(boxes), _MAP))
    t = meshes.mapped_solids(meshes.box_solids(meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [m, m, m])), _MAP)
    r = Remapper(s, t, 3, source_adjacency=meshes.box_adjacency(boxes, [n, n, n]), options=Options(check_mismatch=False))
    first, second = r.interpolate(["price"], Options(order=1, check_mismatch=False)), r.interpolate({"price": "limited"})
    w = r.weights().where("m0 > 1e-14").groupBy(F.col("tgt_id").alias("id")).agg(F.count("*").alias("n"), (F.sum("m1x") / F.sum("m0")).alias("cx"))
    both = first.join(second, "id").join(w, "id")
    return _shifted(both, "price", "limited", digits=3, keys=("id", "n", "cx")).withColumn("cx", F.round(F.col("cx") + 3e-9, 8))


@query(f"""WITH {_blocks_sql()}, cuts AS (SELECT 1 AS mat, 0.0 AS a0, 0.40625 AS a1, 0.0 AS b0, 1.0 AS b1 UNION ALL SELECT 2, 0.40625, 1.0, 0.59375, 1.0 UNION ALL SELECT 3, 0.40625, 1.0, 0.0, 0.59375),
    p AS (SELECT s.*, mat, greatest(ix * h, a0) AS px0, least((ix + 1) * h, a1) AS px1, greatest(iz * h, b0) AS pz0, least((iz + 1) * h, b1) AS pz1 FROM s, cuts WHERE greatest(ix * h, a0) < least((ix + 1) * h, a1) AND greatest(iz * h, b0) < least((iz + 1) * h, b1)),
    o AS (SELECT t.id, t.h AS th, p.mat, p.v + 1000 * p.mat AS f, (least((t.ix + 1) * t.h, px1) - greatest(t.ix * t.h, px0)) * (least((t.iy + 1) * t.h, (p.iy + 1) * p.h) - greatest(t.iy * t.h, p.iy * p.h)) * (least((t.iz + 1) * t.h, pz1) - greatest(t.iz * t.h, pz0)) AS m0
      FROM t JOIN p ON greatest(t.ix * t.h, px0) < least((t.ix + 1) * t.h, px1) AND t.iy * p.k < (p.iy + 1) * t.k AND p.iy * t.k < (t.iy + 1) * p.k AND greatest(t.iz * t.h, pz0) < least((t.iz + 1) * t.h, pz1))
    SELECT id, mat, {q.shifted('sum(m0) / any_value(th * th * th)', 8)} AS volfrac, {q.shifted('sum(m0 * f) / sum(m0)', 3)} AS value FROM o GROUP BY id, mat HAVING sum(m0) > 1e-14""")
def remap_multimaterial_3d(spark, sf_dir):
    """Three materials with plane borders in slanted cells: polyhedral pieces onto another such mesh."""
    rows = tables.table(spark, sf_dir, "lineitem").count()
    n, m = max(3, math.floor(math.pow(rows / 256, 1 / 3))), max(2, math.floor(math.pow(rows / 256, 1 / 3) * 0.75))
    boxes = materialize(tables.lineitem_blocks(spark, sf_dir, n))
    s = materialize(meshes.mapped_solids(meshes.box_solids(boxes), _MAP))
    t = materialize(meshes.mapped_solids(meshes.box_solids(meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [m, m, m])), _MAP))
    det = 1.006  # of _MAP; the rows of its inverse are the normals of x = a and z = b
    x, z = [1 / det, -0.3 / det, 0.06 / det], [-0.1 / det, 0.03 / det, 1 / det]
    back = lambda v: [-c for c in v]
    a, b = 0.40625, 0.59375
    pieces = materialize(materials.half_space_polyhedra(s, [(1, [(*back(x), -a)]), (2, [(*x, a), (*z, b)]), (3, [(*x, a), (*back(z), -b)])]))
    held = materials.piece_centroids(pieces).join(s.select("id", "vol", "price"), "id").select("id", "mat", (F.col("volume") / F.col("vol")).alias("volfrac"), (F.col("price") + 1000 * F.col("mat")).alias("f"))
    r = MultiRemapper(Side(s, meshes.box_adjacency(boxes, [n, n, n])), Side(t), 3, material=held, pieces=pieces, options=Options(order=1, check_mismatch=False))
    got = r.interpolate(material=["f"])["material"].where("volfrac > 1e-12").withColumnRenamed("f", "value")
    return _shifted(got, "value", digits=3, keys=("id", "mat", "volfrac")).withColumn("volfrac", F.round(F.col("volfrac") + 3e-9, 8))


def _polygons(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, polygon mesh) of source and target: one source cell for each 256 rows of lineitem."""
    rows = tables.table(spark, sf_dir, "lineitem").count()
    n, m = max(4, math.floor(math.sqrt(rows / 256))), max(3, math.floor(math.sqrt(rows / 256) * 0.75))
    made = (tables.lineitem_polygons(spark, sf_dir, k) for k in (n, m))
    return [(nodes := materialize(a), materialize(topology.polygon_cells(nodes, materialize(b)))) for a, b in made]


def _node_remapper(spark: SparkSession, sf_dir: str, options: Options) -> Remapper:
    (nodes, source), (_, target) = _polygons(spark, sf_dir)
    values = topology.dual_cells(source).join(nodes.select("id", "v"), "id")
    return Remapper(values, topology.dual_cells(target), 2, source_adjacency=topology.node_neighbours(source), ref="p", options=options)


_POLYGONS = f"{q.polygon_sizes()}, {q.polygon_mesh('s', 'n')}, {q.polygon_mesh('t', 'm')}"


@query(f"""WITH {q.polygon_sizes()}, {q.polygon_mesh('s', 'n')}, {q.duals('s')}, near AS (SELECT a.node, count(DISTINCT b.node) - 1 AS n_near FROM s_wedge a JOIN s_wedge b USING (cell) GROUP BY a.node)
    SELECT d.id, edge AS is_boundary, n_near, {q.shifted('vol', 9)} AS vol, {q.shifted('cx', 8)} AS cx, {q.shifted('cy', 8)} AS cy FROM s_dual d JOIN s_node n USING (id) JOIN near ON near.node = d.id""")
def polygon_duals(spark, sf_dir):
    """Cells around the nodes of a polygon mesh, and how many nodes share a cell with each."""
    (_, source), _ = _polygons(spark, sf_dir)
    near = topology.node_neighbours(source).groupBy("id").agg(F.count("*").alias("n_near"))
    d = topology.dual_cells(source).join(near, "id")
    vol, rest = _shifted(d, "vol", digits=9, keys=("id", "is_boundary", "n_near")), _shifted(d, "cx", "cy", digits=8)
    return vol.join(rest, "id")


@query(f"""WITH {q.polygon_sizes()}, {q.polygon_mesh('s', 'n')}
    SELECT least(na, nb) AS lo, greatest(na, nb) AS hi, count(*) AS n_cells, min(id) AS least_cell, {q.shifted('any_value(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))', 8)} AS length FROM s_side GROUP BY ALL""")
def polygon_faces(spark, sf_dir):
    (_, source), _ = _polygons(spark, sf_dir)
    f = topology.faces(source).withColumns({"n_cells": F.when(F.col("right").isNull(), 1).otherwise(2).cast("long"), "least_cell": F.least("left", "right")})
    return _shifted(f, "length", digits=8, keys=("lo", "hi", "n_cells", "least_cell"))


@query(f"""WITH {_POLYGONS}, {q.wedge_overlaps()} SELECT tgt_cell AS id, {q.shifted('sum(m0 * (src_cell % 17)) / sum(m0)', 7)} AS f FROM ov GROUP BY tgt_cell""")
def remap_polygon_cells(spark, sf_dir):
    (_, source), (_, target) = _polygons(spark, sf_dir)
    o = Options(order=1, check_mismatch=False)
    return _shifted(remap(source.withColumn("f", (F.col("id") % 17).cast("double")), target, ["f"], 2, options=o), "f", digits=7)


@query(f"""WITH {_POLYGONS}, {q.wedge_overlaps()} SELECT tgt_node AS id, {q.shifted('sum(m0 * v) / sum(m0)', 3)} AS v FROM ov JOIN s_node ON s_node.id = src_node GROUP BY tgt_node""")
def remap_polygon_nodes(spark, sf_dir):
    """Node fields between two polygon meshes with triangles and moved nodes, first order."""
    return _shifted(_node_remapper(spark, sf_dir, Options(order=1, check_mismatch=False)).interpolate(["v"]), "v", digits=3)


@query(f"""WITH {_POLYGONS}, {q.wedge_overlaps()}, {q.node_slopes()}, w AS (SELECT tgt_node AS id, src_node, sum(m0) AS m0, sum(m1x) AS m1x, sum(m1y) AS m1y FROM ov GROUP BY tgt_node, src_node)
    SELECT w.id, {q.shifted('sum(v * m0 + gx * (m1x - x * m0) + gy * (m1y - y * m0)) / sum(m0)', 3)} AS v FROM w JOIN g ON g.id = src_node GROUP BY w.id""")
def remap_polygon_nodes_limited(spark, sf_dir):
    """The same at second order with limited slopes."""
    return _shifted(_node_remapper(spark, sf_dir, Options(order=2, check_mismatch=False)).interpolate(["v"]), "v", digits=3)


_GROWING = """WITH z AS (SELECT greatest(4, floor(sqrt(count(*) / 64.0)))::BIGINT AS n, greatest(3, floor(sqrt(count(*) / 64.0) * 0.75::DOUBLE))::BIGINT AS m FROM lineitem),
    s0 AS (SELECT k AS id, k % n AS ix, k // n AS iy, n FROM (SELECT n, unnest(range(n * n)) AS k FROM z)), t0 AS (SELECT k AS id, k % m AS ix, k // m AS iy, m FROM (SELECT m, unnest(range(m * m)) AS k FROM z)),
    li AS (SELECT (least(floor((l_quantity - 1) / 49 * n), n - 1) + least(floor(l_discount / 0.1::DOUBLE * n), n - 1) * n)::BIGINT AS id, l_quantity FROM lineitem, z),
    sv AS (SELECT id, sum(l_quantity) AS qty FROM li GROUP BY id),
    w AS (SELECT t0.id, s0.id AS src, (least((t0.ix + 1) / m::DOUBLE, (s0.ix + 1) / n::DOUBLE) - greatest(t0.ix / m::DOUBLE, s0.ix / n::DOUBLE)) * (least((t0.iy + 1) / m::DOUBLE, (s0.iy + 1) / n::DOUBLE) - greatest(t0.iy / m::DOUBLE, s0.iy / n::DOUBLE)) AS m0
      FROM t0 JOIN s0 ON t0.ix * n < (s0.ix + 1) * m AND s0.ix * m < (t0.ix + 1) * n AND t0.iy * n < (s0.iy + 1) * m AND s0.iy * m < (t0.iy + 1) * n)"""


@query(f"{_GROWING} SELECT w.id, {q.shifted('sum(coalesce(qty, 0.0) * m0) / sum(m0)')} AS qty FROM w LEFT JOIN sv ON sv.id = src GROUP BY w.id")
def remap_growing_grid(spark, sf_dir):
    """Grids whose cells grow in number with the table: one source cell for each 64 rows."""
    import math

    rows = tables.table(spark, sf_dir, "lineitem").count()
    n, m = max(4, math.floor(math.sqrt(rows / 64))), max(3, math.floor(math.sqrt(rows / 64) * 0.75))
    target = meshes.box_mesh(spark, [0, 0], [1, 1], [m, m])
    return _shifted(remap(tables.lineitem_grid(spark, sf_dir, n), target, ["qty"], 2, options=Options(order=1, check_mismatch=False)), "qty")


@query(f"WITH {S}, {T}, {W}, {q.first_order(['price', 'qty'])} SELECT id, [{q.r('price')}, {q.r('qty')}] AS both FROM o")
def remap_array_field(spark, sf_dir):
    s = _source(spark, sf_dir).withColumn("both", F.array("price", "qty"))
    w = intersect.intersect_boxes(_target(spark), s, 2)
    return interpolate.first_order(w, s, _target(spark), ["both"]).select("id", F.transform("both", lambda v: _r(v)).alias("both"))


@query(
    f"""WITH {S}, {T}, {W}, {q.first_order(["price"])}, e AS (SELECT abs(o.price - 20000 * t.cx) AS e, o.price AS p, 20000 * t.cx AS x, t.vol FROM o JOIN t USING (id))
    SELECT {q.r("sum(e * vol)")} AS l1, {q.r("sqrt(sum(e * e * vol))")} AS l2, {q.r("max(e)")} AS linf, {q.r("sum(p * vol)")} AS total, {q.r("sum(x * vol)")} AS exact_total, {q.r("min(p)")} AS lowest, {q.r("max(p)")} AS highest FROM e"""
)
def error_norms(spark, sf_dir):
    t = _target(spark)
    got = remap(_source(spark, sf_dir), t, ["price"], 2, options=Options(order=1, check_mismatch=False)).join(t.select("id", "vol", "cx"), "id").withColumn("exact", 20000 * F.col("cx"))
    out = interpolate.error_norms(got, "price", "exact")
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])


@query(f"WITH {S}, {T}, {W}, {q.first_order(['price'])}, {q.weights('wb', 's', 't')}, {q.first_order(['price'], 'back', 'o', 'wb', 's')} SELECT id, {q.r('price')} AS price FROM back")
def remap_there_and_back(spark, sf_dir):
    s, t = _source(spark, sf_dir), _target(spark)
    o = Options(order=1, check_mismatch=False)
    there = remap(s, t, ["price"], 2, options=o).join(t, "id")
    return _rounded(remap(there, s.drop("price"), ["price"], 2, options=o), "price")


# ---- mismatch and repair ----


@query(f"WITH {q.grid('s', N)}, {T_OFF}, {W} SELECT {q.r('(SELECT sum(vol) FROM s)')} AS source_volume, {q.r('(SELECT sum(vol) FROM t)')} AS target_volume, {q.r('sum(m0)')} AS overlap_volume, true AS mismatch FROM w")
def check_mismatch(spark, sf_dir):
    s, t = meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), _target(spark, OFFSET)
    m = repair.check_mismatch(intersect.intersect_boxes(t, s, 2), s, t)
    return spark.createDataFrame([(round(m.source_volume, 6), round(m.target_volume, 6), round(m.overlap_volume, 6), m.found)], "source_volume double, target_volume double, overlap_volume double, mismatch boolean")


_COVER = "c AS (SELECT t.id, coalesce(sum(m0), 0.0) AS covered FROM t LEFT JOIN w ON tgt_id = t.id GROUP BY t.id)"
_LAYERS = f"{_COVER}, far AS (SELECT e.id, min(greatest(abs(e.ix - n.ix), abs(e.iy - n.iy))) AS layer FROM t e JOIN c ON c.id = e.id AND covered < 2.220446049250313e-16, t n JOIN c cn ON cn.id = n.id AND cn.covered >= 2.220446049250313e-16 GROUP BY e.id)"


@query(f"WITH {q.grid('s', N)}, {T_OFF}, {W}, {_LAYERS} SELECT c.id, {q.r('covered')} AS covered, coalesce(layer, 0)::INTEGER AS layer FROM c LEFT JOIN far USING (id)")
def empty_layers(spark, sf_dir):
    s, t = meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), _target(spark, OFFSET)
    return _rounded(repair.empty_layers(t, intersect.intersect_boxes(t, s, 2), _near(t, M)), "covered", keys=("id", "layer"))


def _repaired(spark, sf_dir, shown=_rounded, **options):
    s, t = _source(spark, sf_dir), _target(spark, OFFSET)
    return shown(remap(s, t, ["price"], 2, source_adjacency=_near(s, N), target_adjacency=_near(t, M), options=Options(order=1, **options)), "price")


_FIRST = f"{S}, {T_OFF}, {W}, {q.first_order(['price'])}, {_COVER}"


@query(f"WITH {_FIRST} SELECT id, {q.r('price')} AS price FROM o")
def repair_constant(spark, sf_dir):
    return _repaired(spark, sf_dir, partial="constant", empty="leave_empty")


@query(f"WITH {_FIRST} SELECT o.id, {q.r('CASE WHEN covered >= 2.220446049250313e-16 AND abs(covered - vol) / vol > 2.220446049250313e-14 THEN price * covered / vol ELSE price END')} AS price FROM o JOIN c USING (id) JOIN t USING (id)")
def repair_locally_conservative(spark, sf_dir):
    return _repaired(spark, sf_dir, partial="locally_conservative", empty="leave_empty")


def _extrapolated(layers: int) -> str:
    out = [f"v0 AS (SELECT o.id, price, coalesce(layer, 0) AS layer, ix, iy FROM o JOIN t USING (id) LEFT JOIN far USING (id))"]
    for k in range(1, layers + 1):
        out.append(f"""v{k} AS (SELECT a.id, CASE WHEN a.layer = {k} THEN coalesce((SELECT avg(b.price) FROM v{k - 1} b WHERE b.layer < {k} AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.id <> b.id), 0.0) ELSE a.price END AS price, a.layer, a.ix, a.iy FROM v{k - 1} a)""")
    return ", ".join(out)


@query(f"WITH {S}, {T_OFF}, {W}, {q.first_order(['price'])}, {_LAYERS}, {_extrapolated(3)} SELECT id, {q.r('price')} AS price FROM v3")
def repair_extrapolate(spark, sf_dir):
    return _repaired(spark, sf_dir, partial="constant", empty="extrapolate")


@query(f"WITH {S}, {T_OFF}, {W}, {q.first_order(['price'])}, {_LAYERS}, {_extrapolated(3)}, {q.conserved('SELECT v3.id, price, vol, true AS o FROM v3 JOIN t USING (id)')} SELECT id, {q.shifted('price', 6)} AS price FROM p5")
def repair_globally_conservative(spark, sf_dir):
    return _repaired(spark, sf_dir, partial(_shifted, digits=6))


@query(f"WITH {_FIRST}, {q.conserved('SELECT o.id, price, vol, covered >= 2.220446049250313e-16 AS o FROM o JOIN c USING (id) JOIN t USING (id)')} SELECT id, {q.shifted('price', 6)} AS price FROM p5")
def repair_globally_conservative_covered_only(spark, sf_dir):
    return _repaired(spark, sf_dir, partial(_shifted, digits=6), empty="leave_empty")


_PARTS_SQL = f"""{q.source(N)}, {T}, {q.weights(extra="AND (t.ix < 7) = (s.ix < 8)")}, {q.first_order(["price"])}, sp AS (SELECT *, CASE WHEN ix < 8 THEN 1 ELSE 2 END AS part FROM s), cov AS (SELECT tgt_id AS id, sum(m0) AS covered FROM w GROUP BY tgt_id),
    {q.conserved_by_part("SELECT t.id, CASE WHEN t.ix < 7 THEN 1 ELSE 2 END AS part, o.price, t.vol, coalesce(covered, 0.0) >= 2.220446049250313e-16 AS o FROM t JOIN o ON o.id = t.id LEFT JOIN cov ON cov.id = t.id").replace("FROM s GROUP BY part", "FROM sp GROUP BY part")}"""


@query(f"WITH {_PARTS_SQL} SELECT id, part, {q.shifted('price', 3)} AS price FROM p5")
def repair_by_part(spark, sf_dir):
    """Two parts whose borders differ between the meshes, each repaired to its own total and bounds in one plan."""
    s = materialize(_source(spark, sf_dir).withColumn("part", F.when(F.col("ix") < 8, 1).otherwise(2)))
    t = _target(spark).withColumn("part", F.when(F.col("ix") < 7, 1).otherwise(2))
    r = Remapper(s, t, 2, part="part", options=Options(order=1, check_mismatch=False))
    fixed, _ = repair.repair_parts(r.interpolate(["price"]), t, s, r.weights(), _near(t, M), "price", empty="leave_empty")
    return _shifted(fixed.join(t.select("id", "part"), "id"), "price", digits=3, keys=("id", "part"))


# ---- parts, materials, momentum ----

_PARTS = f"{S}, {T}, sp AS (SELECT *, (cx < 0.5)::INTEGER AS part FROM s), tp AS (SELECT *, (cx < 0.5)::INTEGER AS part FROM t), {q.weights(t='tp', s='sp', extra='AND t.part = s.part')}, {q.first_order(['price'], s='sp')}"


@query(f"WITH {_PARTS} SELECT id, {q.r('price')} AS price FROM o")
def remap_parts(spark, sf_dir):
    tag = lambda d: d.withColumn("part", (F.col("cx") < 0.5).cast("int"))
    return _rounded(Remapper(tag(_source(spark, sf_dir)), tag(_target(spark)), 2, part="part", options=Options(order=1, check_mismatch=False)).interpolate(["price"]), "price")


_MATS = f"""{q.grid("s", N)}, {q.lineitem_cells(N)}, {T}, {W},
    lm AS (SELECT id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS mat, l_extendedprice FROM li),
    mc AS (SELECT a.id, mat, k / t::DOUBLE AS volfrac, price FROM (SELECT id, mat, count(*) AS k, floor(avg(l_extendedprice))::DOUBLE AS price FROM lm GROUP BY id, mat) a JOIN (SELECT id, count(*) AS t FROM lm GROUP BY id) b ON a.id = b.id),
    wm AS (SELECT tgt_id, src_id, mat, m0 * volfrac AS m0, price FROM w JOIN mc ON mc.id = src_id)"""


@query(f"WITH {_MATS} SELECT t.id, mat, round(sum(m0) / any_value(vol), 10) AS volfrac, {q.r('sum(price * m0) / sum(m0)')} AS price FROM wm JOIN t ON t.id = tgt_id GROUP BY t.id, mat HAVING sum(m0) > 2.220446049250313e-16")
def remap_materials(spark, sf_dir):
    mats = tables.material_cells(spark, sf_dir, N)
    w = intersect.intersect_boxes(_target(spark), meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]), 2)
    w = w.join(mats.select(F.col("id").alias("src_id"), "mat", "volfrac"), "src_id").withColumns({c: F.col(c) * F.col("volfrac") for c in ("m0", "m1x", "m1y")}).drop("volfrac")
    got = materials.remap_materials(w, mats, _target(spark), ["price"], 2)
    return got.select("id", "mat", F.round("volfrac", 10).alias("volfrac"), _r(F.col("price")).alias("price"))


@query(f"""WITH {q.lineitem_cells(N)}, e AS (SELECT id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::INTEGER AS mat, count(*) AS k FROM li GROUP BY 1, 2), w AS (SELECT id, sum(k) AS t FROM e GROUP BY id)
    SELECT id, mat, {q.shifted(f'k / (t * {N * N}::DOUBLE)', 9)} AS area FROM e JOIN w USING (id)""")
def interface_reconstruction(spark, sf_dir):
    """Areas of the pieces that interfaces cut out of the cells: each material's share of its cell."""
    s = meshes.box_rings(meshes.box_mesh(spark, [0, 0], [1, 1], [N, N]))
    pieces = materials.reconstruct(s, tables.material_cells(spark, sf_dir, N).select("id", "mat", "volfrac"), _near(s, N))
    return _shifted(pieces.withColumn("area", intersect_area(F.col("ring"))), "area", digits=9, keys=("id", "mat"))


@query(f"""WITH z AS (SELECT greatest(3, floor(pow(count(*) / 256.0, 1 / 3.0::DOUBLE)))::BIGINT AS n FROM lineitem),
    e AS (SELECT (least(floor((l_quantity - 1) / 49 * n), n - 1) + least(floor(l_discount / 0.1::DOUBLE * n), n - 1) * n + least(floor(l_tax / 0.08::DOUBLE * n), n - 1) * n * n)::BIGINT AS id,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::INTEGER AS mat, count(*) AS k FROM lineitem, z GROUP BY 1, 2), w AS (SELECT id, sum(k) AS t FROM e GROUP BY id)
    SELECT id, mat, {q.shifted('k / (t * (n * n * n)::DOUBLE) * 1.006::DOUBLE', 9)} AS volume FROM e JOIN w USING (id), z""")
def interface_reconstruction_3d(spark, sf_dir):
    """Volumes of the polyhedra that interfaces cut out of slanted cells."""
    rows = tables.table(spark, sf_dir, "lineitem").count()
    n = max(3, math.floor(math.pow(rows / 256, 1 / 3)))
    boxes = tables.lineitem_blocks(spark, sf_dir, n)
    s = materialize(meshes.mapped_solids(meshes.box_solids(boxes), _MAP))
    pieces = materials.reconstruct_solids(s, tables.material_blocks(spark, sf_dir, n), meshes.box_adjacency(boxes, [n, n, n]))
    return _shifted(materials.piece_centroids(pieces), "volume", digits=9, keys=("id", "mat"))


NM, MM = 32, 24


def _layout_sql() -> str:
    edge = f"ix = 0 OR ix = {NM - 1} OR iy = 0 OR iy = {NM - 1}"
    slope = lambda ex, ey: f"(rx * ({ex} - cx) + ry * ({ey} - cy))"
    phi = ", ".join(f"CASE WHEN {slope(x, y)} = 0 THEN 1.0 WHEN {slope(x, y)} > 0 THEN (hi - f) / {slope(x, y)} ELSE (lo - f) / {slope(x, y)} END" for x in ("gxlo", "gxhi") for y in ("gylo", "gyhi"))
    return f"""{q.source(NM)}, {q.grid("t", MM)}, {q.weights()}, {q.gradients(["price"], True)}, {q.second_order(["price"])},
    ab AS (SELECT (sum(l_linenumber)::BIGINT % 7 + 5) / 16.0::DOUBLE + 1 / 96.0::DOUBLE AS a, (count(*) % 5 + 5) / 16.0::DOUBLE + 1 / 96.0::DOUBLE AS b FROM lineitem),
    cuts AS (SELECT 1 AS mat, 0.0 AS x0, a AS x1, 0.0 AS y0, 1.0 AS y1 FROM ab UNION ALL SELECT 2, a, 1.0, b, 1.0 FROM ab UNION ALL SELECT 3, a, 1.0, 0.0, b FROM ab),
    pc AS (SELECT id, mat, ix, iy, {edge} AS bnd, xlo AS gxlo, xhi AS gxhi, ylo AS gylo, yhi AS gyhi, greatest(xlo, x0) AS pxlo, least(xhi, x1) AS pxhi, greatest(ylo, y0) AS pylo, least(yhi, y1) AS pyhi, price + 1000 * mat AS f
      FROM s, cuts WHERE greatest(xlo, x0) < least(xhi, x1) AND greatest(ylo, y0) < least(yhi, y1)),
    mp AS (SELECT *, (pxlo + pxhi) / 2 AS cx, (pylo + pyhi) / 2 AS cy FROM pc),
    ms AS (SELECT c.id, c.mat, sum((n.cx - c.cx) * (n.cx - c.cx)) AS xx, sum((n.cx - c.cx) * (n.cy - c.cy)) AS xy, sum((n.cy - c.cy) * (n.cy - c.cy)) AS yy, sum((n.cx - c.cx) * (n.f - c.f)) AS sx, sum((n.cy - c.cy) * (n.f - c.f)) AS sy,
             least(min(n.f), min(c.f)) AS lo, greatest(max(n.f), max(c.f)) AS hi FROM mp c JOIN mp n ON n.mat = c.mat AND abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1 AND n.id <> c.id GROUP BY c.id, c.mat),
    mr AS (SELECT mp.*, lo, hi, (sx * yy - sy * xy) / (xx * yy - xy * xy) AS rx, (xx * sy - xy * sx) / (xx * yy - xy * xy) AS ry FROM mp JOIN ms USING (id, mat)),
    mg AS (SELECT *, CASE WHEN bnd THEN 1.0 ELSE least(1.0, {phi}) END AS phi FROM mr),
    mw AS (SELECT t.id, vol, mat, f, phi, rx, ry, cx, cy, (least(t.xhi, pxhi) - greatest(t.xlo, pxlo)) * (least(t.yhi, pyhi) - greatest(t.ylo, pylo)) AS m0, (least(t.xhi, pxhi) + greatest(t.xlo, pxlo)) / 2 AS ox, (least(t.yhi, pyhi) + greatest(t.ylo, pylo)) / 2 AS oy
      FROM (SELECT id, xlo, xhi, ylo, yhi, vol FROM t) t JOIN mg ON greatest(t.xlo, pxlo) < least(t.xhi, pxhi) AND greatest(t.ylo, pylo) < least(t.yhi, pyhi))"""


@query(f"""WITH {_layout_sql()}
    SELECT 'material' AS kind, id, mat, {q.shifted('sum(m0) / any_value(vol)', 8)} AS volfrac, {q.shifted('sum((f + phi * (rx * (ox - cx) + ry * (oy - cy))) * m0) / sum(m0)', 3)} AS value FROM mw GROUP BY id, mat
    UNION ALL SELECT 'cell', id, NULL, NULL, {q.shifted('price', 3)} FROM o""")
def remap_multimaterial(spark, sf_dir):
    """Cell prices and material values in one call, second order: three materials in a T whose places follow from lineitem."""
    a, b = tables.table(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_linenumber").cast("long")) % 7, F.count("*") % 5).first()
    a, b = (a + 5) / 16 + 1 / 96, (b + 5) / 16 + 1 / 96
    s, t = materialize(meshes.box_rings(_source(spark, sf_dir, NM))), meshes.box_rings(meshes.box_mesh(spark, [0, 0], [1, 1], [MM, MM]))
    pieces = materialize(materials.half_plane_polygons(s, [(1, [(-1, 0, -a)]), (2, [(1, 0, a), (0, 1, b)]), (3, [(1, 0, a), (0, -1, -b)])]))
    held = materials.piece_centroids(pieces).join(s.select("id", "vol", "price"), "id").select("id", "mat", (F.col("volume") / F.col("vol")).alias("volfrac"), (F.col("price") + 1000 * F.col("mat")).alias("f"))
    r = MultiRemapper(Side(s, _near(s, NM)), Side(t), material=held, pieces=pieces, options=Options(check_mismatch=False))
    got = r.interpolate(cell=["price"], material=["f"])
    both = got["material"].select(F.lit("material").alias("kind"), "id", "mat", (F.round(F.col("volfrac") + 3e-9, 8)).alias("volfrac"), F.col("f").alias("value"))
    both = both.unionByName(got["cell"].select(F.lit("cell").alias("kind"), "id", F.lit(None).cast("int").alias("mat"), F.lit(None).cast("double").alias("volfrac"), F.col("price").alias("value")))
    return _shifted(both, "value", digits=3, keys=("kind", "id", "mat", "volfrac"))


def intersect_area(ring: Column) -> Column:
    from .functions.geometry import polygon_moments

    return polygon_moments(ring)["m0"]


_MOM = f"{S}, {T}, sm AS (SELECT *, (qty + 1) * vol AS mass, qty + 1 AS density, (qty + 1) * (price / 10000) AS px, (qty + 1) * (cx - cy) AS py FROM s), {q.weights(s='sm')}, {q.gradients(['density', 'px', 'py'], True, 'sm')}, {q.second_order(['density', 'px', 'py'], s='sm')}"


@query(f"WITH {_MOM} SELECT id, {q.r('density')} AS density, {q.r('density * vol')} AS mass, {q.r('CASE WHEN density <> 0 THEN px / density ELSE 0.0 END')} AS ux, {q.r('CASE WHEN density <> 0 THEN py / density ELSE 0.0 END')} AS uy FROM o JOIN t USING (id)")
def momentum_cell_centred(spark, sf_dir):
    s = _source(spark, sf_dir).withColumns({"mass": (F.col("qty") + 1) * F.col("vol"), "ux": F.col("price") / 10000, "uy": F.col("cx") - F.col("cy")})
    return _rounded(momentum.remap_cch(s, _target(spark), _near(s, N), 2), "density", "mass", "ux", "uy")


_STAG = f"""{S}, {T}, sm AS (SELECT *, qty + 1 AS density, (qty + 1) * cx AS px, (qty + 1) * (cx - cy) AS py FROM s), {q.weights(s="sm")}, {q.gradients(["density", "px", "py"], True, "sm")}, {q.second_order(["density", "px", "py"], s="sm")},
    tc AS (SELECT t.*, density, px, py FROM t JOIN o USING (id)), {q.gradients(["density", "px", "py"], True, "tc", "h")},
    cr AS (SELECT tc.id, (ix + a + (iy + b) * {M + 1})::BIGINT AS node, vol / 4 AS part, (CASE a WHEN 1 THEN xhi ELSE xlo END - cx) / 2 AS dx, (CASE b WHEN 1 THEN yhi ELSE ylo END - cy) / 2 AS dy, density, px, py FROM tc, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
    nd AS (SELECT node, {", ".join(f"sum(part * ({f} + gx_{f} * dx + gy_{f} * dy)) AS {f}" for f in ("density", "px", "py"))} FROM cr JOIN h USING (id) GROUP BY node)"""


@query(f"WITH {_STAG} SELECT node, {q.r('density')} AS mass, {q.r('px / density')} AS ux, {q.r('py / density')} AS uy FROM nd")
def momentum_staggered(spark, sf_dir):
    s, t = _source(spark, sf_dir), _target(spark)
    corners = momentum.box_corners(s, [N, N])
    mass = corners.join(s.select("id", "qty"), "id").select("id", "node", ((F.col("qty") + 1) * F.col("vol")).alias("mass"))
    nodes = meshes.box_nodes(spark, [0, 0], [1, 1], [N, N]).select(F.col("id").alias("node"), F.col("x").alias("ux"), (F.col("x") - F.col("y")).alias("uy"))
    return _rounded(momentum.remap_sgh(s, mass, nodes, t, _near(s, N), _near(t, M), momentum.box_corners(t, [M, M]), 2), "mass", "ux", "uy", keys=("node",))


_CORNER_MOM = f"""{_POLYGONS}, {q.wedge_overlaps()}, {q.corners("s")}, {q.corners("t")},
    sm AS (SELECT m.id, cx, cy, vol, any_value(m.id % 7 + 1)::DOUBLE AS density, sum((m.id % 7 + 1) * part * n.x) / vol AS px, sum((m.id % 7 + 1) * part * (n.x - n.y)) / vol AS py
      FROM s_middle m JOIN s_corner c ON c.cell = m.id JOIN s_node n ON n.id = c.node GROUP BY m.id, cx, cy, vol)"""


def _corner_mass(spark, sf_dir):
    """(source, target, corners with a mass, node velocities) of the polygon meshes from lineitem."""
    (nodes, source), (_, target) = _polygons(spark, sf_dir)
    mass = momentum.polygon_corners(source).withColumn("mass", (F.col("id") % 7 + 1) * F.col("vol"))
    return source, target, mass, nodes.select(F.col("id").alias("node"), F.col("x").alias("ux"), (F.col("x") - F.col("y")).alias("uy"))


_MOMENTA = ["density", "px", "py"]


@query(f"""WITH {_CORNER_MOM}, {q.cell_slopes("s", "sm", _MOMENTA, "g")},
    tm AS (SELECT m.id, m.cx, m.cy, {", ".join(f"sum(m0 * {f} + gx_{f} * (m1x - sm.cx * m0) + gy_{f} * (m1y - sm.cy * m0)) / sum(m0) AS {f}" for f in _MOMENTA)} FROM ov JOIN sm ON sm.id = src_cell JOIN g ON g.id = src_cell JOIN t_middle m ON m.id = tgt_cell GROUP BY m.id, m.cx, m.cy),
    {q.cell_slopes("t", "tm", _MOMENTA, "h")},
    nd AS (SELECT node, {", ".join(f"sum(part * ({f} + gx_{f} * (x - cx) + gy_{f} * (y - cy))) AS {f}" for f in _MOMENTA)} FROM t_corner c JOIN tm ON tm.id = c.cell JOIN h ON h.id = c.cell GROUP BY node)
    SELECT node, {q.shifted("density", 7)} AS mass, {q.shifted("px / density", 6)} AS ux, {q.shifted("py / density", 6)} AS uy FROM nd""")
def momentum_polygon_staggered(spark, sf_dir):
    """Corner masses and node velocities between two polygon meshes, second order on both sides."""
    s, t, mass, velocity = _corner_mass(spark, sf_dir)
    got = momentum.remap_sgh(s, mass, velocity, t, materialize(topology.cell_neighbours(s)), materialize(topology.cell_neighbours(t)), momentum.polygon_corners(t), 2, limiter="nolimiter")
    return _shifted(got, "mass", digits=7, keys=("node",)).join(_shifted(got, "ux", "uy", digits=6, keys=("node",)), "node")


@query(f"""WITH {_CORNER_MOM} SELECT tgt_node AS node, src_cell % 3 AS mat, {q.shifted("sum(m0)", 9)} AS volume, {q.shifted("sum(m0 * density)", 8)} AS mass, {q.shifted("sum(m0 * px)", 8)} AS momentum_x, {q.shifted("sum(m0 * py)", 8)} AS momentum_y
    FROM ov JOIN sm ON sm.id = src_cell GROUP BY ALL""")
def momentum_corner_materials(spark, sf_dir):
    """Masses and momenta a material at the nodes of a polygon mesh, from corners a material; first order."""
    s, t, mass, velocity = _corner_mass(spark, sf_dir)
    held = s.withColumn("mat", F.col("id") % 3)
    corners, _ = momentum.remap_sgh_materials(mass.withColumn("mat", F.col("id") % 3), velocity, held.withColumnRenamed("vol", "volume"), held, t)
    got = corners.groupBy("node", "mat").agg(*[F.sum(c).alias(c) for c in ("volume", "mass", "momentum_x", "momentum_y")])
    return _shifted(got, "volume", digits=9, keys=("node", "mat")).join(_shifted(got, "mass", "momentum_x", "momentum_y", digits=8, keys=("node", "mat")), ["node", "mat"])


@query(f"""WITH {_CORNER_MOM} SELECT tgt_cell AS id, {q.shifted("sum(m0 * density)", 8)} AS mass, {q.shifted("sum(m0 * density * (src_cell % 5)) / sum(m0 * density)", 6)} AS ux, {q.shifted("sum(m0 * density * cx) / sum(m0 * density)", 6)} AS uy
    FROM ov JOIN sm ON sm.id = src_cell GROUP BY tgt_cell""")
def momentum_cell_materials(spark, sf_dir):
    """The velocity of cells that keeps the momentum of all their materials."""
    (_, s), (_, t) = _polygons(spark, sf_dir)
    held = s.withColumns({"mat": F.col("id") % 3, "density": (F.col("id") % 7 + 1).cast("double"), "ux": (F.col("id") % 5).cast("double"), "uy": F.col("cx")})
    _, got = momentum.remap_cch_materials(held, held, t, 2)
    return _shifted(got, "mass", digits=8).join(_shifted(got, "ux", "uy", digits=6), "id")


# ---- swept regions ----

_DX = 0.015625


def _swept_sql(fields: str) -> str:
    """All inner nodes move by (dx, dx / 2): every inner face sweeps a parallelogram (or less at the boundary)."""
    return f"""{q.grid("s", N)}, nd AS (SELECT i, j, i / {N}::DOUBLE AS x, j / {N}::DOUBLE AS y, i / {N}::DOUBLE + CASE WHEN i > 0 AND i < {N} AND j > 0 AND j < {N} THEN {_DX} ELSE 0.0 END AS tx, j / {N}::DOUBLE + CASE WHEN i > 0 AND i < {N} AND j > 0 AND j < {N} THEN {_DX / 2} ELSE 0.0 END AS ty
      FROM (SELECT unnest(range({N + 1})) AS i), (SELECT unnest(range({N + 1})) AS j)),
    ed AS (SELECT id, CASE e WHEN 0 THEN CASE WHEN iy > 0 THEN id - {N} END WHEN 1 THEN CASE WHEN ix < {N - 1} THEN id + 1 END WHEN 2 THEN CASE WHEN iy < {N - 1} THEN id + {N} END ELSE CASE WHEN ix > 0 THEN id - 1 END END AS nbr,
        ix + [0, 1, 1, 0][e + 1] AS ai, iy + [0, 0, 1, 1][e + 1] AS aj, ix + [1, 1, 0, 0][e + 1] AS bi, iy + [0, 1, 1, 0][e + 1] AS bj FROM s, (SELECT unnest(range(4)) AS e)),
    sw AS (SELECT id, nbr, ((b.x * a.y - a.x * b.y) + (a.x * a.ty - a.tx * a.y) + (a.tx * b.ty - b.tx * a.ty) + (b.tx * b.y - b.x * b.ty)) / 2 AS m0
      FROM ed JOIN nd a ON a.i = ai AND a.j = aj JOIN nd b ON b.i = bi AND b.j = bj WHERE nbr IS NOT NULL),
    w AS (SELECT id AS tgt_id, id AS src_id, vol AS m0 FROM s UNION ALL SELECT id, CASE WHEN m0 > 0 THEN nbr ELSE id END, m0 FROM sw WHERE abs(m0) >= 2.220446049250313e-16) {fields}"""


def _moved(spark) -> tuple[DataFrame, DataFrame]:
    nodes = meshes.box_nodes(spark, [0, 0], [1, 1], [N, N])
    moved = meshes.move_nodes(nodes, {"x": F.lit(_DX), "y": F.lit(_DX / 2)}, F.col("is_boundary"))
    return meshes.rings_from_nodes(nodes, [N, N]), meshes.rings_from_nodes(moved, [N, N])


@query(f"WITH {_swept_sql('')} SELECT tgt_id, src_id, count(*) AS n, {q.r('sum(m0)')} AS m0 FROM w GROUP BY tgt_id, src_id")
def swept_weights(spark, sf_dir):
    before, after = _moved(spark)
    w = swept.swept_weights_2d(before, after, meshes_neighbour())
    return w.groupBy("tgt_id", "src_id").agg(F.count("*").alias("n"), _r(F.sum("m0")).alias("m0"))


def meshes_neighbour() -> Column:
    return swept.box_edge_neighbours(N, N)


@query(f"WITH {_swept_sql('')}, {q.lineitem_cells(N)}, sv AS (SELECT id, floor(avg(l_extendedprice))::DOUBLE AS price FROM li GROUP BY id) SELECT tgt_id AS id, {q.r('sum(coalesce(price, 0.0) * m0) / sum(m0)')} AS price FROM w LEFT JOIN sv ON sv.id = src_id GROUP BY tgt_id")
def swept_remap(spark, sf_dir):
    before, after = _moved(spark)
    s = _source(spark, sf_dir)
    w = swept.swept_weights_2d(before, after, meshes_neighbour())
    return _rounded(Remapper(s, s.drop("price"), 2, weights=w, options=Options(order=1, check_mismatch=False)).interpolate(["price"]), "price")


def _vortex_sql(steps: int = 4, dt: float = 0.01) -> str:
    import math

    out = [f"nd0 AS (SELECT i, j, i / {N}::DOUBLE AS x, j / {N}::DOUBLE AS y, i = 0 OR i = {N} OR j = 0 OR j = {N} AS fixed FROM (SELECT unnest(range({N + 1})) AS i), (SELECT unnest(range({N + 1})) AS j))", "v0 AS (SELECT id, price FROM s)",
           f"ed AS (SELECT id, CASE e WHEN 0 THEN CASE WHEN iy > 0 THEN id - {N} END WHEN 1 THEN CASE WHEN ix < {N - 1} THEN id + 1 END WHEN 2 THEN CASE WHEN iy < {N - 1} THEN id + {N} END ELSE CASE WHEN ix > 0 THEN id - 1 END END AS nbr, ix + [0, 1, 1, 0][e + 1] AS ai, iy + [0, 0, 1, 1][e + 1] AS aj, ix + [1, 1, 0, 0][e + 1] AS bi, iy + [0, 1, 1, 0][e + 1] AS bj FROM s, (SELECT unnest(range(4)) AS e))"]
    for k in range(steps):
        swing = f"{math.cos(math.pi * k * dt / 2.0) * dt!r}::DOUBLE"
        out.append(f"""nd{k + 1} AS (SELECT i, j, CASE WHEN fixed THEN x ELSE x - 2 * sin(pi() * x) * sin(pi() * x) * sin(pi() * y) * cos(pi() * y) * {swing} END AS x, CASE WHEN fixed THEN y ELSE y + 2 * sin(pi() * x) * cos(pi() * x) * sin(pi() * y) * sin(pi() * y) * {swing} END AS y, fixed FROM nd{k}),
        ar{k} AS (SELECT id, sum(a.x * b.y - b.x * a.y) / 2 AS m0 FROM ed JOIN nd{k} a ON a.i = ai AND a.j = aj JOIN nd{k} b ON b.i = bi AND b.j = bj GROUP BY id),
        sw{k} AS (SELECT id, nbr, ((b.x * a.y - a.x * b.y) + (a.x * ta.y - ta.x * a.y) + (ta.x * tb.y - tb.x * ta.y) + (tb.x * b.y - b.x * tb.y)) / 2 AS m0 FROM ed JOIN nd{k} a ON a.i = ai AND a.j = aj JOIN nd{k} b ON b.i = bi AND b.j = bj
          JOIN nd{k + 1} ta ON ta.i = ai AND ta.j = aj JOIN nd{k + 1} tb ON tb.i = bi AND tb.j = bj WHERE nbr IS NOT NULL),
        w{k} AS (SELECT id AS tgt_id, id AS src_id, m0 FROM ar{k} UNION ALL SELECT id, CASE WHEN m0 > 0 THEN nbr ELSE id END, m0 FROM sw{k} WHERE abs(m0) >= 2.220446049250313e-16),
        v{k + 1} AS (SELECT tgt_id AS id, sum(price * m0) / sum(m0) AS price FROM w{k} JOIN v{k} ON v{k}.id = src_id GROUP BY tgt_id)""")
    return ", ".join(out)


@query(f"WITH {S}, {_vortex_sql()} SELECT id, {q.shifted('price', 5)} AS price FROM v4")
def swept_vortex_steps(spark, sf_dir):
    """Four steps of a periodic vortex; each remaps what the step before left."""
    nodes, s = meshes.box_nodes(spark, [0, 0], [1, 1], [N, N]), _source(spark, sf_dir)
    value = s.select("id", "price")
    for k in range(4):
        after = materialize(meshes.move_nodes(nodes, meshes.vortex(k * 0.01, 0.01), F.col("is_boundary")))
        rings = meshes.polygon_mesh(meshes.rings_from_nodes(nodes, [N, N])).join(value, "id")
        moved = meshes.polygon_mesh(meshes.rings_from_nodes(after, [N, N]))
        w = swept.swept_weights_2d(rings.select("id", "ring"), moved.select("id", "ring"), meshes_neighbour())
        value = materialize(Remapper(rings, moved, 2, weights=w, options=Options(order=1, check_mismatch=False)).interpolate(["price"]))
        nodes = after
    return _shifted(value, "price", digits=5)


_SLABS, _TALL = 6, 3


@query(
    f"""WITH c AS (SELECT id, id % {_SLABS} AS i FROM (SELECT unnest(range({_SLABS * _TALL * _TALL})) AS id)), m AS (SELECT i, CASE WHEN i IN (0, {_SLABS}) THEN 0.0 ELSE ((i * 7) % 5 - 2) / 64::DOUBLE END AS d FROM (SELECT unnest(range({_SLABS + 1})) AS i)),
    a AS (SELECT 1 / {_TALL * _TALL}::DOUBLE AS face), w AS (
      SELECT c.id AS tgt_id, c.id AS src_id, face / {_SLABS} AS m0 FROM c, a
      UNION ALL SELECT c.id, CASE WHEN d > 0 THEN c.id + 1 ELSE c.id END, d * face FROM c JOIN m ON m.i = c.i + 1, a WHERE c.i < {_SLABS - 1} AND d <> 0
      UNION ALL SELECT c.id, CASE WHEN d < 0 THEN c.id - 1 ELSE c.id END, -d * face FROM c JOIN m ON m.i = c.i, a WHERE c.i > 0 AND d <> 0)
    SELECT tgt_id, src_id, count(*) AS n, round(sum(m0), 9) AS m0 FROM w GROUP BY tgt_id, src_id"""
)
def swept_weights_3d(spark, sf_dir):
    """Slabs whose inner faces move along x, some forward and some back."""
    mesh = meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [_SLABS, _TALL, _TALL])
    cells = mesh.select("id", F.col("vol").alias("m0"), *[(F.col("vol") * F.col("c" + a)).alias("m1" + a) for a in "xyz"])
    shift = lambda i: F.when((i == 0) | (i == _SLABS), 0.0).otherwise(((i * 7) % 5 - 2) / 64.0)

    def ring(x: Column, forward: bool) -> Column:
        """The corners of an x face, counter-clockwise as seen from outside."""
        order = [("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi")] if forward else [("lo", "lo"), ("lo", "hi"), ("hi", "hi"), ("hi", "lo")]
        return F.array(*[F.array(x, F.col("y" + b), F.col("z" + c)) for b, c in order])

    ahead = F.struct(F.when(F.col("ix") < _SLABS - 1, F.col("id") + 1).alias("nbr"), ring(F.col("xhi"), True).alias("before"), ring(F.col("xhi") + shift(F.col("ix") + 1), True).alias("after"))
    behind = F.struct(F.when(F.col("ix") > 0, F.col("id") - 1).alias("nbr"), ring(F.col("xlo"), False).alias("before"), ring(F.col("xlo") + shift(F.col("ix")), False).alias("after"))
    faces = mesh.select("id", F.explode(F.array(ahead, behind)).alias("f")).select("id", "f.*")
    w = swept.swept_weights_3d(cells, faces)
    return w.groupBy("tgt_id", "src_id").agg(F.count("*").alias("n"), F.round(F.sum("m0"), 9).alias("m0"))


# ---- particles ----

_PAIRS = f"{q.customers(0.0625)}, {q.suppliers(0.0625)}, d AS (SELECT su.id AS tgt_id, cu.v, su.x - cu.x AS dx, su.y - cu.y AS dy, sqrt(pow((su.x - cu.x) / su.h, 2) + pow((su.y - cu.y) / su.h, 2)) AS k FROM su JOIN cu ON abs(su.x - cu.x) < 2 * su.h AND abs(su.y - cu.y) < 2 * su.h), pw AS (SELECT *, {q.b4('k')} AS w FROM d)"


def _swarms(spark, sf_dir):
    return tables.customer_swarm(spark, sf_dir, 0.0625), tables.supplier_swarm(spark, sf_dir, 0.0625)


@query(f"WITH {_PAIRS} SELECT su.id, {q.r('coalesce(sum(w * pw.v), 0.0)')} AS v FROM su LEFT JOIN pw ON tgt_id = su.id GROUP BY su.id")
def swarm_density(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    return _rounded(swarm_remap(s, t, ["v"], 2, estimator="kernel_density"), "v")


@query(f"WITH {_PAIRS} SELECT su.id, {q.r('coalesce(CASE WHEN sum(w) <> 0 THEN sum(w * pw.v) / sum(w) ELSE 0.0 END, 0.0)')} AS v FROM su LEFT JOIN pw ON tgt_id = su.id GROUP BY su.id")
def swarm_unitary(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    return _rounded(swarm_remap(s, t, ["v"], 2), "v")


@query(f"WITH {_PAIRS}, {q.regression('pw', ['1.0', '-dx', '-dy'])} SELECT su.id, {q.shifted('coalesce(x0, 0.0)')} AS v FROM su LEFT JOIN lr ON tgt_id = su.id")
def swarm_linear(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    return _shifted(swarm_remap(s, t, ["v"], 2, basis="linear"), "v")


@query(f"WITH {_PAIRS}, {q.regression('pw', ['1.0', '-dx', '-dy', '0.5 * dx * dx', 'dx * dy', '0.5 * dy * dy'])} SELECT su.id, (round(coalesce(x1, 0.0), 2) + 0.0) AS v FROM su LEFT JOIN lr ON tgt_id = su.id")
def swarm_quadratic_gradient(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    return swarm_remap(s, t, ["v"], 2, basis="quadratic", derivative=1).select("id", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query(
    f"""WITH {q.customers(0.0625)}, {q.suppliers(0.0625)}, d AS (SELECT su.id AS tgt_id, cu.v, abs((su.x - cu.x) / cu.h) AS a, abs((su.y - cu.y) / cu.h) AS b FROM su JOIN cu ON abs(su.x - cu.x) < 2 * cu.h AND abs(su.y - cu.y) < 2 * cu.h),
    pw AS (SELECT *, (1 - a * a * 0.25::DOUBLE) * (1 - b * b * 0.25::DOUBLE) AS w FROM d)
    SELECT su.id, {q.r("coalesce(CASE WHEN sum(w) <> 0 THEN sum(w * pw.v) / sum(w) ELSE 0.0 END, 0.0)")} AS v FROM su LEFT JOIN pw ON tgt_id = su.id GROUP BY su.id"""
)
def swarm_scatter_tensor(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    return _rounded(swarm_remap(s, t, ["v"], 2, kernel="epanechnikov", geometry="tensor", center="scatter"), "v")


@query(f"WITH {_PAIRS}, n AS (SELECT tgt_id, count(*) AS n FROM pw GROUP BY tgt_id) SELECT min(n) AS least, max(n) AS most, {q.r('avg(n)')} AS mean, {q.r('stddev_pop(n)')} AS deviation FROM n")
def swarm_neighbours(spark, sf_dir):
    s, t = _swarms(spark, sf_dir)
    out = particles.neighbour_statistics(search.point_counts(t, s, 2))
    return out.select("least", "most", _r(F.col("mean")).alias("mean"), _r(F.col("deviation")).alias("deviation"))


@query(
    f"""WITH {S}, {T}, hp AS (SELECT id, cx, cy, sqrt(pow(xhi - xlo, 2) + pow(yhi - ylo, 2)) / 2 * 1.25::DOUBLE * 2 AS h FROM t),
    d AS (SELECT hp.id AS tgt_id, price, abs((hp.cx - s.cx) / h) AS a, abs((hp.cy - s.cy) / h) AS b FROM hp JOIN s ON abs(hp.cx - s.cx) < 2 * h AND abs(hp.cy - s.cy) < 2 * h),
    pw AS (SELECT *, ({q.b4("a")}) * ({q.b4("b")}) AS w FROM d) SELECT t.id, {q.r("coalesce(sum(w * price) / sum(w), 0.0)")} AS price FROM t LEFT JOIN pw ON tgt_id = t.id GROUP BY t.id"""
)
def remap_through_particles(spark, sf_dir):
    return _rounded(mesh_swarm_mesh(_source(spark, sf_dir), _target(spark), ["price"], 2), "price")



def _ramp(z: str) -> str:
    return f"(CASE WHEN {z} < 0 THEN 1.0 WHEN {z} <= 1 THEN (1.5::DOUBLE - {z}) / 1.5::DOUBLE WHEN {z} < 2 THEN (2 - 2 * {z} + 0.5::DOUBLE * {z} * {z}) / 1.5::DOUBLE ELSE 0.0 END)"


@query(
    f"""WITH {S}, {T}, d AS (SELECT t.id AS tgt_id, price, (t.cx - s.cx) / (s.xhi - s.xlo) AS a, (t.cy - s.cy) / (s.yhi - s.ylo) AS b FROM t JOIN s ON abs(t.cx - s.cx) < 4 * (s.xhi - s.xlo) AND abs(t.cy - s.cy) < 4 * (s.yhi - s.ylo)),
    pw AS (SELECT tgt_id, price, {_ramp("a")} * {_ramp("(-a)")} * {_ramp("b")} * {_ramp("(-b)")} AS w FROM d)
    SELECT t.id, {q.r("coalesce(CASE WHEN sum(w) <> 0 THEN sum(w * price) / sum(w) ELSE 0.0 END, 0.0)")} AS price FROM t LEFT JOIN pw ON tgt_id = t.id GROUP BY t.id"""
)
def swarm_faceted(spark, sf_dir):
    """Cells as faceted particles of polynomial ramps, scattered to the target's centroids."""
    s = _source(spark, sf_dir)
    swarm = particles.facets_of_cells(s, particles.box_faces(s, [N, N]), 2, factor=1.0).join(s.select("id", "price"), "id")
    t = _target(spark).select("id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return _rounded(swarm_remap(swarm, t, ["price"], 2, kernel="polyramp", geometry="faceted", center="scatter"), "price")


@query(
    f"""WITH {S}, j AS (SELECT c.id, count(*) AS k FROM s c JOIN s n ON abs(n.ix - c.ix) + abs(n.iy - c.iy) = 1 AND abs(c.price - n.price) > 2000 GROUP BY c.id)
    SELECT s.id, {q.r(f"(4 - 0.5::DOUBLE * coalesce(k, 0)) / {N}")} AS reach FROM s LEFT JOIN j USING (id)"""
)
def facets_at_jumps(spark, sf_dir):
    """Supports that reach half as far towards neighbours of another price."""
    s = _source(spark, sf_dir)
    swarm = particles.facets_of_cells(s, particles.box_faces(s, [N, N]), 2).join(s.select("id", "price"), "id")
    step = F.col("nbr") - F.col("id")  # facets are sorted by their normals: left, down, up, right
    near = _near(s, N, "face").withColumn("facet", F.when(step == -1, 1).when(step == -N, 2).when(step == N, 3).otherwise(4))
    scaled = particles.scale_facets_at_jumps(swarm, near, "price", 2000.0, 0.5)
    return scaled.select("id", _r(F.aggregate("facets", F.lit(0.0), lambda a, f: a + F.element_at(f, -1))).alias("reach"))


@query(
    f"""WITH {S}, {T}, d AS (SELECT t.id AS tgt_id, s.price AS v, s.cx - t.cx AS dx, s.cy - t.cy AS dy, sqrt(pow((t.cx - s.cx) / 0.1::DOUBLE, 2) + pow((t.cy - s.cy) / 0.1::DOUBLE, 2)) AS k FROM t JOIN s ON abs(t.cx - s.cx) < 2 * 0.1::DOUBLE AND abs(t.cy - s.cy) < 2 * 0.1::DOUBLE),
    pw AS (SELECT *, {q.b4("k")} AS w FROM d), {q.regression("pw", ["1.0", "dx", "dy"])} SELECT t.id, {q.r("coalesce(x0 * vol, 0.0)")} AS price FROM t LEFT JOIN lr ON tgt_id = t.id"""
)
def swarm_volume_integral(spark, sf_dir):
    """Integrals of the price over the target's cells, by linear regression and the integral operator."""
    t, s = _target(spark), _source(spark, sf_dir)
    vertices = F.array(*[F.array(F.col("x" + a), F.col("y" + b)) for a, b in (("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi"))])
    domain = t.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), vertices.alias("vertices"))
    swarm = s.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0.1).alias("hx"), F.lit(0.1).alias("hy"), "price")
    goal = domain.select("id", "x", "y", F.lit(0.1).alias("hx"), F.lit(0.1).alias("hy"))
    return _rounded(swarm_remap(swarm, goal, ["price"], 2, basis="linear", estimator="operator_regression", operator=particles.integral_operator(domain, 2, "linear")), "price")


def _ramps(pairs: list[str]) -> str:
    return " * ".join(_ramp(f"({z})") for z in pairs)


@query(
    f"""WITH {q.customers(0.0625)}, {q.suppliers(0.0625)}, c AS (SELECT id, x, y, v, id % 3 AS kind, CASE WHEN id % 2 = 0 THEN h ELSE 1.5::DOUBLE * h END AS h FROM cu),
    d AS (SELECT su.id AS tgt_id, c.v, kind, (su.x - c.x) / c.h AS a, (su.y - c.y) / c.h AS b, (su.x - c.x) / 0.05::DOUBLE AS fa, (su.y - c.y) / 0.05::DOUBLE AS fb FROM su JOIN c ON abs(su.x - c.x) < 2 * c.h AND abs(su.y - c.y) < 2 * c.h),
    k AS (SELECT *, sqrt(a * a + b * b) AS r FROM d),
    pw AS (SELECT tgt_id, v, CASE kind WHEN 0 THEN {q.b4("r")} WHEN 1 THEN (1 - a * a * 0.25::DOUBLE) * (1 - b * b * 0.25::DOUBLE) ELSE {_ramps(["fa", "-fa", "fb", "-fb"])} END AS w FROM k)
    SELECT su.id, {q.r("coalesce(CASE WHEN sum(w) <> 0 THEN sum(w * pw.v) / sum(w) ELSE 0.0 END, 0.0)")} AS v FROM su LEFT JOIN pw ON tgt_id = su.id GROUP BY su.id"""
)
def swarm_mixed_kernels(spark, sf_dir):
    """One swarm of three kernels, three geometries and two lengths, scattered in one plan."""
    s, t = _swarms(spark, sf_dir)
    kind = F.col("id") % 3
    facets = F.array(*[F.array(F.lit(a), F.lit(b), F.lit(0.05)) for a, b in ((-1.0, 0.0), (0.0, -1.0), (0.0, 1.0), (1.0, 0.0))])
    length = {h: F.when(F.col("id") % 2 == 0, F.col(h)).otherwise(1.5 * F.col(h)) for h in ("hx", "hy")}
    kernel = F.when(kind == 0, "b4").when(kind == 1, "epanechnikov").otherwise("polyramp")
    geometry = F.when(kind == 0, "elliptic").when(kind == 1, "tensor").otherwise("faceted")
    return _rounded(swarm_remap(s.withColumns({**length, "kernel": kernel, "geometry": geometry, "facets": facets}), t, ["v"], 2, geometry="own", center="scatter"), "v")


@query(
    f"""WITH {q.polygon_sizes()}, {q.polygon_mesh('s', 'n')}, {q.suppliers(0.0625)}, once AS (SELECT least(na, nb) AS lo, greatest(na, nb) AS hi, count(*) AS cells FROM s_side GROUP BY 1, 2),
    f AS (SELECT s.id, cx, cy, (ey - ay) / sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) AS nx, (ax - ex) / sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) AS ny, (ax + ex) / 2 AS fx, (ay + ey) / 2 AS fy, CASE WHEN cells = 1 THEN 0.75::DOUBLE ELSE 1.0 END AS share
      FROM s_side s JOIN once ON lo = least(na, nb) AND hi = greatest(na, nb)),
    h AS (SELECT *, share * 2 * ((fx - cx) * nx + (fy - cy) * ny) AS h FROM f),
    box AS (SELECT id, any_value(cx) AS cx, any_value(cy) AS cy, max(ax) - min(ax) AS wide, max(ay) - min(ay) AS high FROM s_side GROUP BY id),
    near AS (SELECT su.id AS tgt_id, su.x, su.y, box.id FROM su JOIN box ON abs(su.x - cx) < 4 * wide AND abs(su.y - cy) < 4 * high),
    along AS (SELECT tgt_id, id, ((x - cx) * nx + (y - cy) * ny) / h AS z FROM near JOIN h USING (id)), pw AS (SELECT tgt_id, id, product({_ramp("z")}) AS w FROM along GROUP BY tgt_id, id),
    cv AS (SELECT c.id, v FROM s_cell c JOIN s_node n ON n.id = ns[1])
    SELECT su.id, {q.shifted("coalesce(CASE WHEN sum(w) <> 0 THEN sum(w * cv.v) / sum(w) ELSE 0.0 END, 0.0)")} AS v FROM su LEFT JOIN pw ON tgt_id = su.id LEFT JOIN cv ON cv.id = pw.id GROUP BY su.id"""
)
def swarm_polygon_facets(spark, sf_dir):
    """Polygon cells as faceted particles, with shorter supports across the mesh's boundary, scattered to the suppliers."""
    (nodes, mesh), _ = _polygons(spark, sf_dir)
    value = mesh.select("id", F.element_at("nodes", 1).alias("node")).join(nodes.select(F.col("id").alias("node"), "v"), "node").select("id", "v")
    swarm = particles.facets_of_cells(mesh, particles.polygon_faces(mesh), 2, boundary_factor=0.75).join(value, "id")
    t = tables.supplier_swarm(spark, sf_dir, 0.0625)
    return _shifted(swarm_remap(swarm, t, ["v"], 2, kernel="polyramp", geometry="faceted", center="scatter"), "v")


#: Arguments of kernels: the quantities of lineitem, from -2.4 to 2.5 (or off those by half a step), in groups by line number.
_ARGUMENTS = "SELECT l_linenumber AS id, (l_quantity - {}) / 10 AS x FROM lineitem"


def _arguments(spark: SparkSession, sf_dir: str, middle: float) -> DataFrame:
    return tables.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), ((F.col("l_quantity") - middle) / 10).alias("x"))


def _kernel_sums(df: DataFrame, values: dict[str, Column], digits: int) -> DataFrame:
    return _shifted(df.groupBy("id").agg(*[F.sum(v).alias(k) for k, v in values.items()]), *values, digits=digits)


def _kernel_sql() -> str:
    a = "abs(x)"
    total = lambda e: q.shifted(f"sum({e})", 6)
    return f"""WITH p AS ({_ARGUMENTS.format("25")})
    SELECT id, {total(q.b4(a))} AS b4, {total(f"CASE WHEN {a} < 2 THEN 0.375::DOUBLE * (1 - x * x * 0.25::DOUBLE) ELSE 0.0 END")} AS epanechnikov, {total(f"CASE WHEN {a} <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS square,
      {total(_ramp("x"))} AS polyramp, {total("CASE WHEN x <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS step FROM p GROUP BY id"""


@query(_kernel_sql())
def kernel_values(spark, sf_dir):
    return _kernel_sums(_arguments(spark, sf_dir, 25.0), {k: kernels.kernel(k, F.col("x")) for k in ("b4", "epanechnikov", "square", "polyramp", "step")}, 6)


def _slope_sql() -> str:
    a, sign = "abs(x)", "sign(x)"
    total = lambda e: q.shifted(f"sum({e})", 6)
    return f"""WITH p AS ({_ARGUMENTS.format("25.5::DOUBLE")})
    SELECT id, {total(f"CASE WHEN {a} <= 1 THEN -3 * x + 2.25::DOUBLE * x * {a} WHEN {a} < 2 THEN -0.75::DOUBLE * pow(2 - {a}, 2) * {sign} ELSE 0.0 END")} AS b4,
      {total(f"CASE WHEN {a} < 2 THEN -0.1875::DOUBLE * x ELSE 0.0 END")} AS epanechnikov,
      {total(f"CASE WHEN {a} < 2 THEN {sign} * (1.5::DOUBLE * {a} * {a} - {a} - 2) / pow({a}, 1.5::DOUBLE) ELSE 0.0 END")} AS invsqrt, {total(f"-{sign} / (x * x)")} AS coulomb FROM p GROUP BY id"""


@query(_slope_sql())
def kernel_slopes(spark, sf_dir):
    return _kernel_sums(_arguments(spark, sf_dir, 25.5), {k: kernels.kernel(k, F.col("x"), 1) for k in ("b4", "epanechnikov", "invsqrt", "coulomb")}, 6)


@query(
    f"""WITH p AS ({_ARGUMENTS.format("25")}), each AS (SELECT DISTINCT x FROM p), piece AS (SELECT x, k::DOUBLE AS a, least(x, k + 1) AS b FROM each, (SELECT unnest([-2, -1, 0, 1]) AS k) WHERE x > k),
    simpson AS (SELECT x, sum((b - a) / 6 * (({q.b4("abs(a)")}) + 4 * ({q.b4("abs((a + b) / 2)")}) + ({q.b4("abs(b)")}))) / 1.5::DOUBLE AS share FROM piece GROUP BY x)
    SELECT id, {q.shifted("sum(coalesce(share, 0.0))", 8)} AS share FROM p LEFT JOIN simpson USING (x) GROUP BY id"""
)
def kernel_integral(spark, sf_dir):
    """Shares of the cubic B-spline below each argument; the SQL integrates the kernel by Simpson's rule, exact for cubics."""
    return _kernel_sums(_arguments(spark, sf_dir, 25.0), {"share": kernels.b4_integral(F.col("x"))}, 8)
