"""Builders of plain SQL for the registered queries: the same meshes, joins and sums as common table expressions."""

from __future__ import annotations


def r(x: str) -> str:
    """Six decimals, no negative zero."""
    return f"(round({x}, 6) + 0.0)"


def shifted(x: str, digits: int = 4) -> str:
    """Rounded after a shift of 0.3 of the last digit, off the exact halves."""
    return f"round({x} + 3e-{digits + 1}::DOUBLE, {digits})"


def grid(name: str, n: int, lo: tuple[float, float] = (0.0, 0.0), hi: tuple[float, float] = (1.0, 1.0)) -> str:
    wx, wy = hi[0] - lo[0], hi[1] - lo[1]
    return f"""{name} AS (
      SELECT id, ix, iy, xlo, xhi, ylo, yhi, (xhi - xlo) * (yhi - ylo) AS vol, (xlo + xhi) / 2 AS cx, (ylo + yhi) / 2 AS cy,
             ix = 0 OR ix = {n - 1} OR iy = 0 OR iy = {n - 1} AS edge
      FROM (SELECT id, ix, iy, {lo[0]}::DOUBLE + ix * {wx}::DOUBLE / {n} AS xlo, {lo[0]}::DOUBLE + (ix + 1) * {wx}::DOUBLE / {n} AS xhi,
                   {lo[1]}::DOUBLE + iy * {wy}::DOUBLE / {n} AS ylo, {lo[1]}::DOUBLE + (iy + 1) * {wy}::DOUBLE / {n} AS yhi
            FROM (SELECT id, id % {n} AS ix, id // {n} AS iy FROM (SELECT unnest(range({n * n})) AS id))))"""


def lineitem_cells(n: int) -> str:
    return f"""li AS (SELECT *, (least(floor((l_quantity - 1) / 49 * {n}), {n - 1}) + least(floor(l_discount / 0.1::DOUBLE * {n}), {n - 1}) * {n})::BIGINT AS id FROM lineitem)"""


def source(n: int, lo=(0.0, 0.0), hi=(1.0, 1.0)) -> str:
    """``s``: the grid with qty and price."""
    return f"""{grid("s0", n, lo, hi)}, {lineitem_cells(n)},
    sv AS (SELECT id, sum(l_quantity) AS qty, floor(avg(l_extendedprice))::DOUBLE AS price FROM li GROUP BY id),
    s AS (SELECT s0.*, coalesce(qty, 0.0) AS qty, coalesce(price, 0.0) AS price FROM s0 LEFT JOIN sv USING (id))"""


def weights(name: str = "w", t: str = "t", s: str = "s", extra: str = "") -> str:
    return f"""{name} AS (
      SELECT tgt_id, src_id, m0, m0 * mx AS m1x, m0 * my AS m1y FROM (
        SELECT t.id AS tgt_id, s.id AS src_id, (least(t.xhi, s.xhi) - greatest(t.xlo, s.xlo)) * (least(t.yhi, s.yhi) - greatest(t.ylo, s.ylo)) AS m0,
               (least(t.xhi, s.xhi) + greatest(t.xlo, s.xlo)) / 2 AS mx, (least(t.yhi, s.yhi) + greatest(t.ylo, s.ylo)) / 2 AS my
        FROM {t} t JOIN {s} s ON greatest(t.xlo, s.xlo) < least(t.xhi, s.xhi) AND greatest(t.ylo, s.ylo) < least(t.yhi, s.yhi) {extra}) WHERE m0 > 0)"""


def gradients(fields: list[str], limited: bool, s: str = "s", name: str = "g", edge: str = "1.0") -> str:
    """``g``: id and gx_f, gy_f, limited inside, times ``edge`` (or limited too, if empty) at the boundary; stencils of up to eight neighbours."""
    sums = ", ".join(
        f"sum((n.cx - c.cx) * (n.{f} - c.{f})) AS bx_{f}, sum((n.cy - c.cy) * (n.{f} - c.{f})) AS by_{f}, least(min(n.{f}), min(c.{f})) AS lo_{f}, greatest(max(n.{f}), max(c.{f})) AS hi_{f}" for f in fields
    )
    raw = ", ".join(f"(bx_{f} * yy - by_{f} * xy) / (xx * yy - xy * xy) AS rx_{f}, (xx * by_{f} - xy * bx_{f}) / (xx * yy - xy * xy) AS ry_{f}" for f in fields)

    def phi(f: str) -> str:
        if not limited:
            return "1.0::DOUBLE"
        slopes = []
        for ex in ("xlo", "xhi"):
            for ey in ("ylo", "yhi"):
                d = f"(rx_{f} * ({ex} - cx) + ry_{f} * ({ey} - cy))"
                slopes.append(f"CASE WHEN {d} = 0 THEN 1.0 WHEN {d} > 0 THEN (hi_{f} - {f}) / {d} ELSE (lo_{f} - {f}) / {d} END")
        inside = f"least(1.0, {', '.join(slopes)})"
        return f"CASE WHEN edge THEN {edge} ELSE {inside} END" if edge else inside

    out = ", ".join(f"rx_{f} * ({phi(f)}) AS gx_{f}, ry_{f} * ({phi(f)}) AS gy_{f}" for f in fields)
    return f"""{name}_sum AS (
      SELECT c.id, sum((n.cx - c.cx) * (n.cx - c.cx)) AS xx, sum((n.cx - c.cx) * (n.cy - c.cy)) AS xy, sum((n.cy - c.cy) * (n.cy - c.cy)) AS yy, {sums}
      FROM {s} c JOIN {s} n ON abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1 AND n.id <> c.id GROUP BY c.id),
    {name}_raw AS (SELECT id, {raw}, {", ".join(f"lo_{f}, hi_{f}" for f in fields)} FROM {name}_sum),
    {name} AS (SELECT id, {out} FROM {name}_raw JOIN {s} USING (id))"""


def first_order(fields: list[str], name: str = "o", s: str = "s", w: str = "w", t: str = "t") -> str:
    terms = ", ".join(f"sum({f} * m0) / sum(m0) AS {f}" for f in fields)
    back = ", ".join(f"coalesce({name}_v.{f}, 0.0) AS {f}" for f in fields)
    return f"""{name}_v AS (SELECT tgt_id AS id, {terms} FROM {w} JOIN {s} s ON s.id = src_id WHERE abs(m0) >= 2.220446049250313e-16 GROUP BY tgt_id),
    {name} AS (SELECT {t}.id, {back} FROM {t} LEFT JOIN {name}_v ON {name}_v.id = {t}.id)"""


def second_order(fields: list[str], name: str = "o", s: str = "s", g: str = "g", w: str = "w", t: str = "t") -> str:
    terms = ", ".join(f"sum(({f} + gx_{f} * (m1x / m0 - cx) + gy_{f} * (m1y / m0 - cy)) * m0) / sum(m0) AS {f}" for f in fields)
    back = ", ".join(f"coalesce({name}_v.{f}, 0.0) AS {f}" for f in fields)
    return f"""{name}_v AS (SELECT tgt_id AS id, {terms} FROM {w} JOIN {s} s ON s.id = src_id JOIN {g} g ON g.id = src_id WHERE abs(m0) > 2.220446049250313e-16 GROUP BY tgt_id),
    {name} AS (SELECT {t}.id, {back} FROM {t} LEFT JOIN {name}_v ON {name}_v.id = {t}.id)"""


def customers(h: float) -> str:
    return f"""cu AS (SELECT c_custkey AS id, (c_custkey % 64 + 0.5::DOUBLE) / 64 AS x, ((floor(c_acctbal) % 128 + 128) % 128) / 128::DOUBLE AS y, {h}::DOUBLE AS h, floor(c_acctbal)::DOUBLE AS v FROM customer)"""


def suppliers(h: float) -> str:
    return f"""su AS (SELECT s_suppkey AS id, (s_suppkey % 32 + 0.5::DOUBLE) / 32 AS x, ((floor(s_acctbal) % 64 + 64) % 64) / 64::DOUBLE AS y, {h}::DOUBLE AS h, floor(s_acctbal)::DOUBLE AS v FROM supplier)"""


def b4(x: str) -> str:
    return f"CASE WHEN {x} <= 1 THEN 1 - 1.5::DOUBLE * {x} * {x} + 0.75::DOUBLE * {x} * {x} * {x} WHEN {x} < 2 THEN pow(2 - {x}, 3) / 4 ELSE 0.0 END"


def quadratics(field: str, s: str = "s", name: str = "f") -> str:
    """``f``: id and gx, gy, hxx, hxy, hyy; inside, odd sums over the full stencil vanish, at the boundary a line is fitted."""
    return f"""{name}_sum AS (
      SELECT c.id, any_value(c.edge) AS edge, sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, sum(dx * dv) AS bx, sum(dy * dv) AS byy0, sum(pow(dx, 4)) AS x4, sum(dx * dx * dy * dy) AS x2y2,
             sum(pow(dy, 4)) AS y4, sum(dx * dx * dv) AS bxx, sum(dx * dy * dv) AS bxy, sum(dy * dy * dv) AS byy
      FROM {s} c, LATERAL (SELECT n.cx - c.cx AS dx, n.cy - c.cy AS dy, n.{field} - c.{field} AS dv FROM {s} n WHERE abs(n.ix - c.ix) <= 1 AND abs(n.iy - c.iy) <= 1 AND n.id <> c.id) GROUP BY c.id),
    {name} AS (SELECT id, (bx * yy - byy0 * xy) / (xx * yy - xy * xy) AS gx, (xx * byy0 - xy * bx) / (xx * yy - xy * xy) AS gy,
      CASE WHEN edge THEN 0.0 ELSE (bxx * y4 - byy * x2y2) / (x4 * y4 - x2y2 * x2y2) END AS hxx, CASE WHEN edge THEN 0.0 ELSE bxy / x2y2 END AS hxy,
      CASE WHEN edge THEN 0.0 ELSE (byy * x4 - bxx * x2y2) / (x4 * y4 - x2y2 * x2y2) END AS hyy FROM {name}_sum)"""


def regression(pairs: str, terms: list[str], name: str = "lr") -> str:
    """``lr``: tgt_id and x0.. of the weighted least squares of v over the terms, by elimination; zeros with too few pairs."""
    n = len(terms)
    sums = ", ".join([f"sum(w * ({terms[i]}) * ({terms[j]})) AS m{i}_{j}" for i in range(n) for j in range(i, n)] + [f"sum(w * ({terms[i]}) * v) AS r{i}" for i in range(n)])
    steps = [f"{name}_0 AS (SELECT tgt_id, {sums} FROM {pairs} GROUP BY tgt_id HAVING count(*) >= {n})"]
    for k in range(n - 1):
        kept = [f"m{i}_{j}" for i in range(k + 1) for j in range(i, n)] + [f"r{i}" for i in range(k + 1)]
        less = [f"m{i}_{j} - m{k}_{i} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i in range(k + 1, n) for j in range(i, n)] + [f"r{i} - m{k}_{i} * r{k} / m{k}_{k} AS r{i}" for i in range(k + 1, n)]
        steps.append(f"{name}_{k + 1} AS (SELECT tgt_id, {', '.join(kept + less)} FROM {name}_{k})")
    last = f"{name}_{n - 1}"
    for k in reversed(range(n)):
        taken = "".join(f" - m{k}_{j} * x{j}" for j in range(k + 1, n))
        steps.append(f"{name}_x{k} AS (SELECT *, (r{k}{taken}) / m{k}_{k} AS x{k} FROM {last})")
        last = f"{name}_x{k}"
    steps.append(f"{name} AS (SELECT tgt_id, {', '.join(f'x{k}' for k in range(n))} FROM {last})")
    return ", ".join(steps)


def conserved(values: str, passes: int = 5) -> str:
    """``p5``: id and price after up to five global shifts, clamped to the source's bounds; ``values`` has id, price, vol, o."""
    out = [f"p0 AS ({values})", "b AS (SELECT (SELECT min(price) FROM s) AS lo, (SELECT max(price) FROM s) AS hi, (SELECT sum(price * vol) FROM s) AS wanted, (SELECT sum(CASE WHEN o THEN vol END) FROM p0) AS whole)",
           "a0 AS (SELECT sum(price * vol) - any_value(wanted) AS diff, any_value(whole) AS volume, abs((sum(price * vol) - any_value(wanted)) / any_value(wanted)) > 2.220446049250313e-14 AS live FROM p0, b)"]
    for k in range(1, passes + 1):
        out.append(f"""p{k} AS (SELECT id, vol, o, CASE WHEN live AND o THEN least(greatest(price - diff / volume, lo), hi) ELSE price END AS price, live AND o AND (price - diff / volume < lo OR price - diff / volume > hi) AS held FROM p{k - 1}, a{k - 1}, b),
        a{k} AS (SELECT sum(price * vol) - any_value(wanted) AS diff, any_value(whole) - coalesce(sum(CASE WHEN held THEN vol END), 0.0) AS volume, any_value(a{k - 1}.live) AND abs((sum(price * vol) - any_value(wanted)) / any_value(wanted)) > 2.220446049250313e-14
          AND any_value(whole) - coalesce(sum(CASE WHEN held THEN vol END), 0.0) > 2.220446049250313e-16 * any_value(whole) AS live FROM p{k}, b, a{k - 1})""")
    return ", ".join(out)


def polygon_sizes(share: float = 0.75) -> str:
    """``z``: n and m, one source cell for each 256 rows of lineitem."""
    return f"z AS (SELECT greatest(4, floor(sqrt(count(*) / 256.0)))::BIGINT AS n, greatest(3, floor(sqrt(count(*) / 256.0) * {share}::DOUBLE))::BIGINT AS m FROM lineitem)"


def polygon_mesh(p: str, size: str) -> str:
    """``{p}_node``, ``{p}_side`` and ``{p}_wedge`` of the polygon mesh derived from lineitem; ``size`` is a column of ``z``."""
    return f"""{p}_rows AS (SELECT (least(floor((l_quantity - 1) / 49 * {size}), {size} - 1) + least(floor(l_discount / 0.1::DOUBLE * {size}), {size} - 1) * {size})::BIGINT AS cell, count(*) AS k, sum(l_quantity) AS q, floor(avg(l_extendedprice))::DOUBLE AS v
      FROM lineitem, z GROUP BY 1),
    {p}_grid AS (SELECT id, id % (n + 1) AS i, id // (n + 1) AS j, n FROM (SELECT {size} AS n, unnest(range(({size} + 1) * ({size} + 1))) AS id FROM z)),
    {p}_node AS (
      SELECT id, i = 0 OR i = n OR j = 0 OR j = n AS edge, coalesce(v, 0.0) AS v,
             (i + CASE WHEN i > 0 AND i < n AND j > 0 AND j < n THEN (coalesce(k, 0) % 7 - 3) / 20::DOUBLE ELSE 0.0 END) / n AS x,
             (j + CASE WHEN i > 0 AND i < n AND j > 0 AND j < n THEN (floor(coalesce(q, 0.0)) % 5 - 2) / 20::DOUBLE ELSE 0.0 END) / n AS y
      FROM {p}_grid LEFT JOIN {p}_rows ON cell = least(i, n - 1) + least(j, n - 1) * n),
    {p}_square AS (SELECT c.cell, n, c.cell % n + (c.cell // n) * (n + 1) AS low, coalesce(k, 0) AS k FROM (SELECT {size} AS n, unnest(range({size} * {size})) AS cell FROM z) c LEFT JOIN {p}_rows r ON r.cell = c.cell),
    {p}_cell AS (
      SELECT cell * 2 AS id, CASE WHEN k % 3 = 0 THEN [low, low + 1, low + n + 2] ELSE [low, low + 1, low + n + 2, low + n + 1] END AS ns FROM {p}_square
      UNION ALL SELECT cell * 2 + 1, [low, low + n + 2, low + n + 1] FROM {p}_square WHERE k % 3 = 0),
    {p}_edge AS (
      SELECT e.id, na, nb, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM (SELECT id, ns[s] AS na, ns[s % len(ns) + 1] AS nb FROM {p}_cell, LATERAL (SELECT unnest(range(1, len(ns) + 1)) AS s)) e
      JOIN {p}_node a ON a.id = na JOIN {p}_node b ON b.id = nb),
    {p}_middle AS (SELECT id, sum(ax * ey - ex * ay) / 2 AS vol, sum((ax + ex) * (ax * ey - ex * ay)) / (3 * sum(ax * ey - ex * ay)) AS cx, sum((ay + ey) * (ax * ey - ex * ay)) / (3 * sum(ax * ey - ex * ay)) AS cy FROM {p}_edge GROUP BY id),
    {p}_side AS (SELECT * FROM {p}_edge JOIN {p}_middle USING (id)),
    {p}_wedge AS (
      SELECT id AS cell, na AS node, ax AS x1, ay AS y1, (ax + ex) / 2 AS x2, (ay + ey) / 2 AS y2, cx AS x3, cy AS y3 FROM {p}_side
      UNION ALL SELECT id, nb, (ax + ex) / 2, (ay + ey) / 2, ex, ey, cx, cy FROM {p}_side)"""


def wedge_overlaps() -> str:
    """``ov``: tgt_cell, tgt_node, src_cell, src_node, m0, m1x, m1y of the wedges of ``t`` and ``s``: each triangle of one cut by
    the three edges of the other."""

    def cut(k: int, ux: str, uy: str, vx: str, vy: str) -> str:
        far = "q[i % len(q) + 1]"
        return f"""d{k} AS (SELECT * EXCLUDE (p), list_transform(p, lambda c: {{'x': c.x, 'y': c.y, 'd': ({vx} - {ux}) * (c.y - {uy}) - ({vy} - {uy}) * (c.x - {ux})}}) AS q FROM c{k}),
    c{k + 1} AS (SELECT * EXCLUDE (q), flatten(list_transform(range(1, len(q) + 1), lambda i: list_concat(
        CASE WHEN q[i].d >= 0 THEN [{{'x': q[i].x, 'y': q[i].y}}] ELSE [] END,
        CASE WHEN (q[i].d >= 0) <> ({far}.d >= 0) THEN [{{'x': q[i].x + ({far}.x - q[i].x) * q[i].d / (q[i].d - {far}.d), 'y': q[i].y + ({far}.y - q[i].y) * q[i].d / (q[i].d - {far}.d)}}] ELSE [] END))) AS p FROM d{k})"""

    cross = "(p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y)"
    total = lambda e: f"coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: {e})), 0.0)"
    return f"""c0 AS (
      SELECT t.cell AS tgt_cell, t.node AS tgt_node, s.cell AS src_cell, s.node AS src_node, t.x1, t.y1, t.x2, t.y2, t.x3, t.y3, [{{'x': s.x1, 'y': s.y1}}, {{'x': s.x2, 'y': s.y2}}, {{'x': s.x3, 'y': s.y3}}] AS p
      FROM t_wedge t JOIN s_wedge s ON greatest(least(t.x1, t.x2, t.x3), least(s.x1, s.x2, s.x3)) < least(greatest(t.x1, t.x2, t.x3), greatest(s.x1, s.x2, s.x3))
        AND greatest(least(t.y1, t.y2, t.y3), least(s.y1, s.y2, s.y3)) < least(greatest(t.y1, t.y2, t.y3), greatest(s.y1, s.y2, s.y3))),
    {cut(0, "x1", "y1", "x2", "y2")}, {cut(1, "x2", "y2", "x3", "y3")}, {cut(2, "x3", "y3", "x1", "y1")},
    ov AS (SELECT * FROM (SELECT tgt_cell, tgt_node, src_cell, src_node, {total(cross)} / 2 AS m0, {total(f"(p[i].x + p[i % len(p) + 1].x) * {cross}")} / 6 AS m1x, {total(f"(p[i].y + p[i % len(p) + 1].y) * {cross}")} / 6 AS m1y FROM c3 WHERE len(p) > 2) WHERE m0 > 0)"""


def duals(p: str) -> str:
    """``{p}_dual``: id, vol, centroid of the cells around the nodes, from their wedges."""
    area = "((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2"
    return f"{p}_dual AS (SELECT node AS id, sum({area}) AS vol, sum({area} * (x1 + x2 + x3) / 3) / sum({area}) AS cx, sum({area} * (y1 + y2 + y3) / 3) / sum({area}) AS cy FROM {p}_wedge GROUP BY node)"


def node_slopes() -> str:
    """``g``: gradients of ``s_node.v`` over the nodes that share a cell, limited at the points of the dual cells inside."""
    slope = "(rx * (qx - x) + ry * (qy - y))"
    return f"""near AS (SELECT DISTINCT a.node AS id, b.node AS nbr FROM (SELECT DISTINCT cell, node FROM s_wedge) a JOIN (SELECT DISTINCT cell, node FROM s_wedge) b USING (cell) WHERE a.node <> b.node),
    sums AS (SELECT c.id, sum((n.x - c.x) * (n.x - c.x)) AS xx, sum((n.x - c.x) * (n.y - c.y)) AS xy, sum((n.y - c.y) * (n.y - c.y)) AS yy, sum((n.x - c.x) * (n.v - c.v)) AS ex, sum((n.y - c.y) * (n.v - c.v)) AS ey,
             least(min(n.v), min(c.v)) AS lo, greatest(max(n.v), max(c.v)) AS hi FROM near JOIN s_node c USING (id) JOIN s_node n ON n.id = nbr GROUP BY c.id),
    raw AS (SELECT id, x, y, v, edge, lo, hi, (ex * yy - ey * xy) / (xx * yy - xy * xy) AS rx, (xx * ey - xy * ex) / (xx * yy - xy * xy) AS ry FROM sums JOIN s_node USING (id)),
    ends AS (SELECT node AS id, unnest([x1, x2, x3]) AS qx, unnest([y1, y2, y3]) AS qy FROM s_wedge),
    g AS (SELECT id, any_value(v) AS v, any_value(x) AS x, any_value(y) AS y, any_value(rx) * min(phi) AS gx, any_value(ry) * min(phi) AS gy FROM (
      SELECT raw.*, CASE WHEN edge OR {slope} = 0 THEN 1.0 WHEN {slope} > 0 THEN least(1.0, (hi - v) / {slope}) ELSE least(1.0, (lo - v) / {slope}) END AS phi FROM raw JOIN ends USING (id)) GROUP BY id)"""


def conserved_by_part(values: str, passes: int = 5) -> str:
    """``p5``: as ``conserved``, for each part by its own bounds and totals; ``values`` has id, part, price, vol, o, ``s`` a part."""
    off = "abs(diff / wanted) > 2.220446049250313e-14"
    out = [f"p0 AS ({values})", "b AS (SELECT part, min(price) AS lo, max(price) AS hi, sum(price * vol) AS wanted FROM s GROUP BY part)",
           f"a0 AS (SELECT *, diff / whole AS step, {off} AS live FROM (SELECT part, sum(price * vol) - any_value(wanted) AS diff, sum(CASE WHEN o THEN vol END) AS whole, any_value(wanted) AS wanted, any_value(lo) AS lo, any_value(hi) AS hi FROM p0 JOIN b USING (part) GROUP BY part))"]
    for k in range(1, passes + 1):
        out.append(f"""p{k} AS (SELECT id, part, vol, o, CASE WHEN live AND o THEN least(greatest(price - step, lo), hi) ELSE price END AS price, live AND o AND (price - step < lo OR price - step > hi) AS held FROM p{k - 1} JOIN a{k - 1} USING (part)),
        a{k} AS (SELECT *, CASE WHEN whole - c > 0 THEN diff / (whole - c) ELSE 0.0 END AS step, was AND {off} AND whole - c > 2.220446049250313e-16 * whole AS live FROM (
          SELECT part, sum(price * vol) - any_value(a.wanted) AS diff, coalesce(sum(CASE WHEN held THEN vol END), 0.0) AS c, any_value(a.live) AS was, any_value(whole) AS whole, any_value(a.wanted) AS wanted, any_value(a.lo) AS lo, any_value(a.hi) AS hi FROM p{k} JOIN a{k - 1} a USING (part) GROUP BY part))""")
    return ", ".join(out)


def corners(p: str) -> str:
    """``{p}_corner``: cell, node, part, x, y: the wedges of a cell at one of its nodes."""
    area = "((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2"
    return f"{p}_corner AS (SELECT cell, node, sum({area}) AS part, sum({area} * (x1 + x2 + x3) / 3) / sum({area}) AS x, sum({area} * (y1 + y2 + y3) / 3) / sum({area}) AS y FROM {p}_wedge GROUP BY cell, node)"


def cell_slopes(p: str, cells: str, fields: list[str], name: str) -> str:
    """``name``: least-squares gradients of ``cells`` (id, cx, cy, fields) of the polygon mesh over cells that share a node."""
    sums = ", ".join(f"sum((n.cx - c.cx) * (n.{f} - c.{f})) AS ex_{f}, sum((n.cy - c.cy) * (n.{f} - c.{f})) AS ey_{f}" for f in fields)
    solved = ", ".join(f"(ex_{f} * yy - ey_{f} * xy) / (xx * yy - xy * xy) AS gx_{f}, (xx * ey_{f} - xy * ex_{f}) / (xx * yy - xy * xy) AS gy_{f}" for f in fields)
    return f"""{name} AS (SELECT id, {solved} FROM (
      SELECT c.id, sum((n.cx - c.cx) * (n.cx - c.cx)) AS xx, sum((n.cx - c.cx) * (n.cy - c.cy)) AS xy, sum((n.cy - c.cy) * (n.cy - c.cy)) AS yy, {sums}
      FROM (SELECT DISTINCT a.cell AS id, b.cell AS nbr FROM {p}_wedge a JOIN {p}_wedge b USING (node) WHERE a.cell <> b.cell) JOIN {cells} c USING (id) JOIN {cells} n ON n.id = nbr GROUP BY c.id))"""
