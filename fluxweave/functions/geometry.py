"""Bounding-box algebra and polygon moments as column expressions; boxes are ``{axis}lo``/``{axis}hi`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Coordinate systems of box meshes by dimension.
SYSTEMS = {
    "cartesian": (1, 2, 3), "cylindrical_radial": (1,), "spherical_radial": (1,), "cylindrical_axisymmetric": (2,), "cylindrical_polar": (2,), "cylindrical_3d": (3,),
}


def axes(dim: int) -> tuple[str, ...]:
    return AXES[:dim]


def col(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def overlaps(a: str, b: str, dim: int, closed: bool = True) -> Column:
    """Boxes meet; ``closed`` also counts touching ones."""
    out = F.lit(True)
    for ax in axes(dim):
        lo, hi = F.greatest(col(a, ax + "lo"), col(b, ax + "lo")), F.least(col(a, ax + "hi"), col(b, ax + "hi"))
        out = out & ((lo <= hi) if closed else (lo < hi))
    return out


def contains(box: str, point: str, dim: int) -> Column:
    """Closed containment of a point (columns x, y, z) in a box."""
    out = F.lit(True)
    for ax in axes(dim):
        out = out & (col(box, ax + "lo") <= col(point, ax)) & (col(point, ax) <= col(box, ax + "hi"))
    return out


def center(alias: str | None, dim: int) -> list[Column]:
    return [(col(alias, ax + "lo") + col(alias, ax + "hi")) / 2 for ax in axes(dim)]


def radius(alias: str | None, dim: int) -> Column:
    return F.sqrt(sum((F.pow(col(alias, ax + "hi") - col(alias, ax + "lo"), 2.0) for ax in axes(dim)), F.lit(0.0))) / 2


def long_axis(alias: str | None, dim: int) -> Column:
    """The first axis of the largest width."""
    width = [col(alias, ax + "hi") - col(alias, ax + "lo") for ax in axes(dim)]
    out = F.lit(0)
    for d in range(dim - 1, -1, -1):
        out = F.when(width[d] >= F.greatest(*width) if dim > 1 else F.lit(True), F.lit(d)).otherwise(out)
    return out


def box_volume(alias: str | None, dim: int) -> Column:
    out = F.lit(1.0)
    for ax in axes(dim):
        out = out * (col(alias, ax + "hi") - col(alias, ax + "lo"))
    return out


def bulge(df, dim: int, amount: Column | float):
    for ax in axes(dim):
        df = df.withColumns({ax + "lo": F.col(ax + "lo") - amount, ax + "hi": F.col(ax + "hi") + amount})
    return df


def ray_interval(alias: str | None, origin: list[Column], direction: list[Column]) -> tuple[Column, Column]:
    """Slab test: entry and exit parameter of a ray through the box (exit < entry: it misses)."""
    enter, leave = F.lit(-math.inf), F.lit(math.inf)
    for ax, o, d in zip(AXES, origin, direction, strict=False):
        lo, hi = col(alias, ax + "lo"), col(alias, ax + "hi")
        flat, inside = d == 0, (o >= lo) & (o <= hi)
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        t0, t1 = (lo - o) / safe, (hi - o) / safe
        enter = F.greatest(enter, F.when(flat, F.when(inside, F.lit(-math.inf)).otherwise(F.lit(math.inf))).otherwise(F.least(t0, t1)))
        leave = F.least(leave, F.when(flat, F.when(inside, F.lit(math.inf)).otherwise(F.lit(-math.inf))).otherwise(F.greatest(t0, t1)))
    return enter, leave


def moments(lo: list[Column], hi: list[Column], system: str = "cartesian") -> tuple[Column, list[Column]]:
    """Volume and first moments of a box in a coordinate system: integrals of 1 and of each coordinate.

    Measures: radial cylindrical r dr (times 2 pi), spherical r^2 dr (times 4 pi), axisymmetric r dr dz (times 2 pi),
    polar r dr dphi, 3-D cylindrical r dr dphi dz.
    """
    dim = len(lo)
    if dim not in SYSTEMS.get(system, ()):
        raise ValueError(f"{system} boxes have {SYSTEMS.get(system)} dimensions")
    power = {"cartesian": 0, "spherical_radial": 2}.get(system, 1)
    factor = {"cylindrical_radial": 2 * math.pi, "spherical_radial": 4 * math.pi, "cylindrical_axisymmetric": 2 * math.pi}.get(system, 1.0)

    def integral(d: int, extra: int) -> Column:
        p = (power if d == 0 else 0) + extra
        if p == 0:
            return hi[d] - lo[d]
        if p == 1:
            return (hi[d] - lo[d]) * (hi[d] + lo[d]) / 2
        return (F.pow(hi[d], F.lit(p + 1.0)) - F.pow(lo[d], F.lit(p + 1.0))) / (p + 1)

    def product(extra: int | None) -> Column:
        out = F.lit(factor) if factor != 1.0 else None
        for d in range(dim):
            part = integral(d, int(extra == d))
            out = part if out is None else out * part
        return out

    return product(None), [product(d) for d in range(dim)]


def polygon_moments(ring: Column) -> Column:
    """Shoelace struct<m0, m1x, m1y> (signed, counter-clockwise positive) of array<struct<x, y>>."""
    n = F.size(ring)
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q"), (p["x"] * q["y"] - q["x"] * p["y"]).alias("c")))
    start = F.struct(F.lit(0.0).alias("m0"), F.lit(0.0).alias("m1x"), F.lit(0.0).alias("m1y"))
    return F.aggregate(
        pairs,
        start,
        lambda s, e: F.struct(
            (s["m0"] + e["c"] / 2).alias("m0"),
            (s["m1x"] + e["c"] * (e["p"]["x"] + e["q"]["x"]) / 6).alias("m1x"),
            (s["m1y"] + e["c"] * (e["p"]["y"] + e["q"]["y"]) / 6).alias("m1y"),
        ),
    )


def is_convex(ring: Column, tolerance: float) -> Column:
    """No vertex of a counter-clockwise ring turns right by more than a distance of ``tolerance``."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, F.pmod(i, n) + 1)

    def turn(i: Column) -> Column:
        a, b, c = at(i), at(i + 1), at(i + 2)
        cross = (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
        length = F.sqrt(F.pow(b["x"] - a["x"], 2.0) + F.pow(b["y"] - a["y"], 2.0))
        return cross >= -tolerance * length

    return F.forall(F.sequence(F.lit(0), n - 1), turn)
