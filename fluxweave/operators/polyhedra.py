"""Polyhedra in batches: padded arrays of faces, clipped plane by plane, with moments by the divergence theorem.

A batch is (rows, faces, vertices, 3) with the number of vertices of each face (0: no face); faces are counter-clockwise
from outside, and places past a face's end repeat its first vertex.

The boundary of the overlap of two convex bodies is each one's faces cut to the other.  Faces are cut as flat rings, so no
cap has to be built; where faces of both lie in one plane, those of the first body count if both look the same way, and
none if they face each other.  Cells that are not convex, or whose faces are not flat, are signed sums of tetrahedra over
their faces' middles, whatever their shape.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are clipped at once.
PAIRS = 2048
#: Distance, as a share of a body's width, within which a vertex is on a plane.
FLAT = 1e-12


@dataclass
class Solids:
    """``faces`` (rows, faces, vertices, 3), ``size`` (rows, faces)."""

    faces: np.ndarray
    size: np.ndarray

    def take(self, rows: np.ndarray) -> Solids:
        return Solids(self.faces[rows], self.size[rows])

    @property
    def held(self) -> np.ndarray:
        """Which vertices there are."""
        return np.arange(self.faces.shape[2]) < self.size[:, :, None]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.held[..., None]
        return np.where(held, self.faces, np.inf).min((1, 2)), np.where(held, self.faces, -np.inf).max((1, 2))


def load(points: pa.Array, facets: pa.Array) -> Solids:
    """Columns of array<struct<x,y,z>> and array<array<int>>."""
    flat = points.flatten()
    xyz = np.stack([flat.field(a).to_numpy(zero_copy_only=False) for a in "xyz"], 1)
    count = pc.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64)
    n_faces, rings = pc.list_value_length(facets).to_numpy(zero_copy_only=False).astype(np.int64), facets.flatten()
    n_vertices, vertex = pc.list_value_length(rings).to_numpy(zero_copy_only=False).astype(np.int64), rings.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(count)
    row = np.repeat(np.arange(rows), n_faces)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(n_faces) - n_faces, n_faces)
    size = np.zeros((rows, int(n_faces.max(initial=1))), np.int64)
    size[row, slot] = n_vertices
    place = np.arange(int(n_vertices.max(initial=1)))
    start = np.cumsum(n_vertices) - n_vertices
    at = vertex[start[:, None] + np.where(place < n_vertices[:, None], place, 0)] + (np.cumsum(count) - count)[row][:, None]
    faces = np.zeros((*size.shape, len(place), 3))
    faces[row, slot] = xyz[at]
    return Solids(faces, size)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[..., 1] * b[..., 2] - a[..., 2] * b[..., 1], a[..., 2] * b[..., 0] - a[..., 0] * b[..., 2], a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]], -1)


def planes(s: Solids) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals (outwards) and offsets of the faces; zeros where there is no face."""
    rel = s.faces - s.faces[:, :, :1]
    vector = _cross(rel, np.roll(rel, -1, 2)).sum(2)
    length = np.sqrt(_dot(vector, vector))
    normal = np.divide(vector, length[..., None], out=np.zeros_like(vector), where=(length > 0)[..., None])
    middle = (s.faces * s.held[..., None]).sum(2) / np.maximum(s.size, 1)[..., None]
    return normal, _dot(normal, middle)


def moments(faces: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """(rows, 4): volume and first moments of closed surfaces (rows, faces, vertices, 3): fans of triangles, each with its
    share of the surface integrals of x/3 . n and x_i^2/2 n_i, about ``origin``."""
    p = faces - origin[:, None, None, :]
    a, b, c = p[:, :, :1], p[:, :, 1:-1], p[:, :, 2:]
    area = _cross(b - a, c - a) / 2
    m0 = _dot(area, a).sum((1, 2)) / 3
    m1 = (area * (a * a + b * b + c * c + a * b + b * c + c * a)).sum((1, 2)) / 12
    return np.concatenate([m0[:, None], m1 + m0[:, None] * origin], 1)


def convex(s: Solids) -> np.ndarray:
    """Rows whose faces are flat and have every vertex behind them."""
    lo, hi = s.bounds()
    normal, offset = planes(s)
    reach = 1e-10 * (hi - lo).max(1)
    vertices = s.faces.reshape(len(s.size), -1, 3)
    held, good = s.held.reshape(len(s.size), -1), np.ones(len(s.size), bool)
    for k in range(s.size.shape[1]):
        d = _dot(vertices, normal[:, k, None]) - offset[:, k, None]
        good &= ((d <= reach[:, None]) | ~held | (s.size[:, k] == 0)[:, None]).all(1)
        own = np.abs(_dot(s.faces[:, k], normal[:, k, None]) - offset[:, k, None]) <= reach[:, None]
        good &= (own | ~s.held[:, k]).all(1)
    return good


def tetrahedra(s: Solids) -> tuple[Solids, np.ndarray, np.ndarray]:
    """Tetrahedra over the triangles between each face's edges and middle, with the row and the sign of each: they add up to
    the body even where some point inwards."""
    held = s.held
    hub = (s.faces * held[..., None]).sum(2) / np.maximum(s.size, 1)[..., None]
    apex = (s.faces * held[..., None]).sum((1, 2)) / np.maximum(held.sum((1, 2)), 1)[:, None]
    after = np.where(np.arange(s.faces.shape[2]) + 1 < s.size[:, :, None], np.arange(s.faces.shape[2]) + 1, 0)
    follow = np.take_along_axis(s.faces, after[..., None], 2)
    row, face, k = np.nonzero(held)
    a, b, c, d = s.faces[row, face, k], follow[row, face, k], hub[row, face], apex[row]
    volume = _dot(_cross(b - a, c - a), a - d) / 6
    some = volume != 0
    row, a, b, c, d, volume = (x[some] for x in (row, a, b, c, d, volume))
    turned = (volume < 0)[:, None]
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    faces = np.stack([np.stack(f, 1) for f in ((a, b, c), (a, d, b), (b, d, c), (c, d, a))], 1)
    return Solids(faces, np.full(faces.shape[:2], 3)), row, np.sign(volume)


def _cut(p: np.ndarray, n: np.ndarray, normal: np.ndarray, offset: np.ndarray, flat: np.ndarray, keep_flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings in space (rings, vertices, 3) cut to normal . x <= offset; rings in the plane stay where ``keep_flat``."""
    most = p.shape[1]
    at = np.arange(most)
    d = offset[:, None] - _dot(p, normal[:, None])
    d[np.abs(d) <= flat[:, None]] = 0.0
    valid = at < n[:, None]
    lies = ((d == 0) | ~valid).all(1) & (n > 0) & (normal != 0).any(1)
    n = np.where(lies & ~keep_flat, 0, n)
    valid = at < n[:, None]
    inside = d >= 0
    if (inside | ~valid).all():
        return p, n
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    q, e = np.take_along_axis(p, after[:, :, None], 1), np.take_along_axis(d, after, 1)
    crosses = valid & (inside != (e >= 0)) & (d != 0)
    crosses &= e != 0  # a vertex on the plane is no new point
    met = p + (q - p) * np.divide(d, d - e, out=np.zeros_like(d), where=crosses)[:, :, None]
    points, sent = np.stack([p, met], 2).reshape(len(p), 2 * most, 3), np.stack([valid & inside, crosses], 2).reshape(len(p), 2 * most)
    count = sent.sum(1)
    out = np.zeros((len(p), max(int(count.max(initial=0)), 1), 3))
    ring, slot = np.nonzero(sent)
    out[ring, (np.cumsum(sent, 1) - 1)[ring, slot]] = points[ring, slot]
    return np.where((np.arange(out.shape[1]) >= count[:, None])[:, :, None], out[:, :1], out), np.where(count >= 3, count, 0)


def _cut_faces(s: Solids, by: Solids, first: bool) -> np.ndarray:
    """Moments' faces: those of ``s`` inside ``by``, as (rows, faces, vertices, 3)."""
    rows, n_faces = s.size.shape
    own, _ = planes(s)
    normal, offset = planes(by)
    lo, hi = by.bounds()
    flat = np.repeat(FLAT * (hi - lo).max(1), n_faces)
    p, n = s.faces.reshape(rows * n_faces, -1, 3), s.size.reshape(-1)
    for k in range(normal.shape[1]):
        against, at = np.repeat(normal[:, k], n_faces, 0), np.repeat(offset[:, k], n_faces)
        alike = _dot(own.reshape(-1, 3), against) > 0
        p, n = _cut(p, n, against, at, flat, alike & first)
    p = np.where((n > 0)[:, None, None], p, p[:, :1])  # a face that is gone is a point
    return p.reshape(rows, n_faces, -1, 3)


def overlap_convex(s: Solids, t: Solids) -> np.ndarray:
    """(rows, 4) moments of the overlap of convex bodies, row by row."""
    origin = t.bounds()[0]
    return moments(_cut_faces(s, t, True), origin) + moments(_cut_faces(t, s, False), origin)


def _boxes(s: Solids, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows that fill their bounds."""
    whole = np.prod(hi - lo, 1)
    return np.abs(moments(s.faces, lo)[:, 0] - whole) <= 1e-14 * whole


def overlaps(s: Solids, t: Solids) -> np.ndarray:
    """(rows, 4): [m0, m1x, m1y, m1z] of the overlap of any two bodies, row by row."""
    rows = len(s.size)
    out = np.zeros((rows, 4))
    if not rows:
        return out
    (slo, shi), (tlo, thi) = s.bounds(), t.bounds()
    lo, hi = np.maximum(slo, tlo), np.minimum(shi, thi)
    meet = (hi > lo).all(1)
    plain = _boxes(s, slo, shi) & _boxes(t, tlo, thi)
    m0 = np.prod(np.maximum(hi - lo, 0), 1)
    out[plain & meet] = (m0[:, None] * np.concatenate([np.ones((rows, 1)), (lo + hi) / 2], 1))[plain & meet]
    good = convex(s) & convex(t)
    both = np.flatnonzero(meet & ~plain & good)
    if len(both):
        out[both] = overlap_convex(s.take(both), t.take(both))
    rest = np.flatnonzero(meet & ~plain & ~good)
    for at in range(0, len(rest), 64):  # a pair may be hundreds of pairs of tetrahedra
        some = rest[at : at + 64]
        (a, ra, sa), (b, rb, sb) = tetrahedra(s.take(some)), tetrahedra(t.take(some))
        nb = np.bincount(rb, minlength=len(some))
        first = np.cumsum(nb) - nb
        i = np.repeat(np.arange(len(ra)), nb[ra])
        j = np.arange(len(i)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra]) + np.repeat(first[ra], nb[ra])
        (alo, ahi), (blo, bhi) = a.bounds(), b.bounds()
        near = (np.maximum(alo[i], blo[j]) < np.minimum(ahi[i], bhi[j])).all(1)
        i, j = i[near], j[near]
        for k in range(0, len(i), 8 * PAIRS):
            x, y = i[k : k + 8 * PAIRS], j[k : k + 8 * PAIRS]
            np.add.at(out, some[ra[x]], (sa[x] * sb[y])[:, None] * overlap_convex(a.take(x), b.take(y)))
    return out


def body_moments(s: Solids) -> np.ndarray:
    """(rows, 4) moments of the bodies themselves; faces that are not flat are fans round their middles."""
    tets, row, sign = tetrahedra(s)
    out = np.zeros((len(s.size), 4))
    np.add.at(out, row, sign[:, None] * moments(tets.faces, tets.faces[:, 0, 0]))
    return out


def column(s: Solids) -> tuple[pa.Array, pa.Array]:
    """Solids as ``points`` and ``facets`` columns; equal vertices of several faces are one point each where exactly equal."""
    points, facets = [], []
    for faces, size in zip(s.faces, s.size, strict=True):
        rings = [faces[k, :n] for k, n in enumerate(size) if n >= 3]
        flat = np.concatenate(rings) if rings else np.zeros((0, 3))
        each, at = np.unique(flat, axis=0, return_inverse=True)
        points.append(each)
        facets.append(np.split(at.reshape(-1), np.cumsum([len(r) for r in rings])[:-1]) if rings else [])
    n = np.cumsum([0] + [len(p) for p in points]).astype(np.int32)
    xyz = np.concatenate(points) if points else np.zeros((0, 3))
    held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)], ["x", "y", "z"])
    return pa.ListArray.from_arrays(pa.array(n), held), pa.array([[f.tolist() for f in fs] for fs in facets], pa.list_(pa.list_(pa.int32())))


def _side(s: Solids, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The faces of each body where normal . x <= offset, without the cut's own: (rows, faces, vertices, 3), their sizes, and
    how far a vertex may be off the plane."""
    rows, n_faces = s.size.shape
    lo, hi = s.bounds()
    flat = FLAT * (hi - lo).max(1)
    own, _ = planes(s)
    many = lambda x: np.repeat(x, n_faces, 0)
    p, n = _cut(s.faces.reshape(rows * n_faces, -1, 3), s.size.reshape(-1), many(normal), many(offset), many(flat), _dot(own.reshape(-1, 3), many(normal)) > 0)
    p = np.where((n > 0)[:, None, None], p, p[:, :1])
    return p.reshape(rows, n_faces, -1, 3), n.reshape(rows, n_faces), flat


def volume_below(s: Solids, normal: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Volume where normal . x <= offset; about a point of the plane the cut's own face adds nothing."""
    faces, _, _ = _side(s, normal, offset)
    return moments(faces, normal * offset[:, None])[:, 0]


def cut(s: Solids, normal: np.ndarray, offset: np.ndarray) -> Solids:
    """Convex bodies where normal . x <= offset, closed by the face in the plane: its corners are those of the cut faces,
    sorted by angle round their middle."""
    faces, size, flat = _side(s, normal, offset)
    rows, n_faces, most = faces.shape[:3]
    p = faces.reshape(rows, -1, 3)
    held = (np.arange(most) < size[:, :, None]).reshape(rows, -1)
    d = _dot(p, normal[:, None]) - offset[:, None]
    before = _dot(s.faces.reshape(rows, -1, 3), normal[:, None]) - offset[:, None]
    parted = ((before > flat[:, None]) & s.held.reshape(rows, -1)).any(1)
    on = held & (np.abs(d) <= 4 * flat[:, None]) & parted[:, None]
    count = np.maximum(on.sum(1), 1)[:, None]
    middle = (p * on[..., None]).sum(1) / count
    u = np.cross(normal, np.eye(3)[np.abs(normal).argmin(1)])
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    v, rel = np.cross(normal, u), p - middle[:, None]
    angle = np.where(on, np.arctan2(_dot(rel, v[:, None]), _dot(rel, u[:, None])), np.inf)
    by = np.argsort(angle, 1, kind="stable")
    ring, there = np.take_along_axis(p, by[..., None], 1), np.take_along_axis(on, by, 1)
    gap = np.sqrt(((ring - np.roll(ring, 1, 1)) ** 2).sum(2))
    last = np.maximum(there.sum(1) - 1, 0)
    gap[:, 0] = np.sqrt(((ring[:, 0] - ring[np.arange(rows), last]) ** 2).sum(1))  # the first after the last one
    new = there & (gap > 8 * flat[:, None])
    n_cap = new.sum(1)
    width = max(most, int(n_cap.max(initial=3)))
    out = np.zeros((rows, n_faces + 1, width, 3))
    out[:, :n_faces, :most], out[:, :n_faces, most:] = faces, faces[:, :, :1]
    row, at = np.nonzero(new)
    cap = np.repeat(ring[:, :1], width, 1)
    cap[row, (np.cumsum(new, 1) - 1)[row, at]] = ring[row, at]
    first = cap[:, :1]
    out[:, n_faces] = np.where((np.arange(width) < n_cap[:, None])[..., None], cap, first)
    return Solids(out, np.concatenate([size, np.where(n_cap >= 3, n_cap, 0)[:, None]], 1))


def offsets_of_volume(s: Solids, normal: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """For each convex body the offset below which the given volume lies.

    Between the heights of two vertices the volume is a cubic, which four cuts fix; its root is found on the cubic alone.
    """
    rows = np.arange(len(volume))
    height = _dot(s.faces.reshape(len(rows), -1, 3), normal[:, None])
    height = np.sort(np.where(s.held.reshape(len(rows), -1), height, height[:, :1]), 1)
    at = np.zeros_like(height)
    for k in range(1, height.shape[1]):
        some = np.flatnonzero(height[:, k] > height[:, k - 1])
        at[:, k] = at[:, k - 1]
        if len(some):
            at[some, k] = volume_below(s.take(some), normal[some], height[some, k])
    k = np.clip((at < volume[:, None]).sum(1), 1, height.shape[1] - 1)
    low, high, v0, v3 = height[rows, k - 1], height[rows, k], at[rows, k - 1], at[rows, k]
    v1, v2 = (volume_below(s, normal, low + (high - low) * t) for t in (1 / 3, 2 / 3))
    c3, c2, c1 = (9 * (v3 - 3 * v2 + 3 * v1 - v0) / 2, 9 * (2 * v0 - 5 * v1 + 4 * v2 - v3) / 2, (-11 * v0 + 18 * v1 - 9 * v2 + 2 * v3) / 2)
    a, b = np.zeros(len(rows)), np.ones(len(rows))
    for _ in range(60):
        t = (a + b) / 2
        below = ((c3 * t + c2) * t + c1) * t + v0 < volume
        a, b = np.where(below, t, a), np.where(below, b, t)
    return low + (high - low) * (a + b) / 2
