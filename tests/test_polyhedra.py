import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxweave.operators import intersect
from fluxweave.operators import polyhedra as P
from fluxweave.sources import meshes

# A second way, one pair of tetrahedra after the other with caps built by angle, that the batches are held against.

def tetrahedra(points: np.ndarray, facets: list[list[int]]) -> list[np.ndarray]:
    """Tetrahedra from the centroid over triangulated facets (facets counter-clockwise from outside)."""
    middle, out = points.mean(0), []
    for f in facets:
        face = points[f]
        normal = np.cross(face[1] - face[0], face[2] - face[0])
        if np.abs((face - face[0]) @ normal).max() <= 1e-12 * max(np.linalg.norm(normal), 1e-300) ** 1.5:  # flat: a fan needs no hub
            out += [np.array([face[0], face[i], face[i + 1], middle]) for i in range(1, len(f) - 1)]
        else:
            hub = face.mean(0)
            out += [np.array([face[i], face[(i + 1) % len(f)], hub, middle]) for i in range(len(f))]
    return out


def polyhedron_moments(points: np.ndarray, facets: list[list[int]]) -> np.ndarray:
    total = np.zeros(4)
    for t in tetrahedra(points, facets):
        v = np.dot(np.cross(t[1] - t[0], t[2] - t[0]), t[0] - t[3]) / 6  # positive where facets point outwards
        total += np.array([v, *(v * t.mean(0))])
    return total


def _clip_faces(faces: list[np.ndarray], normal: np.ndarray, offset: float, flat: float) -> list[np.ndarray]:
    """A convex polyhedron given by its faces (rings in space), cut to normal . x >= offset; within ``flat`` is on the plane."""
    out, cut = [], []
    for f in faces:
        d = f @ normal - offset
        d[np.abs(d) <= flat] = 0.0
        inside = d >= 0
        if inside.all():
            out.append(f)
            continue
        if not inside.any():
            continue
        ring = []
        for i in range(len(f)):
            j = (i + 1) % len(f)
            if inside[i]:
                ring.append(f[i])
            if inside[i] != inside[j]:
                p = f[i] + (f[j] - f[i]) * (d[i] / (d[i] - d[j]))
                ring.append(p)
                cut.append(p)
        if len(ring) >= 3:
            out.append(np.array(ring))
    if len(cut) >= 3 and out:
        p = np.array(cut)
        middle = p.mean(0)
        u = p[np.argmax(np.linalg.norm(p - middle, axis=1))] - middle
        v = np.cross(normal, u)
        angle = np.arctan2((p - middle) @ v / max(np.linalg.norm(v), 1e-300), (p - middle) @ u / max(np.linalg.norm(u), 1e-300))
        out.append(p[np.argsort(-angle)])
    return out


def _faces_moments(faces: list[np.ndarray]) -> np.ndarray:
    if not faces:
        return np.zeros(4)
    middle, total = np.concatenate(faces).mean(0), np.zeros(4)
    for f in faces:
        for i in range(1, len(f) - 1):
            t = np.array([f[0], f[i], f[i + 1], middle])
            v = abs(np.dot(np.cross(t[1] - t[0], t[2] - t[0]), t[3] - t[0])) / 6
            total += np.array([v, *(v * t.mean(0))])
    return total


def _tet_faces(t: np.ndarray) -> list[np.ndarray]:
    return [t[[0, 1, 2]], t[[0, 1, 3]], t[[1, 2, 3]], t[[0, 2, 3]]]


def intersect_polyhedra(source: tuple[np.ndarray, list[list[int]]], target: tuple[np.ndarray, list[list[int]]]) -> np.ndarray:
    """[m0, m1x, m1y, m1z] of the overlap: the tetrahedra of both, cut against each other."""
    total, tolerance = np.zeros(4), 3**0.5 * 2.2e-16
    own = tetrahedra(*source)
    for t in tetrahedra(*target):
        middle, planes = t.mean(0), []
        for f in _tet_faces(t):
            n = np.cross(f[1] - f[0], f[2] - f[0])
            size = np.linalg.norm(n)
            if size == 0:
                continue
            n = n / (size if n @ (middle - f[0]) >= 0 else -size)
            planes.append((n, float(n @ f[0])))
        lo, hi = t.min(0), t.max(0)
        flat = 1e-12 * float((hi - lo).max())
        for s in own:
            if (s.max(0) < lo + tolerance).any() or (s.min(0) > hi - tolerance).any():
                continue
            faces = _tet_faces(s)
            for n, o in planes:
                faces = _clip_faces(faces, n, o, flat)
                if not faces:
                    break
            total += _faces_moments(faces)
    return total


CUBE = np.array([[x, y, z] for z in (0, 1) for y in (0, 1) for x in (0, 1)], float)
BOX = intersect.BOX_FACETS
TET = (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float), [[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]])
WEDGE = (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [0, 1, 1]], float), [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]])


def solids(bodies):
    points = pa.array([[{"x": a, "y": b, "z": c} for a, b, c in p.tolist()] for p, _ in bodies])
    return P.load(points, pa.array([f for _, f in bodies]))


def shaped(rng, body, twist=0.0):
    p, f = body
    m = np.eye(3) + rng.uniform(-0.4, 0.4, (3, 3))
    return p @ m.T + rng.uniform(-0.4, 0.4, 3) + rng.uniform(-twist, twist, p.shape), f


def pairs(rng, n, twist):
    kinds = [(CUBE, BOX), TET, WEDGE]
    return [[shaped(rng, kinds[rng.integers(3)], twist) for _ in range(n)] for _ in range(2)]


@pytest.mark.parametrize("twist", [0.0, 0.08])
def test_random_bodies_of_several_kinds(twist):
    a, b = pairs(np.random.default_rng(7), 40, twist)
    got = P.overlaps(solids(a), solids(b))
    want = np.array([intersect_polyhedra(x, y) for x, y in zip(a, b, strict=True)])
    assert np.abs(got - want).max() < 1e-12 and (got[:, 0] > 1e-3).sum() > 20


def test_bodies_that_share_faces_and_edges():
    rng = np.random.default_rng(3)
    shear = np.array([[1, 0.3, 0.1], [0, 1, 0.2], [0.1, 0, 1]])
    bodies, others, want = [], [], []
    for _ in range(200):
        lo, hi = np.sort(rng.integers(0, 4, (2, 2, 3)) / 3.0, 0).transpose(1, 0, 2).reshape(4, 3)[::2], None
        (alo, blo), size = lo, rng.integers(1, 3, (2, 3)) / 3.0
        ahi, bhi = alo + size[0], blo + size[1]
        bodies.append(((alo + CUBE * (ahi - alo)) @ shear.T, BOX))
        others.append(((blo + CUBE * (bhi - blo)) @ shear.T, BOX))
        lo, hi = np.maximum(alo, blo), np.minimum(ahi, bhi)
        m0 = np.prod(np.maximum(hi - lo, 0)) * np.linalg.det(shear)
        want.append([m0, *(m0 * ((lo + hi) / 2 @ shear.T))])
    got = P.overlaps(solids(bodies), solids(others))
    assert np.abs(got - np.array(want)).max() < 1e-13
    assert np.abs(P.overlaps(solids(bodies), solids(bodies)) - P.body_moments(solids(bodies))).max() < 1e-13


def test_boxes_take_the_short_way_and_agree():
    rng = np.random.default_rng(4)
    a, b = [[(rng.uniform(0, 1, 3) + CUBE * rng.uniform(0.2, 1, 3), BOX) for _ in range(100)] for _ in range(2)]
    x, y = solids(a), solids(b)
    assert P._boxes(x, *x.bounds()).all()
    got, slow = P.overlaps(x, y), P.overlap_convex(x, y)
    meet = got[:, 0] > 0
    assert meet.any() and np.abs(got - slow)[meet].max() < 1e-14


def test_a_body_with_a_notch():
    """An L-shaped prism is not convex: the signed tetrahedra must add up to its parts."""
    ring = np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]], float)
    points = np.concatenate([np.c_[ring, np.zeros(6)], np.c_[ring, np.ones(6)]])
    facets = [[5, 4, 3, 2, 1, 0], [6, 7, 8, 9, 10, 11], *[[i, (i + 1) % 6, 6 + (i + 1) % 6, 6 + i] for i in range(6)]]
    body, whole = solids([(points, facets)] * 2), solids([(CUBE * 2, BOX), (CUBE + [0.5, 0.5, 0.0], BOX)])
    assert not P.convex(body).any()
    assert np.abs(P.body_moments(body)[0] - [3, 2.5, 2.5, 1.5]).max() < 1e-13
    got = P.overlaps(body, whole)
    assert np.abs(got[0] - [3, 2.5, 2.5, 1.5]).max() < 1e-12
    # the unit cube at (0.5, 0.5) lacks the quarter over the notch
    assert np.abs(got[1] - [0.75, 1 - 0.25 * 1.25, 1 - 0.25 * 1.25, 0.375]).max() < 1e-12


def test_meshes_of_moved_nodes_fill_each_other(spark):
    """Hexahedra with twisted faces: overlaps cover every cell of both meshes."""

    def mesh(n, seed):
        rng = np.random.default_rng(seed)
        at = lambda i, j, k: i + (n + 1) * (j + (n + 1) * k)
        grid = np.array([[i, j, k] for k in range(n + 1) for j in range(n + 1) for i in range(n + 1)], float)
        inner = ((grid > 0) & (grid < n)).all(1)
        grid[inner] += rng.uniform(-0.2, 0.2, (inner.sum(), 3))
        rows = []
        for k in range(n):
            for j in range(n):
                for i in range(n):
                    p = grid[[at(i + a, j + b, k + c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]] / n
                    v = P.body_moments(solids([(p, BOX)]))[0, 0]
                    rows.append((len(rows), [tuple(x) for x in p.tolist()], BOX, *[float(x) for pair in zip(p.min(0), p.max(0), strict=True) for x in pair], float(v)))
        return spark.createDataFrame(rows, "id long, points array<struct<x:double,y:double,z:double>>, facets array<array<int>>, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double, vol double")

    s, t = mesh(3, 1), mesh(2, 2)
    w = intersect.intersect(t, s, 3).cache()
    for key, m in (("tgt_id", t), ("src_id", s)):
        gap = w.groupBy(F.col(key).alias("id")).agg(F.sum("m0").alias("v")).join(m, "id", "full").agg(F.max(F.abs(F.col("v") - F.col("vol")))).first()[0]
        assert gap < 1e-12


def test_carried_columns(spark):
    m = meshes.box_mesh(spark, [0, 0, 0], [1, 1, 1], [2, 2, 2])
    solid = meshes.box_solids(m).withColumn("mat", F.lit(4))
    got = intersect.intersect_polyhedral_meshes(solid, solid, carry=("mat",))
    assert got.columns == ["tgt_id", "src_id", "mat", "m0", "m1x", "m1y", "m1z"] and got.count() == 8
