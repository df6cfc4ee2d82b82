"""Shapes to voxels: the arithmetic, on arrays. ``covers`` applies it to tables of shapes.

Coordinates are (lat, lon, alt) rows; voxels are (f, x, y) rows of int64.
"""

from __future__ import annotations

import math

import numpy as np

from voxlattice.domain import EARTH_A, EARTH_E2, EARTH_F, MAX_ALTITUDE
from voxlattice.errors import GeometryError

_CORNERS = np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], float)
#: Fixed value: sides of the prism that stands for a cylinder.
PRISM_SIDES = 57


def to_ecef(c: np.ndarray) -> np.ndarray:
    lat, lon, alt = np.radians(c[:, 0]), np.radians(c[:, 1]), c[:, 2]
    s, k = np.sin(lat), np.cos(lat)
    n = EARTH_A / np.sqrt(1 - EARTH_E2 * s * s)
    return np.stack([(n + alt) * k * np.cos(lon), (n + alt) * k * np.sin(lon), (n * (1 - EARTH_E2) + alt) * s], 1)


def from_ecef(e: np.ndarray) -> np.ndarray:
    """Fixed-point steps for the latitude, at most 10, each point until it moves by less than 1e-12.

    The height is that of the last step's starting latitude, as voxels at exact heights depend on it.
    """
    x, y, z = e.T
    p = np.sqrt(x * x + y * y)
    lat = np.arctan2(z / p, 1 - EARTH_F)
    height = np.zeros(len(e))
    open_ = np.ones(len(e), bool)
    for _ in range(10):
        s = np.sin(lat[open_])
        n = EARTH_A / np.sqrt(1 - EARTH_E2 * s * s)
        height[open_] = p[open_] / np.cos(lat[open_]) - n
        new = np.arctan2(z[open_] + EARTH_E2 * n * s, p[open_])
        moved = np.abs(new - lat[open_]) >= 1e-12
        lat[open_] = new
        open_[open_] = moved
        if not open_.any():
            break
    return np.stack([np.degrees(lat), np.degrees(np.arctan2(y, x)), height], 1)


def fractional(c: np.ndarray, z: int) -> np.ndarray:
    n = float(1 << z)
    lat = np.radians(c[:, 0])
    y = (1 - np.log(np.tan(lat) + 1 / np.cos(lat)) / math.pi) / 2 * n
    return np.stack([c[:, 2] * (n / MAX_ALTITUDE), (c[:, 1] + 180) / 360 * n, y], 1)


def cells(c: np.ndarray, z: int) -> np.ndarray:
    n = 1 << z
    return np.clip(np.floor(fractional(c, z)), [-n, 0, 0], n - 1).astype(np.int64)


def centers(v: np.ndarray, z: int) -> np.ndarray:
    n = float(1 << z)
    f, x, y = (v + 0.5).T
    return np.stack([np.degrees(np.arctan(np.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180, f / n * MAX_ALTITUDE], 1)


def line(ends: np.ndarray, z: int) -> np.ndarray:
    """Voxels that a straight (earth-centred) segment passes, in order: walked piece by piece through cell walls."""
    a, b = to_ecef(ends)
    steps = np.abs(np.subtract(*cells(ends, z))).sum()
    parts = 5 + math.floor(steps / 120 + np.linalg.norm(a - b) / 2000)
    t = np.arange(parts + 1)[:, None] / parts
    points = fractional(from_ecef(a * (1 - t) + b * t), z)
    path: list[tuple[int, ...]] = []
    for start, end in zip(points[:-1], points[1:], strict=True):
        at, goal = np.floor(start).astype(int), np.floor(end).astype(int)
        delta = end - start
        # Each wall of each axis is crossed at a known share of the way; ties go to the axis that moves most.
        walls = []
        lead = int(np.argmax(np.abs(delta)))
        for k in range(3):
            way = int(np.sign(goal[k] - at[k]))
            for j in range(abs(goal[k] - at[k])):
                wall = at[k] + (j + 1 if way > 0 else -j)
                walls.append(((wall - start[k]) / delta[k], (k - lead) % 3, k, way))
        piece = [tuple(at.tolist())]
        for _, _, k, way in sorted(walls):
            at[k] += way
            piece.append(tuple(at.tolist()))
        path = path[:-1] + piece
    return np.array(path, np.int64)


def triangle_parts(corners: np.ndarray, steps: int) -> np.ndarray:
    """(n * steps**2, 3, 3): triangles (n, 3, 3), each cut into steps**2 equal ones, on a lattice of earth-centred points."""
    corners = corners.reshape(-1, 3, 3)
    p0, p1, p2 = to_ecef(corners.reshape(-1, 3)).reshape(-1, 3, 3).swapaxes(0, 1)[:, :, None]
    i, j = np.tril_indices(steps + 1)
    points = from_ecef((p0 + (p1 - p0) * (i / steps)[:, None] + (p2 - p1) * (j / steps)[:, None]).reshape(-1, 3)).reshape(len(corners), -1, 3)
    at = lambda i, j: i * (i + 1) // 2 + j
    out = []
    for r in range(1, steps + 1):
        k = np.arange(r)
        out.append(np.stack([at(r - 1, k), at(r, k), at(r, k + 1)], 1))
        k = np.arange(1, r)
        out.append(np.stack([at(r - 1, k - 1), at(r - 1, k), at(r, k)], 1))
    return points[:, np.concatenate(out)].reshape(-1, 3, 3)


def distinct(rows: np.ndarray) -> np.ndarray:
    """Different rows of integers, in order; by one packed key where that fits 62 bits."""
    if not len(rows):
        return rows
    lo = rows.min(0)
    size = [int(n) for n in rows.max(0) - lo + 1]
    if math.prod(size) >= 1 << 62:
        return np.unique(rows, axis=0)
    key = np.zeros(len(rows), np.int64)
    for k, n in enumerate(size):
        key = key * n + (rows[:, k] - lo[k])
    key, out = np.unique(key), []
    for n in size[::-1]:
        out.append(key % n)
        key = key // n
    return np.stack(out[::-1], 1) + lo


def triangle(corners: np.ndarray, z: int, min_steps: int = 0) -> np.ndarray:
    """Voxels whose corners lie on both sides of the plane, one of them projecting into the triangle.

    The triangle is cut so that no part spans much more than 8 voxels. One that stays inside a voxel along every axis
    is cut into none and covers nothing, unless ``min_steps`` asks for parts.
    """
    return triangles_cover([corners], z, min_steps)


def triangles_cover(triangles: list[np.ndarray], z: int, min_steps: int = 0) -> np.ndarray:
    """The union of the triangles' voxels; all their parts are tested together."""
    if not len(triangles):
        return np.zeros((0, 3), np.int64)
    return covers_of_triangles(np.stack(triangles), np.zeros(len(triangles), np.int64), z, min_steps)[:, 1:]


def covers_of_triangles(triangles: np.ndarray, owner: np.ndarray, z: int, min_steps: int = 0, most: int = 50_000) -> np.ndarray:
    """(owner, f, x, y) of many owners' triangles (n, 3, 3), each voxel of an owner once; about ``most`` parts at a time."""
    if not len(triangles):
        return np.zeros((0, 4), np.int64)
    f = np.floor(fractional(triangles.reshape(-1, 3), z)).reshape(-1, 3, 3)
    steps = np.maximum(np.ceil((f.max(1) - f.min(1)).max(1) / 8).astype(int), min_steps)
    found = [np.zeros((0, 4), np.int64)]
    for n in np.unique(steps[steps > 0]).tolist():
        same = np.flatnonzero(steps == n)
        each = max(1, most // (n * n))
        for first in range(0, len(same), each):
            k = same[first : first + each]
            found.append(_parts_cover(triangle_parts(triangles[k], n), np.repeat(owner[k], n * n), z))
    return distinct(np.concatenate(found))


def _cross3(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)


def _corner_dots(v: np.ndarray, box: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(8, n): v * (corner - p), for the 8 corners of each voxel in the order of ``_CORNERS``; all (3, n)."""
    along = [(v[k] * (box[k] - p[k]), v[k] * (box[k] + 1 - p[k])) for k in range(3)]
    flat = [p + q for p in along[0] for q in along[1]]
    return np.stack([p + q for p in flat for q in along[2]])


def _boxes(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which box, voxel) of all integer points of many boxes."""
    n = size.prod(1)
    own = np.repeat(np.arange(len(lo)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    s = size[own]
    return own, lo[own] + np.stack([k // (s[:, 1] * s[:, 2]), k // s[:, 2] % s[:, 1], k % s[:, 2]], 1)


def _runs_of(n: np.ndarray, most: int):
    """Consecutive slices whose ``n`` add up to at most ``most``, or one row."""
    ends, first = np.cumsum(n), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield slice(first, last)
        first = last


def _parts_cover(parts: np.ndarray, owner: np.ndarray, z: int, most: int = 32_000) -> np.ndarray:
    """(owner, f, x, y) of many small triangles (n, 3, 3) at once, ``most`` candidates at a time."""
    p = fractional(parts.reshape(-1, 3), z).reshape(-1, 3, 3)
    lo, hi = np.floor(p.min(1)).astype(np.int64), np.floor(p.max(1)).astype(np.int64)
    size = hi - lo + 1
    a, b, c = p[:, 1] - p[:, 0], p[:, 0] - p[:, 2], p[:, 2] - p[:, 1]
    normal = _cross3(b, a)
    inward = [np.ascontiguousarray(_cross3(normal, v).T) for v in (a, c, b)]
    normal, ends = np.ascontiguousarray(normal.T), [np.ascontiguousarray(p[:, k].T) for k in range(3)]
    found = [np.zeros((0, 4), np.int64)]
    for run in _runs_of(size.prod(1), most):
        own, box = _boxes(lo[run], size[run])
        own += run.start
        box = np.ascontiguousarray(box.T)
        above = ~np.signbit(_corner_dots(normal[:, own], box, ends[0][:, own]))
        crossed = above.any(0) & ~above.all(0)
        box, own = box[:, crossed], own[crossed]
        within = np.ones((8, len(own)), bool)
        for v, end in zip(inward, ends, strict=True):
            within &= _corner_dots(v[:, own], box, end[:, own]) >= 0
        hit = within.any(0)
        found.append(distinct(np.column_stack([owner[own[hit]], *box[:, hit]])))
    return np.concatenate(found)


def _cross2(a, b, c):
    """Twice the signed area of a, b, c: (..., 2) each."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - b[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - b[..., 0])


def polygon_triangles(vertices: np.ndarray) -> list[np.ndarray]:
    """Ear clipping on the projection along the dominant axis of the polygon's normal."""
    return list(polygons_triangles(vertices[None])[0])


def polygons_triangles(vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (t, 3, 3) of many polygons (n, corners, 3) with equally many corners, and whose each is; clipped in step."""
    n, m = vertices.shape[:2]
    if m < 3:
        return np.zeros((0, 3, 3)), np.zeros(0, np.int64)
    if m == 3:
        return vertices, np.arange(n)
    e = to_ecef(vertices.reshape(-1, 3)).reshape(n, m, 3)
    nxt = np.roll(e, -1, 1)
    normal = np.abs(np.stack([((e[..., (k + 1) % 3] - nxt[..., (k + 1) % 3]) * (e[..., (k + 2) % 3] + nxt[..., (k + 2) % 3])).sum(1) for k in range(3)], 1))
    axis = np.argmax(normal, 1)
    flat = np.take_along_axis(e, np.array([[1, 2], [0, 2], [0, 1]])[axis][:, None, :], 2)
    after = np.roll(flat, -1, 1)
    turn = np.where((flat[..., 0] * after[..., 1] - after[..., 0] * flat[..., 1]).sum(1) > 0, 1.0, -1.0)
    left, alive, out, whose = np.tile(np.arange(m), (n, 1)), np.arange(n), [], []

    def cut(rows, k):
        out.append(np.stack([vertices[alive[rows], left[rows, (k + d) % m]] for d in (-1, 0, 1)], 1))
        whose.append(alive[rows])

    while m > 3 and len(alive):
        todo, ears = np.arange(len(alive)), np.full(len(alive), -1)
        for k in range(m):
            at = flat[alive[todo][:, None], left[todo]]
            a, b, c = at[:, k - 1], at[:, k], at[:, (k + 1) % m]
            whole = _cross2(a, b, c)
            rest = np.delete(at, [(k - 1) % m, k, (k + 1) % m], 1)
            a, b, c = a[:, None], b[:, None], c[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = (_cross2(a, b, rest) / whole[:, None] > 0) & (_cross2(b, c, rest) / whole[:, None] > 0) & (_cross2(c, a, rest) / whole[:, None] > 0)
            ear = ~(whole * turn[alive[todo]] <= -1e-10) & ~(inside.any(1) & ~(np.abs(whole) < 2e-12))
            ears[todo[ear]] = k
            todo = todo[~ear]
            if not len(todo):
                break
        # What has no ear left ends here.
        clipped = np.flatnonzero(ears >= 0)
        cut(clipped, ears[clipped])
        keep = np.ones((len(clipped), m), bool)
        keep[np.arange(len(clipped)), ears[clipped]] = False
        left, alive, m = left[clipped][keep].reshape(-1, m - 1), alive[clipped], m - 1
    if len(alive):
        cut(np.arange(len(alive)), np.ones(len(alive), np.int64))
    order = np.argsort(np.concatenate(whose), kind="stable")
    return np.concatenate(out)[order], np.concatenate(whose)[order]


def _union(parts: list[np.ndarray]) -> np.ndarray:
    parts = [p for p in parts if len(p)]
    return np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 3), np.int64)


def polygon(vertices: np.ndarray, z: int, min_steps: int = 0) -> np.ndarray:
    return triangles_cover(polygon_triangles(vertices), z, min_steps)


def open_edges(faces: list[np.ndarray], epsilon: float) -> int:
    """Edges of a face list that occur an odd number of times, corners rounded to ``epsilon`` metres."""
    faces = [f for f in faces if len(f)]
    return int(open_edges_of(np.concatenate(faces), np.array([len(f) for f in faces]), np.zeros(len(faces), np.int64), 1, epsilon)[0]) if faces else 0


def open_edges_of(corners: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n: int, epsilon: float) -> np.ndarray:
    """(n): ``open_edges`` of n owners, whose faces have ``lengths`` (above 0) of the ``corners``."""
    e = to_ecef(corners)
    q = np.sign(e) * np.floor(np.abs(e) / epsilon + 0.5) + 0.0
    last = np.cumsum(lengths)
    follows = np.arange(1, len(q) + 1)
    follows[last - 1] = last - lengths
    a, b, own = q, q[follows], np.repeat(owner, lengths)
    real = (a != b).any(1) & (np.repeat(lengths, lengths) >= 3)
    a, b, own = a[real], b[real], own[real]
    more = np.zeros(len(a), bool)
    for k in (2, 1, 0):
        more = (a[:, k] > b[:, k]) | ((a[:, k] == b[:, k]) & more)
    edges = np.where(more[:, None], np.hstack([b, a]), np.hstack([a, b]))
    order = np.lexsort((*edges.T, own))
    edges, own = edges[order], own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (edges[1:] != edges[:-1]).any(1)
    first = np.flatnonzero(fresh)
    odd = np.diff(np.append(first, len(own))) % 2
    return np.bincount(own[first], odd, n).astype(np.int64)


def solid(faces: list[np.ndarray], z: int, epsilon: float = 1e-6, check: bool = True) -> np.ndarray:
    """Surface voxels and all that the outside cannot reach through faces of voxels."""
    faces = [f for f in faces if len(f)]
    if check and (not faces or (n := open_edges(faces, epsilon))):
        raise GeometryError(f"the solid is open at {n if faces else 0} edges")
    surface = triangles_cover([t for f in faces for t in polygon_triangles(f)], z)
    return filled(np.column_stack([np.zeros(len(surface), np.int64), surface]))[:, 1:]


def filled(surface: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """(owner, f, x, y): each owner's surface voxels and all that the outside cannot reach through faces of voxels.

    Owners with boxes of about one size are flooded together, in grids of about ``most`` voxels.
    """
    if not len(surface):
        return surface
    surface = surface[np.argsort(surface[:, 0], kind="stable")]
    first = np.flatnonzero(np.append(True, surface[1:, 0] != surface[:-1, 0]))
    lo, hi = np.minimum.reduceat(surface[:, 1:], first), np.maximum.reduceat(surface[:, 1:], first)
    size, counts = hi - lo + 1, np.diff(np.append(first, len(surface)))
    # Of a run of owners by volume the last is the largest; longer sides of others are allowed for by twice its volume.
    order, out = np.lexsort((*size.T, size.prod(1))), []
    for run in _runs_of(2 * (size[order] + 2).prod(1), most):
        for own in _alike(order[run], size, most):
            shape = (len(own), *(size[own].max(0) + 2))
            at = np.arange(counts[own].sum()) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own]) + np.repeat(first[own], counts[own])
            k = np.repeat(np.arange(len(own)), counts[own])
            wall = np.zeros(shape, bool)
            wall[(k, *(surface[at, 1:] - lo[own][k] + 1).T)] = True
            within = np.ones(shape, bool)
            for a in range(3):
                i = np.arange(shape[a + 1])
                side = (i >= 1) & (i <= size[own, a][:, None])
                within &= side.reshape(len(own), *(-1 if b == a else 1 for b in range(3)))
            outside = ~within
            while True:
                grown = outside.copy()
                for a in range(1, 4):
                    p, q = [slice(None)] * 4, [slice(None)] * 4
                    p[a], q[a] = slice(1, None), slice(None, -1)
                    grown[tuple(p)] |= outside[tuple(q)]
                    grown[tuple(q)] |= outside[tuple(p)]
                grown &= ~wall
                if (grown == outside).all():
                    break
                outside = grown
            v = np.argwhere(~outside)
            out.append(np.column_stack([surface[first[own], 0][v[:, 0]], v[:, 1:] - 1 + lo[own][v[:, 0]]]))
    return np.concatenate(out)


def _alike(own: np.ndarray, size: np.ndarray, most: int):
    """``own`` in parts whose common grid has at most ``most`` voxels, or one owner."""
    if len(own) > 1 and len(own) * int((size[own].max(0) + 2).prod()) > most:
        yield from _alike(own[: len(own) // 2], size, most)
        yield from _alike(own[len(own) // 2 :], size, most)
    else:
        yield own


def voxel_runs(v: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """(f0, f1, x, y): runs along f of each (x, y) column; with ``owner`` it comes first, and runs are of one owner."""
    rows = np.column_stack([np.zeros(len(v), np.int64) if owner is None else owner, v])
    if not len(v):
        return np.zeros((0, 4 if owner is None else 5), np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 3], rows[:, 2], rows[:, 0]))]
    new = np.ones(len(v), bool)
    new[1:] = (rows[1:, [0, 2, 3]] != rows[:-1, [0, 2, 3]]).any(1) | (rows[1:, 1] != rows[:-1, 1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(v)) - 1
    return np.stack([rows[first, 0], rows[first, 1], rows[last, 1], rows[first, 2], rows[first, 3]], 1)[:, 1 if owner is None else 0 :]


def sphere(center: np.ndarray, radius: float, z: int) -> np.ndarray:
    """Voxels whose centre is within the radius plus half the diagonal of an equatorial voxel."""
    return spheres(center[None], np.array([radius], float), np.zeros(1, np.int64), z)[:, 1:]


def spheres(center: np.ndarray, radius: np.ndarray, owner: np.ndarray, z: int, most: int = 200_000) -> np.ndarray:
    """(owner, f, x, y) of many spheres, ``most`` candidates at a time."""
    if (radius <= 0).any():
        raise GeometryError("a radius must be above 0")
    e = to_ecef(center)
    corners = cells(from_ecef((e[:, None] + radius[:, None, None] * (1 - 2 * _CORNERS)).reshape(-1, 3)), z).reshape(-1, 8, 3)
    reach = radius + 2 * math.pi * EARTH_A / (1 << z) * math.sqrt(3) / 2
    lo, size, found = corners.min(1), corners.max(1) - corners.min(1) + 1, [np.zeros((0, 4), np.int64)]
    for run in _runs_of(size.prod(1), most):
        own, box = _boxes(lo[run], size[run])
        own += run.start
        hit = np.linalg.norm(to_ecef(centers(box, z)) - e[own], axis=1) <= reach[own]
        found.append(np.column_stack([owner[own[hit]], box[hit]]))
    return np.concatenate(found)


def cylinder_faces(ends: np.ndarray, radius: float, sides: int = PRISM_SIDES) -> list[np.ndarray]:
    low, high = (r[0] for r in prism_rings(ends[None], np.array([radius], float), sides))
    walls = [np.stack([low[k], low[(k + 1) % sides], high[(k + 1) % sides], high[k]]) for k in range(sides)]
    return [*walls, low[::-1], high]


def prism_rings(ends: np.ndarray, radius: np.ndarray, sides: int = PRISM_SIDES) -> tuple[np.ndarray, np.ndarray]:
    """Corners (n, sides, 3) of the lower and upper ends of the prisms that stand for cylinders (n, 2, 3)."""
    if (radius <= 0).any():
        raise GeometryError("a radius must be above 0")
    length = lambda v: np.array([math.sqrt(r.dot(r)) for r in v])[:, None]
    e = to_ecef(ends.reshape(-1, 3)).reshape(-1, 2, 3)
    a, b = e[:, 0], e[:, 1]
    axis = (b - a) / length(b - a)
    # The ring starts in the equatorial plane.
    u = np.stack([-axis[:, 1], axis[:, 0], np.zeros(len(a))], 1)
    upright = ~(u != 0).any(1)
    u = np.where(upright[:, None], [1.0, 0.0, 0.0], u / np.where(upright[:, None], 1.0, length(u)))
    v = np.where(upright[:, None], [0.0, 1.0, 0.0], _cross3(axis, u))
    angle = 2 * math.pi * np.arange(sides) / sides
    ring = radius[:, None, None] * (np.cos(angle)[:, None] * u[:, None] + np.sin(angle)[:, None] * v[:, None])
    made = from_ecef(np.concatenate([a[:, None] + ring, b[:, None] + ring]).reshape(-1, 3)).reshape(2, len(a), sides, 3)
    return made[0], made[1]


def cylinders(ends: np.ndarray, radius: np.ndarray, owner: np.ndarray, z: int) -> np.ndarray:
    """(owner, f, x, y) of many cylinders (n, 2, 3); those of one owner are filled one by one."""
    low, high = prism_rings(ends, radius)
    n, sides = low.shape[:2]
    walls = np.stack([low, np.roll(low, -1, 1), np.roll(high, -1, 1), high], 2).reshape(-1, 4, 3)
    walls, wall_of = polygons_triangles(walls)
    caps, cap_of = polygons_triangles(np.concatenate([low[:, ::-1], high]))
    surface = covers_of_triangles(np.concatenate([walls, caps]), np.concatenate([wall_of // sides, cap_of % n]), z)
    found = filled(surface)
    return np.column_stack([owner[found[:, 0]], found[:, 1:]])


def prism_sides(radius: float, z: int) -> int:
    """Sides that keep the prism's faces near three voxel heights wide at zoom z, never fewer than the fixed number."""
    return max(PRISM_SIDES, int(radius * math.pi / (3 * 2.0 ** (25 - z))))


def cylinder(ends: np.ndarray, radius: float, z: int) -> np.ndarray:
    return cylinders(ends[None], np.array([radius], float), np.zeros(1, np.int64), z)[:, 1:]


def tube(points: np.ndarray, radius: float, z: int) -> np.ndarray:
    """Spheres at the joints and cylinders between."""
    return tubes(points, np.array([len(points)]), np.array([radius], float), z)[:, 1:]


def tubes(points: np.ndarray, lengths: np.ndarray, radius: np.ndarray, z: int) -> np.ndarray:
    """(tube, f, x, y) of many tubes, which have ``lengths`` of the points."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    links = np.flatnonzero(own[1:] == own[:-1])
    parts = [spheres(points, radius[own], own, z)]
    if len(links):
        parts.append(cylinders(np.stack([points[links], points[links + 1]], 1), radius[own[links]], own[links], z))
    return distinct(np.concatenate(parts))


def triangle_area(corners: np.ndarray) -> float:
    p = to_ecef(corners)
    return float(np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) / 2)


def triangle_sides(corners: np.ndarray) -> list[float]:
    p = to_ecef(corners)
    return np.linalg.norm(p - np.roll(p, -1, 0), axis=1).tolist()
