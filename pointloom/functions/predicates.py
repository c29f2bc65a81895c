"""Exact signs of orientation and in-sphere determinants, and the Delaunay cells of a tile's points."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1


def _exact_rows(p: np.ndarray) -> list[list[Fraction]]:
    return [[Fraction(v) for v in row] for row in p.tolist()]


def _det3(a, b, c):
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def orientation(t: np.ndarray) -> np.ndarray:
    """Signs for tetrahedra t (m, 4, 3): of det(a - d, b - d, c - d); exact where rounding could matter."""
    u, v, w = (t[:, i] - t[:, 3] for i in range(3))
    det = np.einsum("ij,ij->i", u, np.cross(v, w))
    bound = 1e-14 * np.abs(u).max(1, initial=0) * np.abs(v).max(1, initial=0) * np.abs(w).max(1, initial=0) * 16
    out = np.sign(det).astype(np.int64)
    for k in np.flatnonzero(np.abs(det) <= bound):
        a, b, c, d = _exact_rows(t[k])
        x = _det3(*([p - q for p, q in zip(r, d, strict=True)] for r in (a, b, c)))
        out[k] = (x > 0) - (x < 0)
    return out


def in_sphere(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For positively oriented t (m, 4, 3): whether p lies inside the sphere. Cospherical points are told apart by a symbolic lift that grows with their lexicographic order, the same in every subset."""
    r = t - p
    s = np.einsum("ijk,ijk->ij", r, r)
    minor = [np.einsum("ij,ij->i", r[:, i], np.cross(r[:, j], r[:, k])) for i, j, k in ((1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2))]
    # sum of cofactors along the column of squared lengths
    det = -s[:, 0] * minor[0] + s[:, 1] * minor[1] - s[:, 2] * minor[2] + s[:, 3] * minor[3]
    size = np.abs(r).max((1, 2), initial=0)
    out = det > 0
    for k in np.flatnonzero(np.abs(det) <= 1e-13 * size**5 * 100):
        out[k] = _in_sphere_exact(t[k], p)
    return out


def _in_sphere_exact(t: np.ndarray, p: np.ndarray) -> bool:
    rows, q = _exact_rows(t), [Fraction(v) for v in p.tolist()]
    r = [[a - b for a, b in zip(x, q, strict=True)] for x in rows]
    s = [sum(v * v for v in x) for x in r]
    det = -s[0] * _det3(r[1], r[2], r[3]) + s[1] * _det3(r[0], r[2], r[3]) - s[2] * _det3(r[0], r[1], r[3]) + s[3] * _det3(r[0], r[1], r[2])
    if det:
        return det > 0
    five = sorted([(tuple(x.tolist()), i) for i, x in enumerate(t)] + [(tuple(p.tolist()), 4)], reverse=True)
    for _, i in five:
        if i == 4:
            return False
        u = t.copy()
        u[i] = p
        if sign := int(orientation(u[None])[0]):
            return sign > 0
    return False


def _sign(a: tuple, b: tuple, c: tuple, d: tuple) -> int:
    """The sign of det(a - d, b - d, c - d), exact where rounding could matter."""
    ux, uy, uz = a[0] - d[0], a[1] - d[1], a[2] - d[2]
    vx, vy, vz = b[0] - d[0], b[1] - d[1], b[2] - d[2]
    wx, wy, wz = c[0] - d[0], c[1] - d[1], c[2] - d[2]
    det = ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)
    bound = 1.6e-13 * max(abs(ux), abs(uy), abs(uz)) * max(abs(vx), abs(vy), abs(vz)) * max(abs(wx), abs(wy), abs(wz))
    if det > bound:
        return 1
    if det < -bound:
        return -1
    rows = [[Fraction(v) for v in q] for q in (a, b, c, d)]
    x = _det3(*([p - q for p, q in zip(r, rows[3], strict=True)] for r in rows[:3]))
    return (x > 0) - (x < 0)


def _within(a: tuple, b: tuple, c: tuple, d: tuple, p: tuple) -> bool:
    """``in_sphere`` of one cell."""
    x, y, z = p
    ax, ay, az, bx, by, bz = a[0] - x, a[1] - y, a[2] - z, b[0] - x, b[1] - y, b[2] - z
    cx, cy, cz, dx, dy, dz = c[0] - x, c[1] - y, c[2] - z, d[0] - x, d[1] - y, d[2] - z
    cdx, cdy, cdz = cy * dz - cz * dy, cz * dx - cx * dz, cx * dy - cy * dx
    abx, aby, abz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    det = (ax * ax + ay * ay + az * az) * -(bx * cdx + by * cdy + bz * cdz) + (bx * bx + by * by + bz * bz) * (ax * cdx + ay * cdy + az * cdz)
    det += (cx * cx + cy * cy + cz * cz) * -(dx * abx + dy * aby + dz * abz) + (dx * dx + dy * dy + dz * dz) * (cx * abx + cy * aby + cz * abz)
    size = max(abs(ax), abs(ay), abs(az), abs(bx), abs(by), abs(bz), abs(cx), abs(cy), abs(cz), abs(dx), abs(dy), abs(dz))
    if abs(det) > 1e-11 * size**5:
        return det > 0
    return _in_sphere_exact(np.array([a, b, c, d]), np.array(p))


def circumspheres(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the spheres through the corners of tetrahedra t (m, 4, 3) that aren't flat; of those so thin that rounding could matter from exact fractions."""
    u = t[:, :3] - t[:, 3:]
    thin = np.abs(np.einsum("ij,ij->i", u[:, 0], np.cross(u[:, 1], u[:, 2]))) <= 1e-8 * np.abs(u).max((1, 2), initial=0) ** 3
    rel = np.zeros((len(t), 3))
    if not thin.all():
        rel[~thin] = np.linalg.solve(u[~thin], (u[~thin] ** 2).sum(2)[..., None] / 2)[..., 0]
    for k in np.flatnonzero(thin):
        *abc, d = _exact_rows(t[k])
        rows = [[p - q for p, q in zip(r, d, strict=True)] for r in abc]
        half, det = [sum(v * v for v in r) / 2 for r in rows], _det3(*rows)
        # Cramer's rule: a column for each coordinate
        rel[k] = [float(_det3(*[[h if j == i else v for j, v in enumerate(r)] for r, h in zip(rows, half, strict=True)]) / det) for i in range(3)]
    return rel + t[:, 3], (rel**2).sum(1)


def _near_order(points: np.ndarray) -> np.ndarray:
    """Points along a curve that visits neighbours after each other."""
    span = np.ptp(points, axis=0)
    q = ((points - points.min(0)) / np.where(span > 0, span, 1) * 1023).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for bit in range(10):
        for k in range(3):
            code |= (q[:, k] >> bit & 1) << (3 * bit + k)
    return np.argsort(code, kind="stable")


def delaunay(points: np.ndarray) -> np.ndarray:
    """Cells (m, 4) of the Delaunay triangulation of different points (n, 3), positively oriented, with GHOST in those outside a facet of the hull; none if all points are in one plane.

    Points are inserted along a curve. A walk from the last cell finds the one that a point lies in; the cells whose spheres hold the point are found from there
    over their neighbours and replaced, so an insertion looks at some fifty cells however many there are.
    """
    base = _independent(points)
    if base is None:
        return np.zeros((0, 4), np.int64)
    if orientation(points[base][None])[0] < 0:
        base = [base[1], base[0], *base[2:]]
    pts = [tuple(row) for row in points.tolist()]
    verts: list[list[int]] = [list(base)]
    for i in range(4):
        g = list(base)
        g[i] = GHOST
        j, k = [x for x in range(4) if x != i][:2]
        g[j], g[k] = g[k], g[j]
        verts.append(g)
    near: list[list[int]] = [[1, 2, 3, 4]]
    for i in range(4):
        near.append([0 if v == GHOST else 1 + base.index(v) for v in verts[1 + i]])
    free: list[int] = []
    last = 0

    def beyond(c: int, p: tuple) -> int:
        """For a ghost cell, the side of its facet that a point is on: 1 outside."""
        t = [p if v == GHOST else pts[v] for v in verts[c]]
        return _sign(*t)

    def conflicts(c: int, p: tuple) -> bool:
        v = verts[c]
        if GHOST in v:
            side = beyond(c, p)
            if side:
                return side > 0
            # in the plane of the facet: as the finite cell behind it
            return conflicts(near[c][v.index(GHOST)], p)
        return _within(pts[v[0]], pts[v[1]], pts[v[2]], pts[v[3]], p)

    def locate(p: tuple, c: int) -> int:
        came = -1
        while True:
            v = verts[c]
            if GHOST in v:
                return c
            for i in range(4):
                if near[c][i] == came:
                    continue
                t = [pts[x] for x in v]
                t[i] = p
                if _sign(*t) < 0:
                    came, c = c, near[c][i]
                    break
            else:
                return c

    skip = set(base)
    for n in _near_order(points).tolist():
        if n in skip:
            continue
        p = pts[n]
        start = locate(p, last)
        known = {start: True}
        todo, rim = [start], []
        while todo:
            c = todo.pop()
            for i in range(4):
                o = near[c][i]
                if (hit := known.get(o)) is None:
                    hit = known[o] = conflicts(o, p)
                    if hit:
                        todo.append(o)
                if not hit:
                    rim.append((c, i, o))
        edges: dict[tuple[int, int], tuple[int, int]] = {}
        made = []
        for c, i, o in rim:
            v = list(verts[c])
            v[i] = n
            if free:
                new = free.pop()
                verts[new], near[new] = v, [-1] * 4
            else:
                new = len(verts)
                verts.append(v)
                near.append([-1] * 4)
            made.append(new)
            near[new][i] = o
            # the outer cell's side towards the cavity
            face = set(v) - {n}
            near[o][next(k for k in range(4) if verts[o][k] not in face)] = new
            for j in range(4):
                if j != i:
                    x, y = sorted(w for k, w in enumerate(v) if k not in (i, j))
                    if (other := edges.pop((x, y), None)) is None:
                        edges[x, y] = (new, j)
                    else:
                        near[new][j], near[other[0]][other[1]] = other[0], new
        for c, hit in known.items():
            if hit:
                verts[c] = []
                free.append(c)
        last = next((c for c in made if GHOST not in verts[c]), made[0])
        if GHOST in verts[last]:
            last = near[last][verts[last].index(GHOST)]
    return np.array([v for v in verts if v], np.int64).reshape(-1, 4)


def _independent(points: np.ndarray) -> list[int] | None:
    """Four points that are not in one plane."""
    if len(points) < 4:
        return None
    rows = _exact_rows(points)
    minus = lambda i: [a - b for a, b in zip(rows[i], rows[0], strict=True)]
    u = minus(1)
    for j in range(2, len(points)):
        v = minus(j)
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        if any(n):
            for k in range(j + 1, len(points)):
                if sum(a * b for a, b in zip(n, minus(k), strict=True)):
                    return [0, 1, j, k]
            return None
    return None
