"""NumPy geometry for what expressions cannot say: hulls, smallest boxes, convex intersections."""

from __future__ import annotations

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, without collinear points."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def smallest_box(points: np.ndarray) -> dict:
    """Rectangle of least area around the points: length, width, angle_deg in [0, 180), corners."""
    h = hull(points)
    if len(h) == 1:
        return {"length": 0.0, "width": 0.0, "angle_deg": 0.0, "corners": np.repeat(h, 4, 0)}
    edges = np.diff(np.vstack([h, h[:1]]), axis=0)
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    u = np.stack([np.cos(angles), np.sin(angles)], 1)
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = h @ u.T, h @ v.T
    spans = np.ptp(a, 0), np.ptp(b, 0)
    k = int(np.argmin(spans[0] * spans[1]))
    lo, hi = (a[:, k].min(), b[:, k].min()), (a[:, k].max(), b[:, k].max())
    corners = np.array([u[k] * x + v[k] * y for x, y in ((lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1]))])
    long_first = spans[0][k] >= spans[1][k]
    angle = np.degrees(angles[k]) + (0 if long_first else 90)
    return {"length": float(max(spans[0][k], spans[1][k])), "width": float(min(spans[0][k], spans[1][k])), "angle_deg": float(angle % 180), "corners": corners}


def area(ring: np.ndarray) -> float:
    r = np.asarray(ring, float)
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0], r[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Intersection of a polygon with a convex one."""
    out, w = np.asarray(subject, float), np.asarray(window, float)
    if np.dot(w[:, 0], np.roll(w[:, 1], -1)) < np.dot(w[:, 1], np.roll(w[:, 0], -1)):
        w = w[::-1]
    for p, q in zip(w, np.roll(w, -1, 0)):
        if not len(out):
            return out
        side = (q[0] - p[0]) * (out[:, 1] - p[1]) - (q[1] - p[1]) * (out[:, 0] - p[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] < 0) != (side[j] < 0):
                kept.append(out[i] + (out[j] - out[i]) * (side[i] / (side[i] - side[j])))
        out = np.array(kept)
    return out


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    return area(clip(a, b))


def ring_array(column) -> np.ndarray:
    """[row, corner, (x, y)] of an Arrow column of rings; shorter rings repeat their last corner."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1) if len(flat) else np.empty((0, 2))
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    place = start[:, None] + np.minimum(np.arange(max(1, size.max(initial=1))), np.maximum(size, 1)[:, None] - 1)
    return xy[place] if len(xy) else np.zeros((len(column), 1, 2))


def areas(rings: np.ndarray) -> np.ndarray:
    x, y = rings[..., 0], rings[..., 1]
    return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def overlap_areas(subjects: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """``overlap_area`` of many pairs at once; windows convex."""
    x, y = windows[..., 0], windows[..., 1]
    turned = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) < 0
    windows = np.where(turned[:, None, None], windows[:, ::-1], windows)
    out = subjects
    dead = np.zeros(len(out), bool)
    for k in range(windows.shape[1]):
        p, q = windows[:, k, None], windows[:, (k + 1) % windows.shape[1], None]
        side = (q - p)[..., 0] * (out - p)[..., 1] - (q - p)[..., 1] * (out - p)[..., 0]
        after, other = np.roll(out, -1, 1), np.roll(side, -1, 1)
        kept, cut = side >= 0, (side < 0) != (other < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = out + (after - out) * np.where(cut, side / (side - other), 0)[..., None]
        both = np.stack([out, cross], 2).reshape(len(out), -1, 2)
        use = np.stack([kept, cut], 2).reshape(len(out), -1)
        n = use.sum(1)
        dead |= n == 0
        order = np.argsort(~use, axis=1, kind="stable")
        width = max(1, int(n.max(initial=1)))
        order = order[np.arange(len(out))[:, None], np.minimum(np.arange(width), np.maximum(n, 1)[:, None] - 1)]
        out = both[np.arange(len(out))[:, None], order]
    return np.where(dead, 0.0, areas(out))
