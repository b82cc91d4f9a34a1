"""Small numpy kernels for what columns can't express: clipping to rectangles, and moving windows."""

from __future__ import annotations

import numpy as np


def rings_of(polygon) -> list[np.ndarray]:
    """Rings as arrays of points, from the nested rows that Arrow gives."""
    return [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in polygon]


def _half(ring: np.ndarray, axis: int, at: float, keep_low: bool) -> np.ndarray:
    """The part of a ring on one side of an axis-parallel line (Sutherland-Hodgman); area stays exact for concave rings."""
    if not len(ring):
        return ring
    inside = ring[:, axis] <= at if keep_low else ring[:, axis] >= at
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    out = []
    for i in range(len(ring)):
        p, q = ring[i - 1], ring[i]
        if inside[i - 1] != inside[i]:
            t = (at - p[axis]) / (q[axis] - p[axis])
            cut = p + t * (q - p)
            cut[axis] = at
            out.append(cut)
        if inside[i]:
            out.append(q)
    return np.array(out)


def clip_rect(rings: list[np.ndarray], xmin: float, ymin: float, xmax: float, ymax: float) -> list[np.ndarray]:
    """Rings clipped to a rectangle; the closing point of a ring may be left out."""
    out = []
    for ring in rings:
        ring = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
        for axis, at, low in ((0, xmin, False), (0, xmax, True), (1, ymin, False), (1, ymax, True)):
            ring = _half(ring, axis, at, low)
        if len(ring) > 2:
            out.append(ring)
    return out


def ring_area(rings: list[np.ndarray]) -> float:
    """Area of rings, holes subtracting."""
    total = 0.0
    for r in rings:
        x, y = r[:, 0], r[:, 1]
        total += float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    return abs(total)


def convolve(image: np.ndarray, weights: dict[tuple[int, int], float]) -> np.ndarray:
    """Weighted sum over offsets (row, col) of an image that has the needed margin; the margin is cut off."""
    r = max(max(abs(i), abs(j)) for i, j in weights)
    h, w = image.shape[0] - 2 * r, image.shape[1] - 2 * r
    out = np.zeros((h, w))
    for (i, j), k in weights.items():
        out += k * image[r + i : r + i + h, r + j : r + j + w]
    return out


def disk(radius: int) -> dict[tuple[int, int], float]:
    """A circular kernel that sums to one."""
    span = range(-radius, radius + 1)
    inside = [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]
    return {at: 1 / len(inside) for at in inside}


def box(size: int) -> dict[tuple[int, int], float]:
    span = range(-(size // 2), size // 2 + 1)
    return {(i, j): 1 / size**2 for i in span for j in span}


def gaussian(sigma: float, truncate: float) -> dict[tuple[int, int], float]:
    r = int(truncate * sigma + 0.5)
    line = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    line /= line.sum()
    return {(i - r, j - r): float(line[i] * line[j]) for i in range(2 * r + 1) for j in range(2 * r + 1)}
