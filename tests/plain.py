"""Plain numpy versions of cell weights and line parts, which the operators are held against."""

import numpy as np


def block_weights(rings: list[np.ndarray], col0: int, row0: int, size: int) -> np.ndarray:
    """Covered fraction of each unit cell of a block of ``size`` x ``size`` cells.

    Each side is cut at the grid lines; a piece covers its cell to its right and all cells further right, by its signed height. So the
    work goes with the cells that sides cross, and cells inside come from a running sum.
    """
    own, right = np.zeros((size, size)), np.zeros((size, size + 1))
    for ring in rings:
        p = ring - (col0, row0)
        q = np.roll(p, -1, 0)
        (x0, y0), (x1, y1) = p.T, q.T
        met = (y0 != y1) & (np.maximum(y0, y1) > 0) & (np.minimum(y0, y1) < size) & (np.minimum(x0, x1) < size)
        for a, b in zip(p[met], q[met], strict=True):
            d = b - a
            cuts = [np.array([0.0, 1.0])]
            for axis in (0, 1):
                low, high = sorted((a[axis], b[axis]))
                lines = np.arange(max(0, np.ceil(low)), min(size, np.floor(high)) + 1)
                if d[axis] and len(lines):
                    cuts.append((lines - a[axis]) / d[axis])
            t = np.unique(np.clip(np.concatenate(cuts), 0, 1))
            x, y = (a + d * ((t[:-1] + t[1:]) / 2)[:, None]).T
            height = d[1] * np.diff(t)
            inside = (y >= 0) & (y < size) & (x < size)
            x, row, height = x[inside], np.floor(y[inside]).astype(int), height[inside]
            col = np.floor(x).astype(int)
            here = col >= 0
            np.add.at(own, (row[here], col[here]), height[here] * (1 - (x - col)[here]))
            np.add.at(right, (row, np.maximum(col + 1, 0)), height)
    out = np.abs(own + np.cumsum(right, axis=1)[:, :size])
    return np.where(out < 1e-12, 0.0, np.minimum(out, 1.0))


def spans_inside(line: np.ndarray, rings: list[np.ndarray]) -> list[tuple[int, float, float]]:
    """The parts of a line within a polygon: (segment, from, to) in shares of the segment. Segments are cut at the rings and kept by the parity of their middles."""
    sides = np.concatenate([np.hstack([r, np.roll(r, -1, 0)]) for r in rings])
    x1, y1, x2, y2 = sides.T
    e = sides[:, 2:] - sides[:, :2]
    spans = []
    for k, (p, q) in enumerate(zip(line[:-1], line[1:], strict=True)):
        d = q - p
        w = sides[:, :2] - p
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / cross
            u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / cross
        cuts = t[(cross != 0) & (u >= 0) & (u <= 1) & (t > 0) & (t < 1)]
        ends = np.concatenate([[0.0], np.sort(cuts), [1.0]])
        middles = p + d * ((ends[:-1] + ends[1:]) / 2)[:, None]
        x, y = middles[:, :1], middles[:, 1:]
        across = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        inside = (across & right).sum(1) % 2 == 1
        spans += [(k, float(a), float(b)) for a, b in zip(ends[:-1][inside], ends[1:][inside], strict=True) if b > a]
    return spans


def parts_inside(line: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """The parts of a line within a polygon, as two-point lines."""
    return [line[k] + (line[k + 1] - line[k]) * np.array([[a], [b]]) for k, a, b in spans_inside(line, rings)]


def length_inside(line: np.ndarray, rings: list[np.ndarray]) -> float:
    """Length of the parts of a line within a polygon."""
    return float(sum(np.hypot(*(b - a)) for a, b in parts_inside(line, rings)))
