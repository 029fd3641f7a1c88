"""Outlines of many contours at once, in numpy over Arrow's buffers: the same sums in the same order as the columns of
`operators.geometry`, so the same doubles.

Contours of like length are the columns of a padded table and take each step of a fold together. Stretches that
Douglas and Peucker split lie one behind the other, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Points that are worked on together.
CHUNK = 1 << 19
#: Coordinates beyond this, whose products could overflow, are left to the columns.
FAR = 1e100
NAMES = ("left", "top", "right", "bottom", "area", "perimeter", "hull")
TYPE = "struct<left:double,top:double,right:double,bottom:double,area:double,perimeter:double,hull:double,vertices:int>"


def _sum(terms: np.ndarray) -> np.ndarray:
    """Sums of columns, row by row: numpy's own would add in pairs."""
    out = np.zeros(terms.shape[1])
    for row in terms:
        out += row
    return out


def _area(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of polygons, the first size rows of each column."""
    k, columns = np.arange(len(x))[:, None], np.arange(x.shape[1])
    after = np.where(k + 1 < size, k + 1, 0)
    return np.abs(_sum(np.where(k < size, x * y[after, columns] - x[after, columns] * y, 0.0))) / 2


def _chain(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The convex chain over sorted points: row numbers in columns, and how many."""
    chain, n = np.zeros(x.shape, np.int64), np.zeros(len(size), np.int64)
    at, live = np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
    while len(live):
        top, i = n[live], at[live]
        a, b = chain[np.maximum(top - 2, 0), live], chain[np.maximum(top - 1, 0), live]
        ox, oy = x[a, live], y[a, live]
        off = (top >= 2) & ((x[b, live] - ox) * (y[i, live] - oy) - (y[b, live] - oy) * (x[i, live] - ox) <= 0)
        on = live[~off]
        chain[n[on], on] = at[on]
        at[on] += 1
        n[live] += np.where(off, -1, 1)
        live = live[at[live] < size[live]]
    return chain, n


def _hull_area(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """x and y are infinite behind the first size rows."""
    order = np.lexsort((y, x), axis=0)
    x, y = np.take_along_axis(x, order, 0), np.take_along_axis(y, order, 0)
    known = np.arange(len(x))[:, None] < size
    known[1:] &= (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    order = np.argsort(~known, axis=0, kind="stable")
    x, y, m = np.take_along_axis(x, order, 0), np.take_along_axis(y, order, 0), known.sum(axis=0)
    row, columns = np.arange(len(x))[:, None], np.arange(len(m))
    # The upper chain runs over the points backwards.
    back = np.where(row < m, m - 1 - row, row)
    low, n_low = _chain(x, y, m)
    high, n_high = _chain(x[back, columns], y[back, columns], m)
    n_low, n_high = np.maximum(n_low - 1, 0), np.maximum(n_high - 1, 0)
    rest = np.clip(row - n_low, 0, len(x) - 1)
    ring = np.where(row < n_low, low, np.clip(m - 1 - high[rest, columns], 0, len(x) - 1))
    return np.where(m < 3, 0.0, _area(x[ring, columns], y[ring, columns], n_low + n_high))


def _vertices(x: np.ndarray, y: np.ndarray, size: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """How many points of closed outlines are left by Douglas and Peucker, from the point farthest from the middle."""
    row, columns = np.arange(len(x))[:, None], np.arange(len(size))
    known = row < size

    def farthest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return np.where(known, (x - px) * (x - px) + (y - py) * (y - py), -1.0).argmax(axis=0)

    start = farthest(x, y, _sum(np.where(known, x, 0.0)) / size, _sum(np.where(known, y, 0.0)) / size)
    turn = np.where(known, (row + start) % size, row)
    x, y = x[turn, columns], y[turn, columns]
    far = farthest(x, y, x[0], y[0])
    count = np.where(far > 0, 2, 1)
    of, a, b = np.tile(columns, 2), np.concatenate((np.zeros_like(far), far)), np.concatenate((far, size))
    while True:
        long = b - a >= 2
        of, a, b = of[long], a[long], b[long]
        if not len(of):
            return np.where(size < 4, size, count)
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        which = np.repeat(np.arange(len(of)), inner)
        k = np.arange(inner.sum()) - first[which] + a[which] + 1
        px, py, end = x[a, of], y[a, of], b % size[of]
        dx, dy = x[end, of] - px, y[end, of] - py
        length = np.sqrt(dx * dx + dy * dy)
        zx, zy = x[k, of[which]] - px[which], y[k, of[which]] - py[which]
        flat = length[which] > 0
        off = np.where(flat, np.abs(dx[which] * zy - dy[which] * zx) / np.where(flat, length[which], 1.0), np.sqrt(zx * zx + zy * zy))
        most = np.maximum.reduceat(off, first)
        cut = np.minimum.reduceat(np.where(off == most[which], k, len(x)), first)
        go = most > tolerance[of]
        count += np.bincount(of[go], minlength=len(count))
        of, a, b = np.tile(of[go], 2), np.concatenate((a[go], cut[go])), np.concatenate((cut[go], b[go]))


def measures(x: np.ndarray, y: np.ndarray, size: np.ndarray, share: float) -> dict[str, np.ndarray]:
    """Of contours that lie one behind the other (all finite, none empty): bounds, area, perimeter, area of the hull and the
    vertices left at a share of the perimeter."""
    out = {n: np.zeros(len(size)) for n in NAMES} | {"vertices": np.zeros(len(size), np.int32)}
    first = np.cumsum(size) - size
    # Lengths of one power of two are padded to the longest.
    order = np.argsort(size, kind="stable")
    grade = np.frexp(size[order])[1]
    for part in np.split(order, np.flatnonzero(np.diff(grade)) + 1):
        step = max(1, CHUNK // int(size[part].max(initial=1)))
        for some in (part[i : i + step] for i in range(0, len(part), step)):
            n = size[some]
            row = np.arange(n.max())[:, None]
            at, known = first[some] + np.minimum(row, n - 1), row < n
            px, py = x[at], y[at]
            after = np.where(row + 1 < n, row + 1, 0)
            dx, dy = np.take_along_axis(px, after, 0) - px, np.take_along_axis(py, after, 0) - py
            around = _sum(np.where(known, np.sqrt(dx * dx + dy * dy), 0.0))
            hull = _hull_area(np.where(known, px, np.inf), np.where(known, py, np.inf), n)
            for name, found in zip(NAMES, (px.min(axis=0), py.min(axis=0), px.max(axis=0), py.max(axis=0), _area(px, py, n), around, hull), strict=True):
                out[name][some] = found
            out["vertices"][some] = _vertices(px, py, n, around * share)
    return out


def measured(points: pa.Array, share: float) -> pa.Array:
    """A struct for each list of points; null for lists that are null or empty or hold points that are null, not finite or too far out."""
    if isinstance(points, pa.ChunkedArray):
        points = points.combine_chunks()
    flat, size = points.flatten(), points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in flat.flatten())
    with np.errstate(invalid="ignore"):
        bad = ~((np.abs(x) < FAR) & (np.abs(y) < FAR))
    of = np.repeat(np.arange(len(size)), size)
    good = (size > 0) & (np.bincount(of[bad], minlength=len(size)) == 0)
    kept = good[of]
    found = measures(x[kept], y[kept], size[good], share)
    place = pa.array(np.where(good, np.cumsum(good) - 1, 0), mask=~good)
    return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found)).take(place)
