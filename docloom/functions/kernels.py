"""Numpy kernels on one grey or colour image; the only pixel code. Jobs over image tables are in operators.images."""

from __future__ import annotations

import numpy as np


def pixels(image) -> np.ndarray:
    """(height, width, channels) of a row in Spark's image schema (blue, green, red order)."""
    return np.frombuffer(bytes(image["data"]), np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def grey(a: np.ndarray) -> np.ndarray:
    """8-bit grey; .114 blue + .587 green + .299 red, rounded."""
    if a.ndim == 2:
        return a
    if a.shape[2] == 1:
        return a[:, :, 0]
    return np.floor(a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299 + 0.5).astype(np.uint8)


def _padded(a: np.ndarray, k: int) -> np.ndarray:
    """Mirrored without repeating the border pixel, as far as the image is long enough."""
    return np.pad(a, k, mode="reflect" if min(a.shape) > k else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _padded(g.astype(np.int32), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def canny(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge mask: 3x3 Sobel, L1 norm, thinning across the gradient, and weak edges kept where they reach strong ones."""
    p = _padded(g.astype(np.int32), 1)
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    norm = np.abs(gx) + np.abs(gy)
    m = np.pad(norm, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * 0.41421356, ay > ax * 2.41421356
    same = (gx >= 0) == (gy >= 0)
    views = {"w": m[1:-1, :-2], "e": m[1:-1, 2:], "n": m[:-2, 1:-1], "s": m[2:, 1:-1], "nw": m[:-2, :-2], "se": m[2:, 2:], "ne": m[:-2, 2:], "sw": m[2:, :-2]}
    before = np.select([flat, steep, same], [views["w"], views["n"], views["nw"]], views["ne"])
    after = np.select([flat, steep, same], [views["e"], views["s"], views["se"]], views["sw"])
    peak = (norm > before) & (norm >= after)
    weak, out = peak & (norm > low), peak & (norm > high)
    while True:
        grown = np.pad(out, 1)
        near = weak & (grown[:-2, :-2] | grown[:-2, 1:-1] | grown[:-2, 2:] | grown[1:-1, :-2] | grown[1:-1, 2:] | grown[2:, :-2] | grown[2:, 1:-1] | grown[2:, 2:])
        if (near <= out).all():
            return out
        out |= near


def responses(g: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
    """The six measures of a template at every place of an image, by name."""
    g, t = g.astype(np.float64), t.astype(np.float64)
    (h, w), n = t.shape, t.size
    shape = tuple(1 << int(a + b - 1).bit_length() for a, b in zip(g.shape, t.shape, strict=True))
    cross = np.fft.irfft2(np.fft.rfft2(g, shape) * np.conj(np.fft.rfft2(t, shape)), shape)[: g.shape[0] - h + 1, : g.shape[1] - w + 1]

    def box(a: np.ndarray) -> np.ndarray:
        s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    total, square = box(g), box(g * g)
    energy = np.sqrt(np.maximum(square * (t * t).sum(), 1e-12))
    coefficient = cross - total * t.mean()
    spread = np.sqrt(np.maximum((square - total * total / n) * ((t - t.mean()) ** 2).sum(), 0))
    differences = np.maximum(square - 2 * cross + (t * t).sum(), 0)
    normed = np.where(spread > 1e-6, coefficient / np.maximum(spread, 1e-6), 0.0)
    return {"SQDIFF": differences, "SQDIFF_NORMED": differences / energy, "CCORR": cross, "CCORR_NORMED": cross / energy, "CCOEFF": coefficient, "CCOEFF_NORMED": np.clip(normed, -1, 1)}


def otsu(g: np.ndarray) -> int:
    """The threshold that parts the histogram best; pixels above it are foreground."""
    p = np.bincount(g.ravel(), minlength=256) / max(1, g.size)
    below, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
    return int(np.argmax(np.nan_to_num(between, posinf=0)))


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected part of a mask, by union of row runs."""
    runs, up = [], []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    last: list[int] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(runs)
            runs.append((y, a, b))
            up.append(k)
            now.append(k)
            for j in last:
                if runs[j][1] <= b and a <= runs[j][2]:
                    up[find(k)] = find(j)
        last = now
    out = np.zeros_like(mask, bool)
    size: dict[int, int] = {}
    for k, (_, a, b) in enumerate(runs):
        size[find(k)] = size.get(find(k), 0) + b - a
    if size:
        best = max(size, key=lambda r: (size[r], -r))
        for k, (y, a, b) in enumerate(runs):
            if find(k) == best:
                out[y, a:b] = True
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in ring order, without points on edges."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(some: list) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2) if len(p) > 2 else 0.0


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline cut down to points that are farther than the tolerance from the line between their neighbours."""
    if len(points) < 4:
        return points
    start = int(np.argmax(((points - points.mean(0)) ** 2).sum(1)))
    ring = np.roll(points, -start, 0)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(1)))
    closed, keep = np.concatenate((ring, ring[:1])), {0, far}
    stack = [(0, far), (far, len(ring))]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, p = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(k for k in keep if k < len(ring))]


def find_quad(g: np.ndarray) -> np.ndarray | None:
    """The four corners of the brightest large shape: Otsu, the largest part above 15 % of the frame, its hull, cut down at 4 % of its perimeter to four points."""
    part = largest_component(g > otsu(g))
    ys, xs = np.nonzero(part)
    if not len(xs):
        return None
    # nonzero() goes row by row, so each row's outermost pixels are where the row number changes.
    turn = np.flatnonzero(np.diff(ys))
    ends = np.concatenate(([0], turn, turn + 1, [len(ys) - 1]))
    ring = hull(np.stack((xs[ends], ys[ends]), 1))
    if polygon_area(ring) <= 0.15 * g.size:
        return None
    around = np.hypot(*(ring - np.roll(ring, -1, 0)).T).sum()
    corners = simplified(ring, 0.04 * around)
    return corners if len(corners) == 4 else None


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warp(a: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral (corners in ring order from top-left) as an image of a size, sampled bilinearly; 0 outside."""
    ends = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    back = homography(ends, np.asarray(corners, float))
    y, x = np.mgrid[:height, :width]
    u, v, w = np.einsum("ij,jyx->iyx", back, np.stack((x, y, np.ones_like(x))).astype(float))
    u, v = u / w, v / w
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = (u - x0)[..., None], (v - y0)[..., None]
    a = a if a.ndim == 3 else a[:, :, None]

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        ok = (yy >= 0) & (yy < a.shape[0]) & (xx >= 0) & (xx < a.shape[1])
        return a[np.clip(yy, 0, a.shape[0] - 1), np.clip(xx, 0, a.shape[1] - 1)] * ok[..., None]

    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def adaptive(g: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood's mean less c, else 0."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    x = np.arange(block) - block // 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(g.astype(float), block // 2, mode="edge")
    rows = sum(w * p[i : i + g.shape[0], :] for i, w in enumerate(k))
    mean = sum(w * rows[:, i : i + g.shape[1]] for i, w in enumerate(k))
    return np.where(g > np.floor(mean + 0.5) - c, 255, 0).astype(np.uint8)


def rotated(a: np.ndarray, degrees: int, mirror: bool = False) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees; a mirrored frame is flipped and turned a quarter back first."""
    if mirror:
        a = np.rot90(a[:, ::-1], 1)
    return np.ascontiguousarray(np.rot90(a, -(degrees // 90) % 4))
