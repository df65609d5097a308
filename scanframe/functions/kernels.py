"""Small NumPy helpers that run inside Arrow tasks, one frame or strip at a time.

Everything that is summed over pixels stays in whole numbers, so partial results add up exactly in any order; the
floating-point part of a score is a Column expression on those sums.
"""

from __future__ import annotations

import numpy as np

# Second-derivative and smoothing rows of the size-7 Laplacian, and the size-3 Laplacian.
SECOND_7 = (1, 2, -1, -4, -1, 2, 1)
SMOOTH_7 = (1, 6, 15, 20, 15, 6, 1)
LAPLACE_3 = ((2, 0, 2), (0, -8, 0), (2, 0, 2))
GRAY_FIXED = (3735, 19235, 9798)  # blue, green, red; 15-bit fixed point


def image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Bytes of a frame as (height, width, channels); colour order is blue, green, red."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0]
    total = sum(w * img[:, :, c].astype(np.int32) for c, w in enumerate(GRAY_FIXED))
    return ((total + (1 << 14)) >> 15).astype(np.uint8)


def mirrored(a: np.ndarray, pad: int) -> np.ndarray:
    """Mirrors the last two axes at the border without repeating the edge value."""
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(pad, pad), (pad, pad)], mode="reflect")


def blur(g: np.ndarray) -> np.ndarray:
    """Binomial 3x3 blur of an 8-bit plane, rounded."""
    p = mirrored(g.astype(np.int32), 1)
    rows = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    return (rows[..., :-2] + 2 * rows[..., 1:-1] + rows[..., 2:] + 8) >> 4


def _along(p: np.ndarray, taps: tuple[int, ...], axis: int) -> np.ndarray:
    n = p.shape[axis] - len(taps) + 1
    window = lambda k: p[(..., slice(k, k + n), slice(None)) if axis == -2 else (..., slice(k, k + n))]
    return sum(t * window(k) for k, t in enumerate(taps) if t)


def abs_laplacian(g: np.ndarray, ksize: int = 3) -> np.ndarray:
    """Absolute Laplacian of the last two axes, each plane with its own mirrored border."""
    a = g.astype(np.int32)
    if ksize == 3:
        p = mirrored(a, 1)
        lap = 2 * (p[..., :-2, :-2] + p[..., :-2, 2:] + p[..., 2:, :-2] + p[..., 2:, 2:]) - 8 * a
    elif ksize == 7:
        p = mirrored(a, 3)
        lap = (_along(_along(p, SECOND_7, -1), SMOOTH_7, -2) + _along(_along(p, SMOOTH_7, -1), SECOND_7, -2))
    else:
        raise ValueError("Laplacian size must be 3 or 7")
    return np.abs(lap)


def moments(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, sum of squares and interpolated 90th percentile per plane of (n, h, w)."""
    flat = planes.reshape(len(planes), -1).astype(np.int64)
    return flat.sum(1), (flat * flat).sum(1), np.percentile(flat, 90, axis=1)


def tiles(plane: np.ndarray, tile: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Origins (y, x) and cut tiles of a plane; a plane smaller than a tile gives one clipped tile."""
    h, w = plane.shape
    th, tw = min(tile, h), min(tile, w)
    ys, xs = np.arange(0, max(1, h - tile + 1), stride), np.arange(0, max(1, w - tile + 1), stride)
    view = np.lib.stride_tricks.sliding_window_view(plane, (th, tw))[ys][:, xs]
    yy, xx = np.meshgrid(ys, xs, indexing="ij")
    return yy.ravel(), xx.ravel(), view.reshape(-1, th, tw)


def resize(plane: np.ndarray, scale: float) -> np.ndarray:
    """Area mean below 1, bilinear above 1; 8-bit, rounded half-even."""
    h, w = plane.shape
    nh, nw = max(1, int(round(h * scale))), max(1, int(round(w * scale)))

    def area(n_in: int, n_out: int) -> np.ndarray:
        edges = np.arange(n_out + 1) * (n_in / n_out)
        low, high = edges[:-1, None], edges[1:, None]
        cells = np.arange(n_in)[None, :]
        share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
        return share / share.sum(1, keepdims=True)

    def linear(n_in: int, n_out: int) -> np.ndarray:
        at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
        left = np.floor(at).astype(int)
        right, part = np.minimum(left + 1, n_in - 1), at - left
        weights = np.zeros((n_out, n_in))
        np.add.at(weights, (np.arange(n_out), left), 1 - part)
        np.add.at(weights, (np.arange(n_out), right), part)
        return weights

    weigh = area if scale < 1 else linear
    mixed = weigh(h, nh) @ plane.astype(np.float64) @ weigh(w, nw).T
    return np.rint(np.round(mixed, 9)).astype(np.uint8)


def turned(img: np.ndarray, turns: list[str]) -> np.ndarray:
    for turn in turns:
        img = np.rot90(img, {"ccw": 1, "cw": -1, "half": 2}[turn])
    return np.ascontiguousarray(img)


def close_cross(plane: np.ndarray) -> np.ndarray:
    """Morphological closing with the 3x3 cross: dilate, then erode; outside pixels never win."""
    def sweep(p: np.ndarray, pick, outside: int) -> np.ndarray:
        q = np.pad(p, 1, constant_values=outside)
        return pick.reduce([q[1:-1, 1:-1], q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, :-2], q[1:-1, 2:]])
    return sweep(sweep(plane, np.maximum, 0), np.minimum, 255)


def correlation(n: int, sa: int, sb: int, saa: int, sbb: int, sab: int) -> float | None:
    """Normalised cross-correlation from exact sums; None where a region is flat."""
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return None if va <= 0 or vb <= 0 else (n * sab - sa * sb) / (va ** 0.5 * vb ** 0.5)


def _table(plane: np.ndarray) -> np.ndarray:
    """Summed-area table with a zero row and column in front."""
    return np.pad(plane.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def _box(table: np.ndarray, y: int, x: int, h: int, w: int) -> int:
    return int(table[y + h, x + w] - table[y, x + w] - table[y + h, x] + table[y, x])


def pair_scorer(left: np.ndarray, right: np.ndarray, min_height: int):
    """Function (overlap, dy) -> correlation of the right strip of ``left`` with the left strip of ``right``.

    A positive dy starts ``left`` lower. None where nothing (or not more than ``min_height`` rows) overlaps or a region is
    flat. Sums and squares come from tables made once, so a candidate costs one multiply-add per pixel.
    """
    a, b = left.astype(np.float64), right.astype(np.float64)
    ta, tb = _table(left), _table(right)
    taa, tbb = _table(left.astype(np.int64) ** 2), _table(right.astype(np.int64) ** 2)

    def score(overlap: int, dy: int) -> float | None:
        if overlap <= 0 or overlap > min(a.shape[1], b.shape[1]):
            return None
        y1, y2 = max(dy, 0), max(-dy, 0)
        h = min(a.shape[0] - y1, b.shape[0] - y2)
        if h <= min_height:
            return None
        x1 = a.shape[1] - overlap
        # whole numbers below 2**53 stay exact in double precision
        sab = int(np.einsum("ij,ij->", a[y1:y1 + h, x1:], b[y2:y2 + h, :overlap]))
        return correlation(h * overlap, _box(ta, y1, x1, h, overlap), _box(tb, y2, 0, h, overlap),
                           _box(taa, y1, x1, h, overlap), _box(tbb, y2, 0, h, overlap), sab)
    return score


def pair_score(left: np.ndarray, right: np.ndarray, overlap: int, dy: int, min_height: int) -> float | None:
    return pair_scorer(left, right, min_height)(overlap, dy)


def best_of(score, candidates, start: tuple[int, int, float]) -> tuple[int, int, float, int]:
    """First strictly best (overlap, dy, score) of the candidates, never below ``start``; and how many were scored."""
    (overlap, dy, best), tried = start, 0
    for candidate in candidates:
        value = score(*candidate)
        if value is None:
            continue
        tried += 1
        if value > best:
            overlap, dy, best = candidate[0], candidate[1], value
    return overlap, dy, best, tried


def local_components(mask: np.ndarray) -> np.ndarray:
    """8-connected labels of a small mask: 0 outside, else 1 + row-major position of the component's first pixel."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        low = np.minimum.reduce([p[dy:dy + h, dx:dx + w] for dy in range(3) for dx in range(3)])
        nxt = np.where(mask, low, 0)
        # jump along the labels: a label names a pixel, so follow what that pixel is called now
        jumped = np.where(mask, np.minimum(nxt, nxt.ravel()[np.maximum(nxt, 1) - 1]), 0)
        if np.array_equal(jumped, label):
            return label
        label = jumped


def hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit HSV planes (hue 0..179) of whole-number channels."""
    v = np.maximum(np.maximum(r, g), b)
    diff = v - np.minimum(np.minimum(r, g), b)
    sat = np.where(v > 0, np.rint(255.0 * 4096 / np.maximum(v, 1)), 0)
    hue = np.where(diff > 0, np.rint(180.0 * 4096 / (6.0 * np.maximum(diff, 1))), 0)
    sector = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
    h = np.floor((sector * hue + 2048) / 4096)
    return np.where(h < 0, h + 180, h), np.floor((diff * sat + 2048) / 4096), v


def relative_luminance(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Linear BT.709 luminance of 8-bit sRGB planes."""
    u = np.arange(256) / 255.0
    linear = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    return 0.2126 * linear[r] + 0.7152 * linear[g] + 0.0722 * linear[b]


def lightness(y: np.ndarray) -> np.ndarray:
    return 116.0 * np.where(y > (6.0 / 29.0) ** 3, np.cbrt(y), y / (3.0 * (6.0 / 29.0) ** 2) + 4.0 / 29.0) - 16.0
