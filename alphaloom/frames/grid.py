"""Neighbourhood primitives on one frame of any size: numpy arrays of height x width.

A structuring element is given row by row as half widths, so a dilation costs a running
maximum per distinct width and row of the element, not one look-up per cell of it. Outside the
frame there is nothing (maxima and minima skip it); filters that need a value there say which.
"""

from __future__ import annotations

import numpy as np


def ellipse(size: int) -> list[tuple[int, int]]:
    """An elliptic element of an odd size as (row offset, half width): the circle's width at that row, rounded to even."""
    r = size // 2
    return [(dy, int(np.rint(np.sqrt(r * r - dy * dy)))) for dy in range(-r, r + 1)]


def square(size: int) -> list[tuple[int, int]]:
    return [(dy, size // 2) for dy in range(-(size // 2), size // 2 + 1)]


def _row_max(a: np.ndarray, w: int) -> np.ndarray:
    """The greatest of the 2 w + 1 cells around each, along rows, by doubling."""
    low = -np.inf if a.dtype.kind == "f" else False if a.dtype == bool else np.iinfo(a.dtype).min
    padded = np.pad(a, ((0, 0), (w, w)), constant_values=low)
    span, have = 2 * w + 1, 1
    while have * 2 <= span:
        padded = np.maximum(padded[:, :-have], padded[:, have:])
        have *= 2
    rest = span - have
    return np.maximum(padded[:, : padded.shape[1] - rest], padded[:, rest:]) if rest else padded


def dilate(a: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    out = a.copy()
    rows: dict[int, np.ndarray] = {}
    h = a.shape[0]
    for dy, w in element:
        if abs(dy) >= h:
            continue
        if w not in rows:
            rows[w] = _row_max(a, min(w, a.shape[1])) if w else a
        x = rows[w]
        if dy >= 0:
            np.maximum(out[: h - dy], x[dy:], out=out[: h - dy])
        else:
            np.maximum(out[-dy:], x[: h + dy], out=out[-dy:])
    return out


def erode(a: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return ~dilate(~a, element) if a.dtype == bool else -dilate(-a, element)


def opened(a: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return dilate(erode(a, element), element)


def closed(a: np.ndarray, element: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    for _ in range(times):
        a = dilate(a, element)
    for _ in range(times):
        a = erode(a, element)
    return a


#: Gaussian kernels of the sizes that have one.
KERNELS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    if sigma <= 0 and size in KERNELS:
        return np.array(KERNELS[size])
    s = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-x * x / (2 * s * s))
    return k / k.sum()


def _reflected(n: int, r: int) -> np.ndarray:
    """Indices -r .. n - 1 + r mirrored at the outermost cells, which aren't repeated."""
    i = np.arange(-r, n + r)
    if n == 1:
        return np.zeros(len(i), int)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable filter with mirrored borders."""
    r = len(kernel) // 2
    h, w = a.shape
    x = a.astype(float)[:, _reflected(w, r)]
    x = sum(k * x[:, i : i + w] for i, k in enumerate(kernel))
    x = x[_reflected(h, r)]
    return sum(k * x[i : i + h] for i, k in enumerate(kernel))


def blurred(a: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    return convolved(a, gaussian_kernel(size, sigma))


def boxed(a: np.ndarray, size: int) -> np.ndarray:
    """The mean of a square, borders mirrored."""
    return convolved(a, np.full(size, 1 / size))


def box_sum(a: np.ndarray, size: int) -> np.ndarray:
    """The sum over a square; outside the frame is 0."""
    r = size // 2
    c = np.pad(np.pad(a.astype(float), r).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def median(a: np.ndarray, size: int, band: int = 1 << 22) -> np.ndarray:
    """The median of a square, outermost cells repeated outwards; rows are done in bands that bound the memory."""
    h, w = a.shape
    padded = np.pad(a, size // 2, mode="edge")
    out = np.empty_like(a)
    step = max(1, band // (w * size * size))
    for y in range(0, h, step):
        n = min(step, h - y)
        view = np.lib.stride_tricks.sliding_window_view(padded[y : y + n + size - 1], (size, size)).reshape(n, w, size * size)
        out[y : y + n] = np.partition(view, size * size // 2, axis=2)[:, :, size * size // 2]
    return out


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels, areas): connected components numbered from 1 in the order of their first cell; 0 is outside. Works on runs of a row."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    edge = np.diff(flat, axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int64), np.array([h * w])
    reach = 1 if diagonal else 0
    # Runs of the row above that touch each run lie side by side: from the first that ends behind its start to the last that starts before its end.
    place = row.astype(np.int64) * (w + 3)
    above = place - (w + 3)
    lo = np.searchsorted(place + stop, above + start - reach, side="right")
    hi = np.searchsorted(place + start, above + stop + reach, side="left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    _, number = np.unique(root, return_inverse=True)
    size = stop - start
    labels = np.zeros(h * w, np.int64)
    at = np.repeat(row * w + start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    labels[at] = np.repeat(number + 1, size)
    return labels.reshape(h, w), np.r_[h * w - size.sum(), np.bincount(number, weights=size).astype(np.int64)]


def kept(mask: np.ndarray, least: int = 0, most: int | None = None) -> np.ndarray:
    """Cells of components whose area lies between two bounds."""
    labels, areas = components(mask)
    ok = (areas >= least) & (areas <= most if most is not None else True)
    ok[0] = False
    return ok[labels]


def filled(mask: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Components with what they enclose, of those whose outline (through the centres of its cells) has at least an area."""
    outside, _ = components(~np.pad(mask, 1), diagonal=False)
    solid = (outside != outside[0, 0])[1:-1, 1:-1]
    labels, areas = components(solid)
    p = np.pad(labels, ((0, 1), (0, 1)))
    four = np.stack([p[:-1, :-1], p[1:, :-1], p[:-1, 1:], p[1:, 1:]])
    top = four.max(0)
    inside = (four == top).sum(0) * (top > 0)
    # A unit square between four cells counts whole if all are inside, half if three are.
    area = np.bincount(top.ravel(), weights=np.where(inside == 4, 1.0, np.where(inside == 3, 0.5, 0.0)).ravel(), minlength=len(areas))
    ok = area >= least
    ok[0] = False
    return ok[labels]


def fill_holes(mask: np.ndarray, allowed: np.ndarray, least: float = 12.0) -> np.ndarray:
    return filled(mask, least) & allowed | mask


def distance(mask: np.ndarray, limit: int) -> np.ndarray:
    """Exact distance to the nearest cell of a mask, up to a limit (infinite beyond)."""
    h, w = mask.shape
    x = np.arange(w)
    far = 4.0 * (h + w)
    left = np.maximum.accumulate(np.where(mask, x, -far), axis=1)
    right = np.minimum.accumulate(np.where(mask, x, far)[:, ::-1], axis=1)[:, ::-1]
    along = np.minimum(x - left, right - x).astype(float)
    best = along * along
    for dy in range(1, min(limit, h - 1) + 1):
        side = along * along + dy * dy
        np.minimum(best[dy:], side[:-dy], out=best[dy:])
        np.minimum(best[:-dy], side[dy:], out=best[:-dy])
    out = np.sqrt(best)
    out[out > limit] = np.inf
    return out


def shifted(a: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """A frame moved by (dx, dy), linearly between cells; what comes from outside is 0."""
    h, w = a.shape
    x0, y0 = int(np.floor(dx)), int(np.floor(dy))
    fx, fy = dx - x0, dy - y0
    out = np.zeros((h, w))
    for oy, wy in ((y0, 1 - fy), (y0 + 1, fy)):
        for ox, wx in ((x0, 1 - fx), (x0 + 1, fx)):
            if wy * wx and abs(oy) < h and abs(ox) < w:
                out[max(0, oy) : h + min(0, oy), max(0, ox) : w + min(0, ox)] += wy * wx * a[max(0, -oy) : h - max(0, oy), max(0, -ox) : w - max(0, ox)]
    return out


def translation(before: np.ndarray, after: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by which one frame is moved against another: the peak of their phase correlation, as the centroid of the 5 x 5 cells around it."""
    f = np.fft.fft2(before) * np.conj(np.fft.fft2(after))
    peak = np.fft.fftshift(np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12))))
    h, w = peak.shape
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    ys, xs = np.arange(max(0, y - 2), min(h, y + 3)), np.arange(max(0, x - 2), min(w, x + 3))
    near = peak[np.ix_(ys, xs)]
    total = near.sum()
    cy, cx = ((near.sum(1) @ ys) / total, (near.sum(0) @ xs) / total) if abs(total) > 1e-12 else (y, x)
    return float(w // 2 - cx), float(h // 2 - cy)
