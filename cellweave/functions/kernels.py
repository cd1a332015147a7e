"""NumPy neighbourhood kernels, for tasks that Spark has dealt by image or tile.

Rows and columns are the last two axes, so most kernels take a stack of grids of one size as well as one; where a kernel
takes lists of places, it says so.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np


def shifted(a: np.ndarray, dy: int, dx: int, fill: float = 0) -> np.ndarray:
    """out[y, x] = a[y + dy, x + dx], fill outside."""
    out = np.full_like(a, fill)
    h, w = a.shape[-2:]
    ys, xs = slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0))
    yd, xd = slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0))
    if yd.start < yd.stop and xd.start < xd.stop:
        out[..., yd, xd] = a[..., ys, xs]
    return out


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return np.max([shifted(mask, a, b) for a, b in disk_offsets(radius)], axis=0)


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside the grid counts as set, so borders don't erode by themselves."""
    return np.min([shifted(mask, a, b, 1) for a, b in disk_offsets(radius)], axis=0)


def gaussian_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, borders repeated, cut at four sigmas."""
    r = max(int(4 * sigma + 0.5), 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in (-2, -1):
        padded = np.pad(out, [(r, r) if axis == i else (0, 0) for i in range(-a.ndim, 0)], mode="edge")
        out = sum(w * np.take(padded, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def median(a: np.ndarray, radius: int) -> np.ndarray:
    stack = np.array([shifted(a.astype(float), p, q, np.nan) for p, q in disk_offsets(radius)])
    stack.sort(axis=0)  # what lies outside sorts last
    n = (~np.isnan(stack)).sum(axis=0)[None]
    return np.mean([np.take_along_axis(stack, k, 0)[0] for k in ((n - 1) // 2, n // 2)], axis=0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that no path joins to the border becomes foreground."""
    free = np.pad(~mask.astype(bool), 1, constant_values=True)
    seen = np.zeros_like(free)
    seen[0, 0] = True
    while True:
        grown = seen | (free & (shifted(seen, 1, 0) | shifted(seen, -1, 0) | shifted(seen, 0, 1) | shifted(seen, 0, -1)))
        if (grown == seen).all():
            return (mask.astype(bool) | ~seen[1:-1, 1:-1])
        seen = grown


def column_distance(mask: np.ndarray, far: float) -> np.ndarray:
    """Rows to the nearest background of the same column; far where a column has none."""
    rows = np.arange(mask.shape[-2], dtype=float)[:, None]
    back = ~mask.astype(bool)
    above = rows - np.maximum.accumulate(np.where(back, rows, -np.inf), axis=-2)
    below = np.minimum.accumulate(np.where(back, rows, np.inf)[..., ::-1, :], axis=-2)[..., ::-1, :] - rows
    return np.minimum(np.minimum(above, below), far)


def row_envelope(columns: np.ndarray) -> np.ndarray:
    """Euclidean distances from column distances: for each offset along the row what lies there, up to the farthest that still matters."""
    squares = columns**2
    out = squares.copy()
    for gap in range(1, columns.shape[-1]):
        if gap * gap >= out.max(initial=0):
            break
        np.minimum(out[..., gap:], squares[..., :-gap] + gap * gap, out=out[..., gap:])
        np.minimum(out[..., :-gap], squares[..., gap:] + gap * gap, out=out[..., :-gap])
    return np.sqrt(out)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest background pixel, by columns and then by rows; memory is a few times the mask's."""
    return row_envelope(column_distance(mask, float(sum(mask.shape[-2:]))))


def peaks(a: np.ndarray, min_distance: int) -> np.ndarray:
    """Pixels above 0 that no pixel within a disk exceeds."""
    top = np.max([shifted(a, p, q, -np.inf) for p, q in disk_offsets(max(min_distance, 1))], axis=0)
    return (a == top) & (a > 0)


def choose_peaks(rows: list[tuple[float, int, int, int]], min_distance: int) -> list[int]:
    """States of peaks (value, y, x, state): 1 kept, -1 dropped, 0 to decide here, 2 to decide elsewhere; all but 0 stay.

    From the strongest on, of ties the first in reading order, a peak is kept if no kept one is within min_distance. One
    near a stronger peak that isn't decided stays undecided.
    """
    cell = max(min_distance, 1)
    near: dict[tuple[int, int], list[int]] = {}
    states = [r[3] for r in rows]
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][0], rows[k][1], rows[k][2])):
        _, y, x, state = rows[k]
        if not state:
            found = [states[j] for p in (-1, 0, 1) for q in (-1, 0, 1) for j in near.get((y // cell + p, x // cell + q), ()) if (rows[j][1] - y) ** 2 + (rows[j][2] - x) ** 2 <= min_distance**2]
            states[k] = -1 if 1 in found else 0 if 0 in found or 2 in found else 1
        near.setdefault((y // cell, x // cell), []).append(k)
    return states


def local_maxima(a: np.ndarray, min_distance: int) -> list[tuple[int, int]]:
    """Peaks that are the largest within a disk, strongest first; of ties the first in reading order, min_distance apart."""
    y, x = np.nonzero(peaks(a, min_distance))
    rows = [(float(v), int(p), int(q), 0) for v, p, q in zip(a[y, x], y, x, strict=True)]
    kept = [r for r, s in zip(rows, choose_peaks(rows, min_distance), strict=True) if s == 1]
    return [(y, x) for _, y, x in sorted((-v, y, x) for v, y, x, _ in kept)]


#: Steps to neighbours, in reading order.
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def _relaxed(out: np.ndarray, reached: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The least values that ways from neighbour to neighbour lead to, for a stack of small grids at once; the same as by a queue."""
    while True:
        new = np.minimum(out, reached(np.minimum.reduce([shifted(out, dy, dx, np.inf) for dy, dx in FOUR])))
        if (new == out).all():
            return out
        out = new


def travel_time(speed: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least time from pixels that have a cost already, over the 4-neighbourhood, 1 / speed a step (a graph distance, not the eikonal equation's)."""
    out = cost.astype(float)
    if out.ndim > 2:
        with np.errstate(divide="ignore"):
            step = np.where(speed > 0, 1 / speed, np.inf)
        return _relaxed(out, lambda near: near + step)
    queue = [(float(out[y, x]), int(y), int(x)) for y, x in zip(*np.nonzero(np.isfinite(out)), strict=True)]
    heapq.heapify(queue)
    while queue:
        t, y, x = heapq.heappop(queue)
        if t > out[y, x]:
            continue
        for dy, dx in FOUR:
            p, q = y + dy, x + dx
            if 0 <= p < speed.shape[0] and 0 <= q < speed.shape[1] and speed[p, q] > 0:
                new = t + 1 / float(speed[p, q])
                if new < out[p, q]:
                    out[p, q] = new
                    heapq.heappush(queue, (new, p, q))
    return out


def flood_levels(height: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Least height that has to be climbed to from a pixel that has a level already; pixels of infinite height are walls."""
    out = level.copy()
    if out.ndim > 2:
        return _relaxed(out, lambda near: np.where(height < np.inf, np.maximum(near, height), np.inf))
    queue = [(float(out[y, x]), int(y), int(x)) for y, x in zip(*np.nonzero(np.isfinite(out)), strict=True)]
    heapq.heapify(queue)
    while queue:
        at, y, x = heapq.heappop(queue)
        if at > out[y, x]:
            continue
        for dy, dx in FOUR:
            p, q = y + dy, x + dx
            if 0 <= p < height.shape[0] and 0 <= q < height.shape[1] and height[p, q] < np.inf:
                new = max(at, float(height[p, q]))
                if new < out[p, q]:
                    out[p, q] = new
                    heapq.heappush(queue, (new, p, q))
    return out


def plateau_steps(level: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Steps over pixels of the same level from a lower neighbour (0) or from a pixel that has steps already."""
    entry = np.isfinite(level) & np.any([shifted(level, dy, dx, np.inf) < level for dy, dx in FOUR], axis=0)
    out = np.where(entry, 0, steps)
    while True:
        new = out
        for dy, dx in FOUR:
            new = np.where(shifted(level, dy, dx, np.nan) == level, np.minimum(new, shifted(out, dy, dx, np.inf) + 1), new)
        if (new == out).all():
            return out
        out = new


def flood_parents(level: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Where each pixel is flooded from, as a place in FOUR: the lowest lower neighbour, else one that is a step nearer; -1 for none. Of ties the first."""
    best, out = level.copy(), np.full(level.shape, -1)
    for k, (dy, dx) in enumerate(FOUR):
        near = shifted(level, dy, dx, np.inf)
        out, best = np.where((near < best) & np.isfinite(level), k, out), np.minimum(near, best)
    for k, (dy, dx) in enumerate(FOUR):
        back = (out < 0) & np.isfinite(level) & (shifted(level, dy, dx, np.nan) == level) & (shifted(steps, dy, dx, np.inf) == steps - 1)
        out = np.where(back, k, out)
    return out


def follow(parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each pixel's label: its own, if it has one, else that of the pixel at the end of its parents within the grid."""
    own = np.arange(labels.size).reshape(labels.shape)
    at = own
    for k, (dy, dx) in enumerate(FOUR):
        at = np.where((parents == k) & (labels == 0), own + dy * labels.shape[-1] + dx, at)
    at = at.ravel()
    while True:
        further = at[at]
        if (further == at).all():
            return labels.ravel()[at].reshape(labels.shape)
        at = further


def watershed(height: np.ndarray, seeds: list[tuple[int, int]], mask: np.ndarray) -> np.ndarray:
    """Flood from the seeds inside the mask; labels 1..n in the order of seeds.

    A pixel's level is the least height to climb on a way from any seed. It belongs to the seed of its lowest neighbour,
    or, where none is lower, of the nearest one on its plateau; so labels don't depend on the order of work.
    """
    ranks = np.zeros(mask.shape, np.int64)
    for k, (y, x) in enumerate(seeds, 1):
        ranks[y, x] = k
    return watershed_from(height, ranks, mask)


def watershed_from(height: np.ndarray, ranks: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """watershed() from seeds given as a grid of labels, or a stack of them."""
    at = ranks > 0
    wet = np.where(mask | at, height, np.inf)
    level = flood_levels(wet, np.where(at, height, np.inf))
    steps = plateau_steps(level, np.where(at, 0, np.inf))
    return follow(flood_parents(level, steps), ranks)


def ranked_maxima(a: np.ndarray, min_distance: int) -> np.ndarray:
    """local_maxima() as a grid of ranks from 1 on, or a stack of them."""
    if a.ndim == 2:
        out = np.zeros(a.shape, np.int64)
        for k, place in enumerate(local_maxima(a, min_distance), 1):
            out[place] = k
        return out
    peak = peaks(a, min_distance)
    open_, kept = peak.copy(), np.zeros(a.shape, bool)
    around = [(p, q) for p, q in disk_offsets(min_distance) if (p, q) != (0, 0)]
    while open_.any():  # each that no stronger open or kept one is near to is kept, of equal ones the first in reading order
        free = open_.copy()
        for p, q in around:
            near, other = shifted(a, p, q, -np.inf), shifted(open_, p, q, False)
            free &= ~(other & ((near > a) | ((near == a) & ((p, q) < (0, 0)))))
        kept |= free
        open_ &= ~free
        for p, q in around:
            open_ &= ~shifted(kept, p, q, False)
    return ranks_of(kept, -a)


def ranks_of(kept: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 1 on of the kept pixels of each grid, by order, of ties in reading order."""
    flat, by = (g.reshape(-1, *kept.shape[-2:]) for g in (kept, order))
    n, y, x = np.nonzero(flat)
    at = np.lexsort((x, y, by[n, y, x], n))
    n, y, x = n[at], y[at], x[at]
    out = np.zeros(flat.shape, np.int64)
    out[n, y, x] = np.arange(len(n)) - np.searchsorted(n, n) + 1
    return out.reshape(kept.shape)


def label_mask(mask: np.ndarray, dilation: int = 0, min_distance: int = 2) -> np.ndarray:
    """Cells of a foreground mask: distance peaks as centres, then watershed from them."""
    mask = mask.astype(bool)
    depth = distance_transform(mask)
    grown = dilate(mask.astype(np.int8), dilation).astype(bool) if dilation else mask
    return watershed_from(-depth, ranked_maxima(depth, min_distance), grown)


def local_threshold(a: np.ndarray, radius: int, offset: float) -> np.ndarray:
    """Above the local median less an offset."""
    return a > median(a, radius) - offset


def expand_labels(labels: np.ndarray, radius: int) -> np.ndarray:
    """Each label grown by up to radius steps, nearest first."""
    inside = dilate((labels > 0).astype(np.int8), radius).astype(bool)
    out = labels.copy()
    for _ in range(radius):
        near = np.zeros_like(out)
        for p, q in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            other = shifted(out, p, q)
            near = np.where((near == 0) | ((other > 0) & (other < near)), np.where(other > 0, other, near), near)
        out = np.where((out == 0) & inside, near, out)
    return out


def phase_shift(source: np.ndarray, target: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """(dy, dx) to move target by so that it lies on source: the peak of the cross-power spectrum, refined by a local Fourier sum."""
    product = np.fft.fft2(source) * np.conj(np.fft.fft2(target))
    product /= np.maximum(np.abs(product), 1e-12)
    corr = np.abs(np.fft.ifft2(product))
    peak = np.array(np.unravel_index(corr.argmax(), corr.shape), float)
    size = np.array(source.shape)
    peak = np.where(peak > size // 2, peak - size, peak)
    if upsample <= 1:
        return float(peak[0]), float(peak[1])
    fine = np.arange(-upsample, upsample + 1) / upsample
    ky, kx = np.fft.fftfreq(size[0]), np.fft.fftfreq(size[1])
    by = np.exp(2j * np.pi * np.outer(peak[0] + fine, ky))
    bx = np.exp(2j * np.pi * np.outer(kx, peak[1] + fine))
    local = np.abs(by @ product @ bx)
    at = np.unravel_index(local.argmax(), local.shape)
    return float(peak[0] + fine[at[0]]), float(peak[1] + fine[at[1]])


def apply_shift(a: np.ndarray, shift: tuple[float, float]) -> np.ndarray:
    """Periodic shift in the Fourier domain."""
    ky, kx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (ky * shift[0] + kx * shift[1]))).real


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, nearest neighbour, zeros outside."""
    t = np.deg2rad(degrees)
    c = (np.array(a.shape) - 1) / 2
    y, x = np.indices(a.shape)
    sy = np.rint(c[0] + np.cos(t) * (y - c[0]) - np.sin(t) * (x - c[1])).astype(int)
    sx = np.rint(c[1] + np.sin(t) * (y - c[0]) + np.cos(t) * (x - c[1])).astype(int)
    ok = (sy >= 0) & (sy < a.shape[0]) & (sx >= 0) & (sx < a.shape[1])
    return np.where(ok, a[sy.clip(0, a.shape[0] - 1), sx.clip(0, a.shape[1] - 1)], 0)


def correct_illumination(a: np.ndarray, sigma: float = 2.0, double: bool = False) -> np.ndarray:
    """Unit range, then dark parts lifted by the inverted blurred background; optionally bright parts lowered by it too."""
    span = a.max() - a.min()
    unit = (a - a.min()) / span if span > 0 else a * 0.0
    back = gaussian_blur(unit, sigma)
    out = unit + (back.max() - back) * (unit < back)
    if double:
        out = out - (back - back.min()) * (unit > back)
    return out.clip(0, 1)
