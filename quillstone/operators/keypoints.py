"""Descriptors of image keypoints, in array arithmetic: gradient histograms (SIFT) and rotated binary tests (ORB).

Both follow the published methods. Keypoints sit on whole pixels of their octave (no fit between pixels), and the
binary tests are drawn from a seeded normal distribution, so values differ from other implementations, while
images are compared in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .resample import resized

#: Keypoints kept for an image, the strongest first.
MOST = 500


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges repeated."""
    r = max(1, int(4 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        x = sum(v * (wide[k : k + n] if axis == 0 else wide[:, k : k + n]) for k, v in enumerate(w))
    return x


def around(x: np.ndarray) -> Iterator[np.ndarray]:
    """The inner part of a stack as each of the 27 neighbours sees it."""
    n = [s - 2 for s in x.shape]
    for a in range(3):
        for b in range(3):
            for c in range(3):
                yield x[a : a + n[0], b : b + n[1], c : c + n[2]]


def _extrema(dog: np.ndarray, contrast: float, edge: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scale, row, column and strength of points above (or below) all their neighbours that lie on no edge."""
    inner = dog[1:-1, 1:-1, 1:-1]
    if not inner.size:
        return (np.zeros(0, int),) * 3 + (np.zeros(0),)
    high, low = np.maximum.reduce(list(around(dog))), np.minimum.reduce(list(around(dog)))
    found = ((inner == high) | (inner == low)) & (np.abs(inner) > contrast)
    s, y, x = (v + 1 for v in np.nonzero(found))
    at = lambda dy, dx: dog[s, y + dy, x + dx]
    xx, yy = at(0, 1) + at(0, -1) - 2 * at(0, 0), at(1, 0) + at(-1, 0) - 2 * at(0, 0)
    xy = (at(1, 1) + at(-1, -1) - at(1, -1) - at(-1, 1)) / 4
    det = xx * yy - xy * xy
    keep = (det > 0) & ((xx + yy) ** 2 * edge < (edge + 1) ** 2 * det)
    return s[keep], y[keep], x[keep], np.abs(at(0, 0))[keep]


def _patch(length: np.ndarray, angle: np.ndarray, y: int, x: int, r: int) -> tuple[np.ndarray, ...]:
    """Offsets, gradient lengths and angles of the pixels at most r away."""
    a, b = max(0, y - r), max(0, x - r)
    part = np.s_[a : y + r + 1, b : x + r + 1]
    dy, dx = np.mgrid[a : a + length[part].shape[0], b : b + length[part].shape[1]]
    return dy - y, dx - x, length[part], angle[part]


def _directions(length: np.ndarray, angle: np.ndarray, y: int, x: int, sigma: float) -> np.ndarray:
    """The angles of the peaks of the histogram of gradients around a point."""
    dy, dx, m, t = _patch(length, angle, y, x, round(4.5 * sigma))
    weight = m * np.exp(-(dy**2 + dx**2) / (2 * (1.5 * sigma) ** 2))
    hist = np.bincount((t / (2 * np.pi) * 36).astype(int).ravel() % 36, weight.ravel(), 36)
    for _ in range(2):
        hist = (np.roll(hist, 1) + hist + np.roll(hist, -1)) / 3
    before, after = np.roll(hist, 1), np.roll(hist, -1)
    peak = np.flatnonzero((hist > before) & (hist > after) & (hist >= 0.8 * hist.max()))
    bend = before[peak] - 2 * hist[peak] + after[peak]
    return (peak + 0.5 + 0.5 * (before[peak] - after[peak]) / np.where(bend == 0, 1, bend)) * 2 * np.pi / 36


def _histograms(length: np.ndarray, angle: np.ndarray, y: int, x: int, sigma: float, turn: float) -> np.ndarray:
    """128 numbers: 4 x 4 cells of 8 directions, turned to the point's own direction, clipped at a fifth, of length 512."""
    width = 3 * sigma
    dy, dx, m, t = _patch(length, angle, y, x, round(width * 2.5 * np.sqrt(2)))
    c, s = np.cos(turn), np.sin(turn)
    row, col = (c * dy - s * dx) / width + 1.5, (c * dx + s * dy) / width + 1.5
    bin_ = ((t - turn) / (2 * np.pi) * 8) % 8
    inside = (row > -1) & (row < 4) & (col > -1) & (col < 4)
    row, col, bin_ = row[inside], col[inside], bin_[inside]
    weight = (m * np.exp(-(dy**2 + dx**2) / (2 * (2 * width) ** 2)))[inside]
    out = np.zeros((6, 6, 8))
    r0, c0, b0 = np.floor(row).astype(int), np.floor(col).astype(int), np.floor(bin_).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                share = np.abs(1 - i - (row - r0)) * np.abs(1 - j - (col - c0)) * np.abs(1 - k - (bin_ - b0))
                np.add.at(out, (r0 + i + 1, c0 + j + 1, (b0 + k) % 8), weight * share)
    v = out[1:5, 1:5].ravel()
    v = np.minimum(v, 0.2 * np.linalg.norm(v))
    return np.round(512 * v / max(np.linalg.norm(v), 1e-12)).clip(0, 255)


def sift(image: np.ndarray, scales: int = 3, sigma: float = 1.6, contrast: float = 0.04) -> np.ndarray:
    """(keypoints, 128); images over 1024 pixels are made smaller first."""
    top = max(image.shape)
    if top > 1024:
        image = resized(image, *(int(n * 1024 / top) for n in image.shape))
    base = blurred(image / 255, np.sqrt(sigma**2 - 0.5**2))
    found: list[tuple] = []
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
    while min(base.shape) >= 16:
        stack = [base]
        for k in range(1, scales + 3):
            stack.append(blurred(stack[-1], sigma * 2 ** ((k - 1) / scales) * np.sqrt(2 ** (2 / scales) - 1)))
        s, y, x, strength = _extrema(np.diff(np.array(stack), axis=0), 0.5 * contrast / scales)
        found += [(-v, len(levels), int(a), int(b), int(c)) for v, a, b, c in zip(strength, s, y, x, strict=True)]
        slopes = [np.gradient(g) for g in stack]
        levels.append([(np.hypot(gx, gy), np.arctan2(gy, gx) % (2 * np.pi)) for gy, gx in slopes])
        base = stack[scales][::2, ::2]
    out = []
    for _, octave, s, y, x in sorted(found):
        length, angle = levels[octave][s]
        own = sigma * 2 ** (s / scales)
        out += [_histograms(length, angle, y, x, own, t) for t in _directions(length, angle, y, x, own)]
        if len(out) >= MOST:
            break
    return np.array(out[:MOST]).reshape(-1, 128)


#: The circle of sixteen pixels that a corner is told by.
_CIRCLE = [(round(3 * np.sin(2 * np.pi * k / 16)), round(3 * np.cos(2 * np.pi * k / 16))) for k in range(16)]


@lru_cache(2)
def _tests(count: int = 256, size: int = 31) -> np.ndarray:
    """Pairs of points (count, 2, 2) of a patch."""
    return np.clip(np.random.default_rng(256).normal(0, size / 5, (count, 2, 2)), -13, 13)


def _corners(x: np.ndarray, margin: int = 19, step: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and Harris strength of pixels with nine neighbours in a row on the circle all lighter or all darker."""
    h, w = x.shape
    if min(h, w) <= 2 * margin:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    m = margin
    gap = np.array([x[m + dy : h - m + dy, m + dx : w - m + dx] for dy, dx in _CIRCLE]) - x[m : h - m, m : w - m]
    corner = np.zeros(gap.shape[1:], bool)
    for side in (gap > step, gap < -step):
        twice = np.concatenate([side, side[:8]])
        for k in range(16):
            corner |= twice[k : k + 9].all(axis=0)
    gy, gx = np.gradient(x)
    xx, yy, xy = (blurred(v, 2.0)[m : h - m, m : w - m] for v in (gx * gx, gy * gy, gx * gy))
    strength = np.where(corner, xx * yy - xy * xy - 0.04 * (xx + yy) ** 2, -np.inf)
    wide = np.pad(strength, 1, constant_values=-np.inf)
    best = np.maximum.reduce([wide[a : a + strength.shape[0], b : b + strength.shape[1]] for a in range(3) for b in range(3)])
    y, x_ = np.nonzero(corner & (strength == best))
    return y + m, x_ + m, strength[y, x_]


def orb(image: np.ndarray, levels: int = 8, scale: float = 1.2) -> np.ndarray:
    """(keypoints, 32): 256 binary tests of the blurred patch, turned to its centroid, eight to a byte."""
    found: list[tuple] = []
    planes = []
    for level in range(levels):
        shape = [round(n / scale**level) for n in image.shape]
        if min(shape) <= 38:
            break
        plane = resized(image, *shape) if level else image
        y, x, strength = _corners(plane)
        planes.append((plane, blurred(plane, 2.0)))
        found += [(-v, level, int(a), int(b)) for v, a, b in zip(strength, y, x, strict=True)]
    dy, dx = np.mgrid[-15:16, -15:16]
    disc = dy**2 + dx**2 <= 225
    out = []
    for _, level, y, x in sorted(found)[:MOST]:
        plane, smooth = planes[level]
        patch = plane[y - 15 : y + 16, x - 15 : x + 16] * disc
        turn = np.arctan2((patch * dy).sum(), (patch * dx).sum())
        c, s = np.cos(turn), np.sin(turn)
        px, py = _tests()[:, :, 0], _tests()[:, :, 1]
        rows, cols = np.rint(s * px + c * py).astype(int) + y, np.rint(c * px - s * py).astype(int) + x
        rows, cols = rows.clip(0, plane.shape[0] - 1), cols.clip(0, plane.shape[1] - 1)
        v = smooth[rows, cols]
        out.append(np.packbits(v[:, 0] < v[:, 1]))
    return np.array(out, float).reshape(-1, 32)
