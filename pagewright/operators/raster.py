"""Image kernels in numpy, applied to Arrow batches. Images are rows (width, height, channels, data) of eight bits.

The formulas and thresholds are what counts; results aren't bit-exact with any imaging library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import APART, AREA_SHARE, ASPECT, LEAST_AREA, PARALLEL_DEGREES, SIDE_SHARE
from .stats import DEADBAND, LEAST_LINES, LEAST_STRIPS, SPREAD

#: Part of its hull that a sheet's region fills.
FILLED = 0.85


@dataclass(frozen=True)
class Preset:
    """Strengths of the enhancement steps."""

    sharpness: float = 0.0
    contrast: float = 0.0
    whitening: float = 0.0
    denoise: float = 0.0
    upscale: float = 1.0
    color_mode: str = "color"  # color, grayscale or clean_bw
    deskew: bool = True
    flatten: bool = False
    rotation: int = 0


# Distance from gray at which a pixel counts as coloured.
COLOURED = 18.0
# Presets by name.
PRESETS = {
    "ultra_sharp": Preset(0.9, 0.35, 0.5, 0.15, 2.0, "color"),
    "clean_scan": Preset(0.7, 0.4, 0.75, 0.2, 2.0, "grayscale"),
    "crisp_bw": Preset(0.6, 0.4, 0.85, 0.15, 2.0, "clean_bw"),
    "super_res": Preset(0.6, 0.25, 0.3, 0.15, 3.0, "color"),
    "natural": Preset(0.2, 0.1, 0.1, 0.05, 1.0, "color"),
}


def rotate(img: np.ndarray, angle: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees; other angles change nothing."""
    return {90: lambda x: np.rot90(x, 3), 180: lambda x: np.rot90(x, 2), 270: lambda x: np.rot90(x, 1)}.get(angle % 360, lambda x: x)(img)


def gray(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else (img @ np.array([0.114, 0.587, 0.299])).round().astype(np.uint8)


def box_blur(img: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of odd size, edges repeated."""
    r = size // 2
    p = np.pad(img.astype(np.float64), ((r, r), (r, r)), mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        p = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(p, range(n, n + img.shape[axis]), axis) for n, w in enumerate(k))
    return out


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def chroma(img: np.ndarray) -> np.ndarray:
    """Distance of each pixel (blue, green, red) from gray, as the length of (a, b) in CIE Lab."""
    c = img.astype(np.float64)[..., ::-1] / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]).T / np.array([0.9505, 1.0, 1.089])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.hypot(500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2]))


def whiten(img: np.ndarray, strength: float) -> np.ndarray:
    """Even out shadows: brightness over its local mean, mixed by strength; dark tones get a little darker.

    In colour images, what is nearly gray loses its tint by strength; what has colour (stamps, ink) keeps it.
    """
    if strength <= 0.01:
        return img
    light = gray(img).astype(np.float64)
    size = max(31, min(img.shape[:2]) // 20) | 1
    flat = np.minimum(255, light / np.maximum(box_blur(light, min(size, 2 * min(img.shape[:2]) - 1 | 1)), 1) * 255)
    new = light * (1 - strength) + flat * strength
    cut = 255 - 45 * strength
    new = np.where(new >= cut, 255, cut * (new / cut) ** 1.15)
    if img.ndim == 2:
        return _bytes(new)
    kept = 1 - strength * (1 - np.clip(chroma(img) / COLOURED, 0, 1))[..., None]
    tinted = img * (new / np.maximum(light, 1))[..., None]
    return _bytes(kept * tinted + (1 - kept) * new[..., None])


def contrast(img: np.ndarray, strength: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the brightness over tiles, joined by linear interpolation."""
    if strength <= 0.01:
        return img
    light = gray(img)
    h, w = light.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for a in range(tiles):
        for b in range(tiles):
            t = light[ys[a] : max(ys[a + 1], ys[a] + 1), xs[b] : max(xs[b + 1], xs[b] + 1)]
            hist = np.bincount(t.ravel(), minlength=256).astype(np.float64)
            most = max(1.0, (1 + 3 * strength) * t.size / 256)
            over = np.maximum(hist - most, 0).sum()
            maps[a, b] = np.cumsum(np.minimum(hist, most) + over / 256) * 255 / t.size
    fy = np.clip((np.arange(h) + 0.5) / h * tiles - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) / w * tiles - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda y, x: maps[y[:, None], x[None], light]
    new = (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy
    return _bytes(new) if img.ndim == 2 else _bytes(img * (new / np.maximum(light, 1))[..., None])


def sharpen(img: np.ndarray, strength: float) -> np.ndarray:
    """Unsharp mask of sigma 1.2."""
    if strength <= 0.01:
        return img
    return _bytes((1 + 0.75 * strength) * img - 0.75 * strength * gaussian(img, 1.2))


def denoise(img: np.ndarray, strength: float) -> np.ndarray:
    """Bilateral filter: neighbours count by distance and likeness."""
    if strength <= 0.01:
        return img
    r, sigma = int(5 + 4 * strength) // 2, float(int(20 + 35 * strength))
    x = img.astype(np.float64)
    p = np.pad(x, [(r, r), (r, r)] + [(0, 0)] * (img.ndim - 2), mode="edge")
    total, weight = np.zeros_like(x), np.zeros(img.shape[:2])
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            if (d2 := (dy - r) ** 2 + (dx - r) ** 2) > r * r:
                continue
            n = p[dy : dy + img.shape[0], dx : dx + img.shape[1]]
            diff = np.abs(n - x) if img.ndim == 2 else np.abs(n - x).sum(2)
            k = np.exp(-d2 / (2 * sigma**2) - diff**2 / (2 * sigma**2))
            total += n * (k if img.ndim == 2 else k[..., None])
            weight += k
    return _bytes(total / (weight if img.ndim == 2 else weight[..., None]))


def _kernel(x: np.ndarray, a: int = 4) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Windowed-sinc resampling, edges repeated."""
    out = img.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        center = (np.arange(size) + 0.5) * n / size - 0.5
        taps = np.floor(center).astype(int)[:, None] + np.arange(-3, 5)[None]
        k = _kernel(center[:, None] - taps)
        k /= k.sum(1, keepdims=True)
        moved = np.moveaxis(out, axis, 0)[np.clip(taps, 0, n - 1)]
        out = np.moveaxis(np.einsum("st,st...->s...", k, moved), 0, axis)
    return _bytes(out)


def upscale(img: np.ndarray, factor: float) -> np.ndarray:
    if abs(factor - 1) < 0.05:
        return img
    return resize(img, int(img.shape[1] * factor), int(img.shape[0] * factor))


def clean_bw(img: np.ndarray) -> np.ndarray:
    """Near black and white: brightness over its local mean, stretched and with darker middle tones."""
    light = gray(img).astype(np.float64)
    size = min(max(31, min(light.shape) // 20) | 1, 2 * min(light.shape) - 1 | 1)
    n = np.minimum(255, light / np.maximum(box_blur(light, size), 1) * 255)
    return _bytes(255 * (np.clip((n - 60) * 255 / 165, 0, 255) / 255) ** 1.3)


def edges(light: np.ndarray, least: float = 50.0) -> np.ndarray:
    """Where brightness changes by at least so much over two pixels, along the stronger direction only (so that edges are thin)."""
    x = gaussian(light, 0.8)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[1:-1], gx[:, 1:-1] = x[2:] - x[:-2], x[:, 2:] - x[:, :-2]
    size = np.hypot(gx, gy)
    flat = np.pad(size, 1)
    up, side = np.abs(gy) >= np.abs(gx), np.abs(gx) > np.abs(gy)
    top = (size >= flat[:-2, 1:-1]) & (size > flat[2:, 1:-1])
    left = (size >= flat[1:-1, :-2]) & (size > flat[1:-1, 2:])
    return (size >= least) & ((up & top) | (side & left))


def lines(mask: np.ndarray, angles: np.ndarray, least: float) -> list[tuple[float, float, float]]:
    """(angle in degrees, distance, votes) of straight lines through at least `least` points of a mask, the strongest of neighbours.

    A line is y cos(angle) - x sin(angle) = distance.
    """
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return []
    reach = int(np.hypot(*mask.shape)) + 1
    votes = np.zeros((len(angles), 2 * reach + 1))
    for k, a in enumerate(np.radians(angles)):
        rho = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int) + reach
        votes[k] = np.bincount(rho, minlength=2 * reach + 1)[: 2 * reach + 1]
    found = []
    for k, r in zip(*np.nonzero(votes >= least), strict=True):
        around = votes[max(0, k - 4) : k + 5, max(0, r - 4) : r + 5]
        if votes[k, r] == around.max():
            votes[k, r] += 1e-6  # of equal neighbours the first
            found.append((float(angles[k]), float(r - reach), float(votes[k, r])))
    return found


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value up to which half of the weight lies, of the values within 1.5 quartile ranges of the quartiles."""
    q1, q3 = np.percentile(values, [25, 75])
    near = (values >= q1 - SPREAD * (q3 - q1)) & (values <= q3 + SPREAD * (q3 - q1))
    values, weights = values[near], weights[near]
    order = np.argsort(values, kind="stable")
    up_to = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(up_to, up_to[-1] / 2)])


def skew_angle(img: np.ndarray, most: float = 30.0) -> float:
    """Angle of the lines of a page within `most` degrees, 0 within the deadband.

    Lines are those of edges, level ones and upright ones turned by 90 degrees: the weighted median of at least six. Where there are fewer, the
    plain median over strips of text of the angle that makes their rows most distinct, of at least four.
    """
    light = gray(img)
    step = max(1, -(-max(light.shape) // 900))
    small = box_blur(light, step)[::step, ::step] if step > 1 else light
    h, w = small.shape
    angles = np.arange(-most, most + 0.25, 0.5)
    mask = edges(small)
    level = lines(mask, angles, max(45, 0.2 * w))
    upright = lines(mask.T[:, ::-1], angles, max(45, 0.2 * h))  # the page turned by 90 degrees
    found = np.array([(a, v) for a, _, v in level + upright])
    if len(found) >= LEAST_LINES:
        angle = weighted_median(found[:, 0], found[:, 1])
        angle = max(np.arange(angle - 0.4, angle + 0.45, 0.1), key=lambda a: _distinct(*np.nonzero(mask), a))
    else:
        dark = small < box_blur(small, min(31, 2 * min(small.shape) - 1)) - 20
        strips = [strip_angle(s) for s in np.array_split(dark, 6)]
        known = [a for a in strips if a is not None]
        if len(known) < LEAST_STRIPS:
            return 0.0
        angle = float(np.median(known))
    return 0.0 if abs(angle) < DEADBAND else float(round(angle, 2))


def _distinct(ys: np.ndarray, xs: np.ndarray, angle: float) -> float:
    """How unevenly points spread over rows of an angle."""
    a = np.radians(angle)
    rows = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int)
    return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())


def strip_angle(dark: np.ndarray, most: float = 25.0) -> float | None:
    """The angle that makes the rows of dark pixels of a strip most distinct; None for a strip without text."""
    ys, xs = np.nonzero(dark)
    if len(ys) < 50:
        return None
    best = max(np.arange(-most, most + 0.5, 0.5), key=lambda a: _distinct(ys, xs, a))
    return float(max(np.arange(best - 0.4, best + 0.45, 0.1), key=lambda a: _distinct(ys, xs, a)))


def border_color(img: np.ndarray) -> np.ndarray:
    """Median of the four corners of five pixels, by channel."""
    c = np.concatenate([img[a, b].reshape(-1, *img.shape[2:]) for a in (slice(0, 5), slice(-5, None)) for b in (slice(0, 5), slice(-5, None))])
    return np.median(c, axis=0)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours of a place between two pixels (cubic convolution, a = -0.75)."""
    a, x = -0.75, np.abs(np.stack([1 + t, t, 1 - t, 2 - t]))
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a)


def warp(img: np.ndarray, matrix: np.ndarray, width: int, height: int, fill: np.ndarray | None = None) -> np.ndarray:
    """Image of a size whose pixel (x, y) is that at matrix @ (x, y, 1) of the input, cubic; outside fill or the edge."""
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    p = matrix @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    sx, sy = p[0] / p[2], p[1] / p[2]
    h, w = img.shape[:2]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic(sx - x0), _cubic(sy - y0)
    out = np.zeros((x.size, *img.shape[2:]))
    for i in range(4):
        row = np.zeros_like(out)
        for j in range(4):
            px = img[np.clip(y0 + i - 1, 0, h - 1), np.clip(x0 + j - 1, 0, w - 1)].astype(np.float64)
            row += px * (wx[j] if img.ndim == 2 else wx[j][:, None])
        out += row * (wy[i] if img.ndim == 2 else wy[i][:, None])
    if fill is not None:
        out[(sx < -0.5) | (sx > w - 0.5) | (sy < -0.5) | (sy > h - 0.5)] = fill
    return _bytes(out).reshape(height, width, *img.shape[2:])


def deskew(img: np.ndarray, angle: float | None = None) -> np.ndarray:
    """Turned straight about its middle; nothing within the deadband."""
    angle = skew_angle(img) if angle is None else angle
    if abs(angle) < DEADBAND:
        return img
    h, w = img.shape[:2]
    c, s, cx, cy = np.cos(np.radians(angle)), np.sin(np.radians(angle)), w / 2, h / 2
    m = np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1.0]])
    return warp(img, m, w, h, border_color(img))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Matrix that takes four points to four points; a ValueError where there is none."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        out = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    except np.linalg.LinAlgError as e:
        raise ValueError("points on a line") from e
    if not np.isfinite(out).all():
        raise ValueError("no finite matrix")
    return out


def flatten(img: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral (top left, top right, bottom right, bottom left) as an upright image; the input if it would be under 100 pixels or blank, or if the corners give no matrix."""
    a, b, c, d = np.asarray(corners, float)
    w = int(max(np.hypot(*(b - a)), np.hypot(*(c - d))))
    h = int(max(np.hypot(*(d - a)), np.hypot(*(c - b))))
    if w < 100 or h < 100:
        return img
    try:
        matrix = homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]]), corners)
    except ValueError:
        return img
    out = warp(img, matrix, w, h)
    return out if gray(out).var() >= 15 else img


def otsu(light: np.ndarray) -> int:
    """Threshold that parts dark from bright best."""
    hist = np.bincount(light.ravel(), minlength=256).astype(np.float64)
    below, total = hist.cumsum(), hist.sum()
    mean_below = (hist * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mean_below[-1] * below / total - mean_below) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def regions(mask: np.ndarray, most: int = 5) -> list[np.ndarray]:
    """The largest four-connected regions of a mask, by area: labels spread along rows and columns until they settle."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        before = label
        for axis in (0, 1):
            for flip in (False, True):
                x = np.flip(label, axis) if flip else label
                runs = np.moveaxis(x, axis, 0).copy()
                for k in range(1, len(runs)):
                    runs[k] = np.where(runs[k] > 0, np.maximum(runs[k], runs[k - 1]), 0)
                x = np.moveaxis(runs, 0, axis)
                label = np.flip(x, axis) if flip else x
        if (label == before).all():
            break
    ids, counts = np.unique(label[label > 0], return_counts=True)
    return [label == ids[k] for k in np.argsort(-counts, kind="stable")[:most]]


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points (x, y), turning one way."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(some) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def polygon_area(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def simplified(points: np.ndarray, n: int) -> np.ndarray:
    """A convex polygon brought to n corners: the corner that cuts off least goes, again and again."""
    while len(points) > n:
        a, b = np.roll(points, 1, 0) - points, np.roll(points, -1, 0) - points
        points = np.delete(points, np.argmin(np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])), 0)
    return points


def ordered(points: np.ndarray) -> np.ndarray | None:
    """(top left, top right, bottom right, bottom left) of four points; None if two are nearer than 15 or the area is under 100."""
    x, y = points.T
    four = points[[np.argmin(x + y), np.argmin(y - x), np.argmax(x + y), np.argmax(y - x)]].astype(float)
    gaps = np.hypot(*(four[:, None] - four[None]).transpose(2, 0, 1))[np.triu_indices(4, 1)]
    return None if gaps.min() < APART or polygon_area(four) < LEAST_AREA else four


def is_document(four: np.ndarray | None, width: int, height: int) -> bool:
    """Whether ordered corners can be a document in an image of this size: sides, aspect, parallel edges and area."""
    if four is None:
        return False
    side = np.roll(four, -1, 0) - four
    length = np.hypot(*side.T)
    across, down = (length[0] + length[2]) / 2, (length[1] + length[3]) / 2
    if across < SIDE_SHARE * width or down < SIDE_SHARE * height or not ASPECT[0] <= across / down <= ASPECT[1]:
        return False
    angle = np.degrees(np.arctan2(side[:, 1], side[:, 0]))
    turn = [abs(angle[k] - angle[k + 2]) % 180 for k in (0, 1)]
    return max(min(t, 180 - t) for t in turn) <= PARALLEL_DEGREES and polygon_area(four) >= AREA_SHARE * width * height


def meet(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The point where the lines through two pairs of points meet, None for parallel ones."""
    d, e = p[1] - p[0], q[1] - q[0]
    det = d[0] * e[1] - d[1] * e[0]
    if abs(det) < 1e-6:
        return None
    t = ((q[0][0] - p[0][0]) * e[1] - (q[0][1] - p[0][1]) * e[0]) / det
    return p[0] + t * d


def four_of_five(points: np.ndarray) -> np.ndarray | None:
    """Corners of a five-gon with one corner cut off: the shortest side goes, its neighbours are made to meet."""
    k = int(np.argmin(np.hypot(*(np.roll(points, -1, 0) - points).T)))
    q = np.roll(points, -k, 0)
    corner = meet((q[4], q[0]), (q[1], q[2]))
    return None if corner is None else ordered(np.vstack([corner, q[2:]]))


def corners_of_region(region: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """Corners of a region that fills a quadrilateral, or one with a corner cut off."""
    ys, xs = np.nonzero(region)
    outline = hull(np.stack([xs, ys], 1))
    if len(outline) < 4 or len(ys) < FILLED * polygon_area(outline):
        return None
    whole = polygon_area(outline)
    for kept in (0.985, 0.95):  # a corner cut off shows only where four corners must fit closely
        for n, corners in ((4, ordered), (5, four_of_five)):
            some = simplified(outline, n)
            if len(some) == n and polygon_area(some) >= kept * whole and is_document(found := corners(some), width, height):
                return found
    return None


def corners_of_lines(light: np.ndarray) -> np.ndarray | None:
    """Corners where the first and last level lines meet the first and last upright ones; the image's own edge stands in for a missing one."""
    h, w = light.shape
    mask = edges(light, 30.0)
    near = np.arange(-25.0, 25.5, 0.5)
    level = sorted(((a, d) for a, d, _ in lines(mask, near, 0.3 * w)), key=lambda t: t[1] + np.tan(np.radians(t[0])) * w / 2)
    upright = lines(mask.T, near, 0.3 * h)
    if len(level) < 2:
        return None

    def flat(a: float, d: float) -> tuple[np.ndarray, np.ndarray]:
        y = lambda x: (d + x * np.sin(np.radians(a))) / np.cos(np.radians(a))
        return np.array([0.0, y(0.0)]), np.array([float(w - 1), y(float(w - 1))])

    def steep(a: float, d: float) -> tuple[np.ndarray, np.ndarray]:
        x = lambda y: (d + y * np.sin(np.radians(a))) / np.cos(np.radians(a))
        return np.array([x(0.0), 0.0]), np.array([x(float(h - 1)), float(h - 1)])

    top, bottom = flat(*level[0]), flat(*level[-1])
    if bottom[0][1] + bottom[1][1] - top[0][1] - top[1][1] < 0.8 * h:  # they must span two fifths of the height
        return None
    sides = sorted((steep(a, d) for a, d, _ in upright), key=lambda s: s[0][0] + s[1][0])
    left = sides[0] if sides and sides[0][0][0] + sides[0][1][0] < 0.5 * w else steep(0.0, 0.0)
    right = sides[-1] if sides and sides[-1][0][0] + sides[-1][1][0] > 1.5 * w else steep(0.0, float(w - 1))
    points = [meet(a, b) for a, b in ((top, left), (top, right), (bottom, right), (bottom, left))]
    if any(p is None for p in points):
        return None
    four = ordered(np.clip(np.array(points), 0, [w - 1, h - 1]))
    return four if is_document(four, w, h) else None


def find_document(img: np.ndarray) -> np.ndarray | None:
    """Corners (top left, top right, bottom right, bottom left) of the sheet in a picture; None for a full page or where there is none.

    The five largest bright regions are tried, by area; then the lines of edges.
    """
    if is_full_page(img):
        return None
    step = max(1, max(img.shape[:2]) // 300)
    light = gray(img)[::step, ::step]
    h, w = light.shape
    for region in regions(light > otsu(light)):
        if (found := corners_of_region(region, w, h)) is not None:
            return found * step
    found = corners_of_lines(light)
    return None if found is None else found * step


def crop_and_flatten(img: np.ndarray) -> np.ndarray:
    """The sheet in a picture as an upright image; a full page stays as it is."""
    corners = find_document(img)
    return img if corners is None else flatten(img, corners)


def crop(img: np.ndarray, x: float, y: float, w: float, h: float, pad_x: int, pad_y: int) -> np.ndarray:
    """The padded box, inside the image."""
    return img[max(0, int(y) - pad_y) : int(y + h) + pad_y, max(0, int(x) - pad_x) : int(x + w) + pad_x]


def crop_polygon(img: np.ndarray, polygon: np.ndarray, padding: int | None = None, adaptive: bool = True) -> np.ndarray | None:
    """The quadrilateral of a line of text (top left, top right, bottom right, bottom left) as an upright image with padding; None for
    other polygons and those under five pixels. Where no matrix takes it, the padded box around it."""
    q = np.asarray(polygon, float)
    if q.shape != (4, 2):
        return None
    length = np.hypot(*(np.roll(q, -1, 0) - q).T)
    w, h = int(max(length[0], length[2])), int(max(length[1], length[3]))
    if w < 5 or h < 5:
        return None
    pad_y, pad_x = (padding, padding) if padding is not None else (max(4, int(0.16 * h)), max(4, int(0.08 * h))) if adaptive else (3, 3)
    right, low = pad_x + w - 1, pad_y + h - 1
    try:
        matrix = homography(np.array([[pad_x, pad_y], [right, pad_y], [right, low], [pad_x, low]]), q)
    except ValueError:
        x, y = q.min(0)
        return crop(img, x, y, *(q.max(0) - q.min(0)), pad_x, pad_y)
    return warp(img, matrix, w + 2 * pad_x, h + 2 * pad_y)


def is_full_page(img: np.ndarray) -> bool:
    """Whether all four corners (4 % of the sides) are bright and without colour."""
    h, w = img.shape[:2]
    ph, pw = max(1, int(0.04 * h)), max(1, int(0.04 * w))
    for ys in (slice(0, ph), slice(h - ph, h)):
        for xs in (slice(0, pw), slice(w - pw, w)):
            p = img[ys, xs].astype(float)
            if img.ndim == 2:
                if p.mean() < 120:
                    return False
                continue
            top, low = p.max(2), p.min(2)
            saturation = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)
            if saturation.mean() > 50 or top.mean() < 120:
                return False
    return True


def enhance_crop(img: np.ndarray) -> np.ndarray:
    """Gray, a little sharper."""
    g = gray(img).astype(float)
    return _bytes(1.25 * g - 0.25 * gaussian(g, 1.0))


def area_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """A smaller image, each pixel the mean of the area it covers, parts of pixels by their share."""
    out = img.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        if n == size:
            continue
        up_to = np.concatenate([np.zeros((1, *np.moveaxis(out, axis, 0).shape[1:])), np.moveaxis(out, axis, 0).cumsum(0)])
        at = np.arange(size + 1) * n / size
        low = np.minimum(at.astype(int), n - 1)
        part = (at - low).reshape(-1, *[1] * (out.ndim - 1))
        edge = up_to[low] + part * (up_to[low + 1] - up_to[low])
        out = np.moveaxis(np.diff(edge, axis=0) * size / n, 0, axis)
    return _bytes(out)


def shrink(img: np.ndarray, most: int = 2000) -> np.ndarray:
    """Longest side at most `most`, by the means of areas."""
    h, w = img.shape[:2]
    if max(h, w) <= most:
        return img
    return area_resize(img, max(1, w * most // max(h, w)), max(1, h * most // max(h, w)))


def thumbnail(img: np.ndarray, width: int = 90, height: int = 120) -> np.ndarray:
    """As large as fits the frame, with its aspect; a smaller image stays as it is."""
    h, w = img.shape[:2]
    f = min(width / w, height / h)
    return img if f >= 1 else area_resize(img, max(1, round(w * f)), max(1, round(h * f)))


def adaptive_threshold(light: np.ndarray, size: int = 21, below: float = 11.0) -> np.ndarray:
    """255 where a pixel is brighter than the Gaussian mean around it less `below`, else 0."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    r = size // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    mean = light.astype(np.float64)
    for axis in (0, 1):
        p = np.pad(mean, [(r, r) if a == axis else (0, 0) for a in range(2)], mode="edge")
        mean = sum(w * np.take(p, range(n, n + light.shape[axis]), axis) for n, w in enumerate(k))
    return np.where(light > np.rint(mean) - below, 255, 0).astype(np.uint8)


def order_page(img: np.ndarray, straighten: bool = True, threshold: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """(straightened image, black and white image, angle) of a photographed order: deskewed, gray, lightly blurred, thresholded locally."""
    angle = skew_angle(img) if straighten else 0.0
    straight = deskew(img, angle)
    light = gray(straight)
    return straight, adaptive_threshold(_bytes(gaussian(light, 0.8))) if threshold else light, angle


def enhance(img: np.ndarray, preset: Preset, stop: Callable[[], bool] = lambda: False) -> np.ndarray:
    """All steps in their order; when stop() holds, what is there so far."""
    steps = [
        lambda x: rotate(x, preset.rotation), lambda x: crop_and_flatten(x) if preset.flatten else x, lambda x: deskew(x) if preset.deskew else x, lambda x: denoise(x, preset.denoise),
        lambda x: whiten(x, preset.whitening), lambda x: contrast(x, preset.contrast),
        lambda x: clean_bw(x) if preset.color_mode == "clean_bw" else gray(x) if preset.color_mode == "grayscale" else x,
        lambda x: sharpen(x, preset.sharpness), lambda x: upscale(x, preset.upscale),
    ]
    for step in steps:
        if stop():
            break
        img = step(img)
    return img


def for_recognition(img: np.ndarray) -> np.ndarray:
    """The size-preserving enhancement before recognition."""
    return enhance(img, replace(Preset(), contrast=0.25, whitening=0.35, denoise=0.15, deskew=False))


def pixel_stats(df: DataFrame, keys: list[str], pixels: str) -> DataFrame:
    """(keys..., n, mean, variance) of an array of pixels, all in the JVM; the variance is that of the whole, in exact integers until the last step."""
    n, total, squares = F.size(pixels), F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, p: a + p), F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, p: a + p * p)
    return df.where(F.size(pixels) > 0).select(*keys, n.alias("n"), (total / n).alias("mean"), ((squares * n - total * total) / (n * n)).alias("variance"))


def apply(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys..., width, height, channels, data, error) of a kernel over images; a null image stays null, a failure is an error."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, h, c, d in zip(b["width"], b["height"], b["channels"], b["data"], strict=True):
                try:
                    if d is None:
                        out.append((None, None, None, None, None))
                        continue
                    img = np.frombuffer(d, np.uint8).reshape((int(h), int(w)) if c == 1 else (int(h), int(w), int(c)))
                    r = kernel(img)
                    out.append((r.shape[1], r.shape[0], 1 if r.ndim == 2 else r.shape[2], np.ascontiguousarray(r).tobytes(), None))
                except Exception as e:
                    out.append((None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            new = pd.DataFrame(out, columns=["width", "height", "channels", "data", "error"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})
            yield pd.concat([b[keys].reset_index(drop=True), new], axis=1)

    return df.select(*keys, "width", "height", "channels", "data").mapInPandas(run, f"{schema}, width int, height int, channels int, data binary, error string")
