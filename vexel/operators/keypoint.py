"""Scale-space keypoints with orientation and a 72-element descriptor of gradient histograms.

Smoothed images come from sums over stars (a square and a diamond) of growing radius; a keypoint is an extremum of (outer
minus inner mean) over scales that is also the strongest around. Each image is worked on where it is; no image is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .image import Star, _rounded, gray, star_area


@dataclass(frozen=True)
class Params:
    """Fixed values of the default detector."""

    min_radius: float = 6.16885
    levels: int = 17
    growth: float = 1.090508
    response: float = 18.0
    edge: float = 12.0
    near: float = 0.5
    stride: int = 2
    limit: int = 2000
    descriptor: str = "gradient"  # or "rectangle"


SCHEMA = "image_id bigint, k int, response double, y double, x double, radius double, level int, orientation double, desc array<double>"
BINS, PEAKS = 8, 72
#: Places across a histogram, spread of its weights, how many outer radii have to lie in the image, smoothing by outer radius.
SAMPLES, SPREAD, REGION, SMOOTH = 19, 0.2, 2.0, 1 / 6


def radii(p: Params) -> list[int]:
    """Inner radii: the radius grows by a factor until it rounds to a larger number, `levels` times. Outer ones are twice as large."""
    out, now = [_rounded(p.min_radius)], p.min_radius
    while len(out) < p.levels:
        now *= p.growth
        if _rounded(now) > out[-1]:
            out.append(_rounded(now))
    return out


def star_of(outer: int) -> int:
    """The radius by which an image is smoothed for keypoints of an outer radius."""
    return max(1, _rounded(outer * SMOOTH))


def smoothed(stars: Star, r: int) -> np.ndarray:
    """The mean over the star of radius r."""
    return stars.sums(r) / star_area(r)


def scale_response(stars: Star, inner: int, step: int) -> np.ndarray:
    """Mean of the ring between the stars of radius 2 inner and inner less the mean of the inner one."""
    within, whole = stars.sums(inner, step), stars.sums(2 * inner, step)
    return (whole - within) / (star_area(2 * inner) - star_area(inner)) - within / star_area(inner)


def extrema(stars: Star, p: Params) -> np.ndarray:
    """(levels, rows, cols) of every second pixel: the response where it is an extremum over scales, else 0.

    Every second scale is compared with its neighbours; an extremum then moves to the scale between if that one is stronger. Only
    scales whose outer star, twice over, lies in the image count."""
    size, step = radii(p), p.stride
    rows, cols = (len(range(0, n, step)) for n in stars.shape)
    y, x = np.arange(rows)[:, None] * step, np.arange(cols)[None, :] * step
    clear = np.minimum(np.minimum(y, stars.shape[0] - 1 - y), np.minimum(x, stars.shape[1] - 1 - x))  # the widest margin that fits
    fits = [(clear >= _rounded(2 * r * REGION)) for r in size]
    begins = _rounded(2 * size[0] * REGION)
    begins += begins % 2
    fits = [f & (y >= begins) & (x >= begins) & (y < stars.shape[0] - begins) & (x < stars.shape[1] - begins) for f in fits]
    field = [scale_response(stars, r, step) for r in size]
    out = np.zeros((len(size), rows, cols))
    for s in range(0, len(size) - 4, 2):
        low, mid, high = field[s], field[s + 2], field[s + 4]
        for sign in (1, -1):
            at = fits[s + 4] & (sign * mid > 0) & (sign * low < sign * mid) & (sign * high < sign * mid)
            under, over = sign * field[s + 1], sign * field[s + 3]
            first = sign * mid < under
            to_under, to_mid = first & (under > over), ~first & (sign * mid > over)
            out[s + 1][at & to_under] = field[s + 1][at & to_under]
            out[s + 2][at & to_mid] = mid[at & to_mid]
            rest = at & ~to_under & ~to_mid
            out[s + 3][rest] = field[s + 3][rest]
    return out


def _strongest(grid: np.ndarray, p: Params, size: list[int], shape: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(level, y, x) of extrema over the threshold that none in the circle around them, of the same level, is stronger than.

    Only cells over the threshold are looked at, each with the cells of its circle, so work follows the candidates."""
    found = []
    for s in range(1, len(size) - 1):
        near = _rounded(2 * size[s] * p.near)
        for i, j in np.argwhere(np.abs(grid[s]) >= p.response):
            y, x = i * p.stride, j * p.stride
            if y < near or x < near or y + near + 1 >= shape[0] or x + near + 1 >= shape[1]:
                continue
            sign, own = np.sign(grid[s, i, j]), np.abs(grid[s, i, j])
            ys = np.arange((y - near) // p.stride, (y + near + 1) // p.stride)
            down = np.abs(y - ys * p.stride)
            wide = np.where(down <= near, np.floor(np.sqrt(np.maximum(near * near - down * down, 0)) + 0.5), 0).astype(int)
            first = (x - near) // p.stride
            xs = np.arange(first, (x + near + 1) // p.stride + 1)
            inside = (xs[None, :] >= ((x - wide) // p.stride)[:, None]) & (xs[None, :] < ((x + wide + 1) // p.stride)[:, None])
            block = grid[s, ys[0] : ys[-1] + 1, first : first + len(xs)]
            if not (inside[:, : block.shape[1]] & (sign * block > own)).any():
                found.append((s, int(y), int(x)))
    return found


def _windows(x: np.ndarray) -> np.ndarray:
    return np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def detect(x: np.ndarray, p: Params, stars: Star | None = None) -> list[tuple[float, int, int, int, int]]:
    """(response, y, x, outer radius, level), largest radius first, then strongest.

    An extremum over scales stays if it is over the threshold, the strongest of its level around, and no edge: the square of the
    trace over the determinant of the summed products of gradients around it is below `edge`."""
    size = radii(p)
    stars = stars or Star(x, 2 * size[-1])
    kept, tables = [], {}
    grid = extrema(stars, p)
    for s, y, c in _strongest(grid, p, size, x.shape):
        r = 2 * size[s]
        if r not in tables:
            soft = np.pad(smoothed(stars, star_of(r)), 1, mode="edge")
            dy, dx = soft[:-2, 1:-1] - soft[2:, 1:-1], soft[1:-1, :-2] - soft[1:-1, 2:]
            tables[r] = [_windows(t) for t in (dx * dx, dy * dy, dx * dy)]
        y0, y1, x0, x1 = max(y - r, 0), y + r + 1, max(c - r, 0), c + r + 1
        xx, yy, xy = (t[min(y1, x.shape[0]), min(x1, x.shape[1])] - t[y0, min(x1, x.shape[1])] - t[min(y1, x.shape[0]), x0] + t[y0, x0] for t in tables[r])
        with np.errstate(divide="ignore", invalid="ignore"):
            if not np.float64((xx + yy) ** 2) / np.float64(xx * yy - xy * xy) >= p.edge:
                kept.append((float(grid[s, y // p.stride, c // p.stride]), y, c, r, s))
    kept.sort(key=lambda k: (-k[3], -abs(k[0]), k[1], k[2]))
    return kept[: p.limit]


def _histogram(soft: np.ndarray, y: float, x: float, r: float, bins: int, turn: float = 0.0) -> np.ndarray:
    """Directions of gradients at 19 x 19 places in the circle of radius r, each from the eight corners of a star, weighted by strength
    and nearness. Places outside the image count as its border."""
    rows, cols = soft.shape
    ky, kx, whole, star = _rounded(y), _rounded(x), max(1, _rounded(r)), star_of(int(r))
    tilt, half = _rounded(star / np.sqrt(2)), max(1, whole - 2 * star)
    off = np.floor(-half + 2 * half / SAMPLES * np.arange(SAMPLES) + 0.5).astype(int)
    far = off[:, None] ** 2 + off[None, :] ** 2
    at = lambda dy, dx: soft[np.clip(ky + off + dy, 0, rows - 1)[:, None], np.clip(kx + off + dx, 0, cols - 1)[None, :]]
    weight = np.exp(-((np.floor(np.sqrt(far) + 0.5) / whole) ** 2) / (2 * SPREAD)) * (far <= half * half)
    pairs = ((at(0, star) - at(0, -star), at(star, 0) - at(-star, 0), 0), (at(tilt, tilt) - at(-tilt, -tilt), at(tilt, -tilt) - at(-tilt, tilt), bins * 45 // 360))
    out = np.zeros(bins)
    for across, down, ahead in pairs:
        place = np.floor(bins * ((np.arctan2(down, across) + np.pi - turn) % (2 * np.pi)) / (2 * np.pi) + 0.5).astype(int) + ahead
        out += np.bincount((place % bins).ravel(), (np.hypot(across, down) * weight).ravel(), bins)
    return out


def orientations(soft: np.ndarray, y: int, x: int, r: int) -> list[float]:
    """The strongest direction, and a second one above 0.8 of it that is no neighbour."""
    h = _histogram(soft, y, x, r, PEAKS)
    first = int(h.argmax())
    out = [first]
    order = np.argsort(-h, kind="stable")
    second = int(order[1])
    if h[first] > 0 and h[second] > 0.8 * h[first] and (first - second) % PEAKS not in (1, PEAKS - 1):
        out.append(second)
    return [2 * np.pi / PEAKS * b - np.pi for b in out]


def describe(soft: np.ndarray, y: float, x: float, r: float, turn: float, kind: str = "gradient") -> np.ndarray:
    """Eight points on a turned ring and the centre, 8 bins each, every block of length 1."""
    places = [(y + r * np.sin(turn + a), x + r * np.cos(turn + a)) for a in np.arange(8) * np.pi / 4] + [(y, x)]
    out = []
    for py, px in places:
        if kind == "gradient":
            h = _histogram(soft, py, px, r, BINS, turn)
        else:
            h = _differences(soft, py, px, r, turn)
        size = np.linalg.norm(h)
        out.append(h / size if size > 0 else h)
    return np.concatenate(out)


def _differences(soft: np.ndarray, y: float, x: float, r: float, turn: float) -> np.ndarray:
    """Positive and negative parts of the differences between opposite points in four directions."""
    at = lambda py, px: soft[int(np.clip(round(py), 0, soft.shape[0] - 1)), int(np.clip(round(px), 0, soft.shape[1] - 1))]
    out = []
    for a in turn + np.arange(4) * np.pi / 4:
        d = at(y + r / 2 * np.sin(a), x + r / 2 * np.cos(a)) - at(y - r / 2 * np.sin(a), x - r / 2 * np.cos(a))
        out += [max(d, 0.0), max(-d, 0.0)]
    return np.array(out)


def extract(a: np.ndarray, p: Params, grid: list[tuple[float, int, int]] | None = None) -> list[tuple]:
    """Rows (response, y, x, radius, level, orientation, descriptor); `grid` has (radius, rows, cols) of dense points instead."""
    x = gray(a)
    size = radii(p)
    widest = 2 * size[-1] if grid is None else max([star_of(int(r)) for r, _, _ in grid] + [1])
    stars = Star(x, widest)
    if grid is None:
        points = detect(x, p, stars)
    else:
        points = [(0.0, (i + 0.5) * x.shape[0] / n, (j + 0.5) * x.shape[1] / m, r, 0) for r, n, m in grid for i in range(n) for j in range(m)]
    soft: dict[int, np.ndarray] = {}
    out = []
    for response, y, c, r, level in points:
        if int(r) not in soft:
            soft[int(r)] = smoothed(stars, star_of(int(r)))
        own = soft[int(r)]
        for turn in orientations(own, y, c, r):
            out.append((response, float(y), float(c), float(r), level, turn, describe(own, y, c, r, turn + np.pi, p.descriptor)))
    return out[: p.limit] if grid is None else out


def keypoints(images: DataFrame, params: Params = Params(), grid: list[tuple[float, int, int]] | None = None) -> DataFrame:
    """One row per keypoint: image_id, k, response, y, x, radius, level, orientation, desc."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, r, c, n, data in zip(batch["image_id"], batch["rows"], batch["cols"], batch["n"], batch["data"]):
                out += [(i, k, *row) for k, row in enumerate(extract(np.asarray(data, float).reshape(r, c, n), params, grid))]
            yield pd.DataFrame(out, columns=["image_id", "k", "response", "y", "x", "radius", "level", "orientation", "desc"])

    return images.select("image_id", "rows", "cols", "n", "data").mapInPandas(run, SCHEMA)


def matches(queries: DataFrame, base: DataFrame, most: float = 0.05) -> DataFrame:
    """(qid, m, dist): keypoints (qid, v) with their nearest one of base (m, v) by cosine, if it is near enough."""
    from .knn import nearest

    return nearest(base, queries, "cosine").filter(f"dist < {most}")


__all__ = ["Params", "describe", "detect", "extrema", "extract", "keypoints", "matches", "orientations", "radii", "scale_response", "smoothed"]
