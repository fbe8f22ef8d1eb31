"""Image operators over a table of images (image_id, rows, cols, n, data ARRAY<DOUBLE>), pixels row by row, channels BGR.

An image is one row, so every operator is a narrow map of NumPy kernels and images never move. Point operations and
summaries also have a relational form over (image_id, row, col, b, g, r).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

SCHEMA = "image_id bigint, rows int, cols int, n int, data array<double>"

# Weights of the gray level, the 5 x 5 kernel of standard deviation 1, and the edge kernels.
GRAY = (0.11, 0.59, 0.30)
_g = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
GAUSSIAN5 = np.outer(_g, _g) / np.outer(_g, _g).sum()
LAPLACIAN4 = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
LAPLACIAN8 = np.array([[1, 1, 1], [1, -8, 1], [1, 1, 1]], float)
LAPLACIAN_DIAGONAL = np.array([[-1, 2, -1], [2, -4, 2], [-1, 2, -1]], float)


# Relational forms.
def to_images(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Images from (image_id, row, col, channels...); every image must be complete."""
    cell = F.struct("row", "col", F.array(*(F.col(c).cast("double") for c in channels)).alias("x"))
    grouped = pixels.groupBy("image_id").agg((F.max("row") + 1).cast("int").alias("rows"), (F.max("col") + 1).cast("int").alias("cols"), F.array_sort(F.collect_list(cell)).alias("p"))
    return grouped.select(F.col("image_id").cast("bigint").alias("image_id"), "rows", "cols", F.lit(len(channels)).alias("n"), F.flatten(F.transform("p", lambda p: p["x"])).alias("data"))


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, row, col, channel, x)."""
    cells = images.select("image_id", "cols", "n", F.posexplode("data").alias("at", "x"))
    place = (F.col("at") / F.col("n")).cast("int")
    return cells.select("image_id", (place / F.col("cols")).cast("int").alias("row"), (place % F.col("cols")).alias("col"), (F.col("at") % F.col("n")).alias("channel"), "x")


def gray_of(b: Column, g: Column, r: Column) -> Column:
    return b * GRAY[0] + g * GRAY[1] + r * GRAY[2]


def hsv_of(b: Column, g: Column, r: Column) -> Column:
    """(h, s, v): hue 0 to 360, the others 0 to 255."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    wide = high - low
    hue = F.when(wide == 0, 0.0).when(high == r, F.try_divide(g - b, wide) * 60.0).when(high == g, F.try_divide(b - r, wide) * 60.0 + 120.0).otherwise(F.try_divide(r - g, wide) * 60.0 + 240.0)
    return F.struct(F.when(hue < 0, hue + 360.0).otherwise(hue).alias("h"), F.when(high == 0, 0.0).otherwise(F.try_divide(wide, high) * 255.0).alias("s"), high.alias("v"))


def bgr_of(h: Column, s: Column, v: Column) -> Column:
    """The inverse of `hsv_of`; hues from 360 on begin anew."""
    sector = F.floor(F.pmod(h, F.lit(360.0)) / 60.0)
    f = F.pmod(h, F.lit(360.0)) / 60.0 - sector
    k = s / 255.0
    p, q, t = v * (F.lit(1.0) - k), v * (F.lit(1.0) - k * f), v * (F.lit(1.0) - k * (F.lit(1.0) - f))
    pick = lambda *xs: F.element_at(F.array(*xs), (sector + 1).cast("int"))
    return F.struct(pick(p, p, t, v, v, q).alias("b"), pick(t, v, v, q, p, p).alias("g"), pick(v, q, p, p, t, v).alias("r"))


def opponent_of(b: Column, g: Column, r: Column) -> Column:
    """(c1, c2, c3) of the opponent colours, whole numbers."""
    return F.struct(F.floor((r + g + b) / 3).cast("double").alias("c1"), F.floor((r + 255.0 - b) / 2).cast("double").alias("c2"), F.floor((r + (F.lit(255.0) - g) * 2 + b) / 4).cast("double").alias("c3"))


def bgr_of_opponent(c1: Column, c2: Column, c3: Column) -> Column:
    """The inverse of `opponent_of` as near as whole numbers allow, within 0 to 255."""
    # c1 = (r + g + b) / 3, 2 c2 - 255 = r - b, 4 c3 - 510 = r - 2 g + b.
    g = (c1 * 3 - (c3 * 4 - 510.0)) / 3
    both, diff = c1 * 3 - g, c2 * 2 - 255.0
    bound = lambda x: F.greatest(F.least(F.floor(x).cast("double"), F.lit(255.0)), F.lit(0.0))
    return F.struct(bound((both - diff) / 2).alias("b"), bound(g).alias("g"), bound((both + diff) / 2).alias("r"))


def contrast_of(x: Column, angle: float) -> Column:
    """tan(angle) * (level - 127) + 127 within 0 to 255, of the level as a whole number."""
    level = F.floor(x).cast("double")
    return F.greatest(F.least((level - 127.0) * float(np.tan(np.radians(angle))) + 127.0, F.lit(255.0)), F.lit(0.0))


# Kernels: each takes an array (rows, cols, n) and returns one.
def apply(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`kernel` on every image, in the tasks where the images are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, r, c, n, data in zip(batch["image_id"], batch["rows"], batch["cols"], batch["n"], batch["data"]):
                made = np.asarray(kernel(np.asarray(data, float).reshape(r, c, n)), float)
                made = made[:, :, None] if made.ndim == 2 else made
                out.append((i, *made.shape, made.ravel()))
            yield pd.DataFrame(out, columns=["image_id", "rows", "cols", "n", "data"])

    return images.select("image_id", "rows", "cols", "n", "data").mapInPandas(run, SCHEMA)


def vector_of(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, v): a feature vector of every image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.asarray(kernel(np.asarray(d, float).reshape(r, c, n)), float).ravel() for r, c, n, d in zip(batch["rows"], batch["cols"], batch["n"], batch["data"])]
            yield pd.DataFrame({"image_id": batch["image_id"], "v": made})

    return images.select("image_id", "rows", "cols", "n", "data").mapInPandas(run, "image_id bigint, v array<double>")


def gray(a: np.ndarray) -> np.ndarray:
    return a @ np.array(GRAY) if a.shape[2] == 3 else a[:, :, 0]


def equalize(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """Levels by their cumulative share, stretched to 0 to 255."""
    level = np.clip(a[:, :, channel], 0, 255).astype(int)
    share = np.cumsum(np.bincount(level.ravel(), minlength=256)) / level.size
    low = share[level.min()]
    table = np.zeros(256) if low >= 1 else np.clip((share - low) * 255 / (1 - low), 0, 255)
    return table[level]


def contrast_sigmoid(a: np.ndarray, gain: float, channel: int = 0) -> np.ndarray:
    """A sigmoid between the least and the largest level of the channel."""
    x = a[:, :, channel]
    low, high = x.min(), x.max()
    if high <= low:
        return x.copy()
    s = lambda t: 1 / (1 + np.exp(-gain * 10 * (t - 0.5)))
    return np.clip((s((x - low) / (high - low)) - s(0.0)) / (s(1.0) - s(0.0)), 0, 1) * (high - low) + low


def flip_x(a: np.ndarray) -> np.ndarray:
    return a[:, ::-1]


def flip_y(a: np.ndarray) -> np.ndarray:
    return a[::-1]


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (size, size))


def gaussian5x5(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """The border of two pixels stays as it is."""
    x = a[:, :, channel]
    out = x.copy()
    if min(x.shape) >= 5:
        out[2:-2, 2:-2] = np.einsum("ijkl,kl->ij", _windows(x, 5), GAUSSIAN5)
    return out


def laplacian(a: np.ndarray, kernel: np.ndarray, level: float) -> np.ndarray:
    """3 x 3 convolution without negatives: times `level` and at most 255, or for level 0 whether above an eighth of the most. Border 0."""
    x = gray(a)
    out = np.zeros(x.shape)
    if min(x.shape) >= 3:
        out[1:-1, 1:-1] = np.maximum(np.einsum("ijkl,kl->ij", _windows(x, 3), kernel), 0)
    return np.minimum(out * level, 255) if level else np.where(out > out.max() / 8, 255.0, 0.0)


def _neighbours(a: np.ndarray, channel: int, empty: float) -> np.ndarray:
    return _windows(np.pad(a[:, :, channel], 1, constant_values=empty), 3)


def erode(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """The least of the 3 x 3 neighbours inside the image."""
    return _neighbours(a, channel, np.inf).min(axis=(2, 3))


def dilate(a: np.ndarray, channel: int = 0) -> np.ndarray:
    return _neighbours(a, channel, -np.inf).max(axis=(2, 3))


def morph_open(a: np.ndarray, channel: int = 0) -> np.ndarray:
    return dilate(erode(a, channel)[:, :, None])


def morph_close(a: np.ndarray, channel: int = 0) -> np.ndarray:
    return erode(dilate(a, channel)[:, :, None])


def integral(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """Sums of all pixels above and to the left, one row and column larger than the image."""
    return np.pad(a[:, :, channel].cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def rectangle(table: np.ndarray, y: int, x: int, height: int, width: int) -> float:
    return float(table[y + height, x + width] - table[y, x + width] - table[y + height, x] + table[y, x])


def integral_tilted(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """At (y, x): the sum of the triangle of pixels above, whose sides go up at 45 degrees from (y - 1, x - 1).

    A row follows from the two above it: two triangles one row higher, less what they share, and the two pixels between."""
    x = a[:, :, channel]
    rows, cols = x.shape
    side = rows + 1  # no triangle reaches further
    pixels = np.pad(x.astype(float), ((0, 0), (side, side)))
    out = np.zeros((rows + 1, pixels.shape[1] + 1))
    for y in range(1, rows + 1):
        out[y, 1:-1] = out[y - 1, :-2] + out[y - 1, 2:] + pixels[y - 1, :-1]
        if y > 1:
            out[y, 1:-1] += pixels[y - 2, :-1] - out[y - 2, 1:-1]
    return out[:, side : side + cols + 1]


def _rounded(x: float) -> int:
    return int(np.floor(x + 0.5))


def star_area(r: int) -> int:
    """Pixels of a star: of a square of half diagonal r, 2 round(r / sqrt 2) wide, and of a diamond of half diagonal r together."""
    return (2 * _rounded(r / np.sqrt(2))) ** 2 + 2 * r * r


class Star:
    """Sums over stars of any radius up to `reach` around the pixels of an image, each by eight places of two tables; zeros lie around the image."""

    def __init__(self, x: np.ndarray, reach: int):
        self.shape, self.reach = x.shape, reach + 1
        wide = np.pad(x.astype(float), self.reach)[:, :, None]
        self.upright = np.pad(wide[:, :, 0].cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        self.tilted = integral_tilted(wide)

    def sums(self, r: int, step: int = 1) -> np.ndarray:
        """At every `step`-th pixel; the square and the diamond are counted apart, so what both cover counts twice."""
        side = _rounded(r / np.sqrt(2))

        def at(table: np.ndarray, dy: int, dx: int) -> np.ndarray:
            return table[self.reach + dy : self.reach + dy + self.shape[0] : step, self.reach + dx : self.reach + dx + self.shape[1] : step]

        square = at(self.upright, -side, -side) - at(self.upright, -side, side) - at(self.upright, side, -side) + at(self.upright, side, side)
        diamond = at(self.tilted, -r, 0) - at(self.tilted, 0, -r) - at(self.tilted, 0, r) + at(self.tilted, r, 0)
        return np.maximum(square + diamond, 0)


def star_sum(x: np.ndarray, r: int) -> np.ndarray:
    """The sum over the star of radius r around every pixel, inside the image."""
    return Star(x, r).sums(r)


def _pooled(a: np.ndarray, size: int, stride: int, f: Callable[..., np.ndarray]) -> np.ndarray:
    """f over the windows at every `stride`; a window that leaves the image is cut, which NaN padding stands for."""
    rows, cols = a.shape[0] // stride, a.shape[1] // stride
    padded = np.pad(np.asarray(a, float), ((0, size), (0, size), (0, 0)), constant_values=np.nan)
    return f(np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(0, 1))[: rows * stride : stride, : cols * stride : stride], axis=(3, 4))


def max_pooling(a: np.ndarray, size: int, stride: int) -> np.ndarray:
    """The largest value in each window, 0 at least."""
    return np.maximum(_pooled(a, size, stride, np.nanmax), 0)


def average_pooling(a: np.ndarray, size: int, stride: int) -> np.ndarray:
    return _pooled(a, size, stride, np.nanmean)


def resize(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear, aligned at the top left, the last pixel repeated."""
    y, x = np.arange(rows) * a.shape[0] / rows, np.arange(cols) * a.shape[1] / cols
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    return (a[y0][:, x0] * (1 - fy) + a[y1][:, x0] * fy) * (1 - fx) + (a[y0][:, x1] * (1 - fy) + a[y1][:, x1] * fy) * fx


def crop(a: np.ndarray, y: int, x: int, rows: int, cols: int) -> np.ndarray:
    """A rectangle; what lies outside the image is 0."""
    out = np.zeros((rows, cols, a.shape[2]))
    own = a[max(y, 0) : y + rows, max(x, 0) : x + cols]
    out[max(-y, 0) : max(-y, 0) + own.shape[0], max(-x, 0) : max(-x, 0) + own.shape[1]] = own
    return out


def crop_resize(a: np.ndarray, y: int, x: int, rows: int, cols: int, to_rows: int, to_cols: int) -> np.ndarray:
    return resize(crop(a, y, x, rows, cols), to_rows, to_cols)


def patch_rows(a: np.ndarray, size: int, grid_rows: int | None = None, grid_cols: int | None = None) -> Iterator[np.ndarray]:
    """The square patches on a grid, a row of them at a time as (patches, size * size * n); without a grid, at every place but the last."""
    r, c, n = a.shape
    gr, gc = grid_rows or r - size, grid_cols or c - size
    if min(gr, gc, r - size + 1, c - size + 1) < 1:
        return
    windows = np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(0, 1))
    px = ((c - size) / gc * np.arange(gc)).astype(int)
    for y in ((r - size) / gr * np.arange(gr)).astype(int):
        yield windows[y, px].transpose(0, 2, 3, 1).reshape(gc, size * size * n)


def patches(images: DataFrame, size: int, grid_rows: int | None = None, grid_cols: int | None = None) -> DataFrame:
    """(image_id, row, col, v): the square patches on a grid; without one, at every place but the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, r, c, n, data in zip(batch["image_id"], batch["rows"], batch["cols"], batch["n"], batch["data"]):
                for y, found in enumerate(patch_rows(np.asarray(data, float).reshape(r, c, n), size, grid_rows, grid_cols)):
                    yield pd.DataFrame({"image_id": i, "row": y, "col": np.arange(len(found)), "v": list(found)})

    return images.select("image_id", "rows", "cols", "n", "data").mapInPandas(run, "image_id bigint, row int, col int, v array<double>")


def convolve(images: DataFrame, encode: Callable[[np.ndarray], np.ndarray], size: int, grid_rows: int | None = None, grid_cols: int | None = None) -> DataFrame:
    """Feature maps: every patch of `patch_rows` is a pixel, and what `encode` makes of it (an autoencoder's code, say) its channels.

    A row of patches goes through one matrix product, so an image costs the memory of one row of them beside its map. The
    maps are images and can be pooled or convolved again; an image smaller than a patch has an empty map.
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        made = [encode(row) for row in patch_rows(a, size, grid_rows, grid_cols)]
        return np.stack(made) if made else np.zeros((0, 0, 0))

    return apply(images, kernel)


def transposed(images: DataFrame) -> DataFrame:
    """Rows and columns exchanged, pixels whole."""
    return apply(images, lambda a: a.transpose(1, 0, 2))


def images_of(df: DataFrame, rows: int, cols: int, n: int = 1) -> DataFrame:
    """The vectors (m, v) of rows * cols * n elements as images."""
    return df.select(F.col("m").cast("bigint").alias("image_id"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.lit(n).alias("n"), F.col("v").alias("data"))


def components(labels: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected areas of equal labels, in the order of their first pixel.

    Roots of linked pixels are hooked to the lower one and paths halved until no link joins two roots.
    """
    rows, cols = labels.shape
    flat, place = labels.ravel(), np.arange(labels.size).reshape(labels.shape)
    links = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a, b = place[: rows - dy, max(0, -dx) : cols - max(0, dx)].ravel(), place[dy:, max(0, dx) : cols + min(0, dx)].ravel()
        same = flat[a] == flat[b]
        links.append(np.stack([a[same], b[same]]))
    u, w = np.concatenate(links, axis=1)
    root = np.arange(labels.size)
    while len(u):
        low, high = np.minimum(root[u], root[w]), np.maximum(root[u], root[w])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_links = root[u] != root[w]
        u, w = u[open_links], w[open_links]
    return np.unique(root, return_inverse=True)[1].reshape(labels.shape)


def colour_coherence(a: np.ndarray, centroids: np.ndarray, threshold: int | None = None) -> np.ndarray:
    """For each centroid the pixels in areas larger than the threshold, then those in smaller ones."""
    threshold = round(0.1 * np.sqrt(a.shape[0] * a.shape[1])) if threshold is None else threshold
    flat = a.reshape(-1, a.shape[2])
    nearest = np.stack([((flat - c) ** 2).sum(axis=1) for c in centroids], axis=1).argmin(axis=1).reshape(a.shape[:2])
    area = components(nearest)
    large = (np.bincount(area.ravel()) > threshold)[area]
    k = len(centroids)
    return np.concatenate([np.bincount(nearest[large], minlength=k), np.bincount(nearest[~large], minlength=k)]).astype(float)


def rectangle_feature(a: np.ndarray, y: int = 0, x: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
    """1152 numbers: in a window of 32 units, cells of 8 units every 2 units (12 x 12), 8 responses each.

    The responses are the positive and negative parts of the differences left-right, top-bottom and of both diagonals.
    """
    table = integral(gray(a)[:, :, None])
    height, width = height or a.shape[0], width or a.shape[1]
    uy, ux = height / 32.0, width / 32.0
    cut_y = lambda v: int(np.clip(y + v * uy, 0, a.shape[0]))
    cut_x = lambda v: int(np.clip(x + v * ux, 0, a.shape[1]))
    out = []
    for cy in range(0, 24, 2):
        for cx in range(0, 24, 2):
            y0, y1, y2, x0, x1, x2 = cut_y(cy), cut_y(cy + 4), cut_y(cy + 8), cut_x(cx), cut_x(cx + 4), cut_x(cx + 8)
            q = [rectangle(table, *b) for b in ((y0, x0, y1 - y0, x1 - x0), (y0, x1, y1 - y0, x2 - x1), (y1, x0, y2 - y1, x1 - x0), (y1, x1, y2 - y1, x2 - x1))]
            for d in (q[0] + q[2] - q[1] - q[3], q[0] + q[1] - q[2] - q[3], q[0] - q[3], q[1] - q[2]):
                out += [max(d, 0.0), max(-d, 0.0)]
    return np.array(out)


def pixels_vector(images: DataFrame) -> DataFrame:
    """(m, v) of all pixels, for the vector operators: m is row * cols + col within the image."""
    return images.select("image_id", F.posexplode(vec.reshape("data", 3)).alias("m", "v"))
