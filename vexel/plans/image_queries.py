"""Queries of image operators, on pixels of a fixed integer formula (the same in SQL)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import frame, image, keypoint, learn
from ..streaming import background
from .registry import QUERIES, SQL, query, table
from .vector_queries import E, vectors

ROWS, COLS, IMAGES = 24, 32, 4
P = f"p as (select i as image_id, y as row, x as col, ((y * 7 + x * 13 + i * 5) % 256)::double as b, ((y * 3 + x * 29 + i * 11) % 256)::double as g, ((y * 17 + x * 5 + i * 3) % 256)::double as r from range({IMAGES}) a(i), range({ROWS}) b(y), range({COLS}) c(x)), q as (select *, b * 0.11 + g * 0.59 + r * 0.30 as k from p)"


def pixels(spark: SparkSession) -> DataFrame:
    """(image_id, row, col, b, g, r)."""
    i, y, x = (F.col("id") / (ROWS * COLS)).cast("bigint"), (F.col("id") % (ROWS * COLS) / COLS).cast("bigint"), F.col("id") % COLS
    rows = spark.range(IMAGES * ROWS * COLS).select(i.alias("image_id"), y.alias("row"), x.alias("col"))
    level = lambda a, b, c: ((F.col("row") * a + F.col("col") * b + F.col("image_id") * c) % 256).cast("double")
    return rows.select("image_id", "row", "col", level(7, 13, 5).alias("b"), level(3, 29, 11).alias("g"), level(17, 5, 3).alias("r"))


def images(spark: SparkSession) -> DataFrame:
    return image.to_images(pixels(spark), ["b", "g", "r"])


def cells(df: DataFrame) -> DataFrame:
    out = image.to_pixels(df)
    return out.select("image_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("channel").cast("bigint").alias("channel"), F.round(F.col("x") + 0.0, 6).alias("x"))


def _kernel(name: str, kernel: Callable[[np.ndarray], np.ndarray], sql: str | None) -> None:
    """`sql` gives (image_id, row, col, channel, x)."""
    QUERIES[name] = lambda spark, sf_dir: cells(image.apply(images(spark), kernel))
    if sql:
        SQL[name] = f"with {P} select image_id, row, col, channel::bigint as channel, round(x, 6) + 0.0 as x from ({sql})"


_three = "case ch when 0 then b when 1 then g else r end"


def _around(value: str, reach: int, inside: str = "true", source: str = "q") -> str:
    """Each pixel with those around it, inside the image."""
    return f"select c.image_id, c.row, c.col, 0 as channel, {value} as x from {source} c join {source} o on o.image_id = c.image_id and abs(o.row - c.row) <= {reach} and abs(o.col - c.col) <= {reach} where {inside} group by c.image_id, c.row, c.col"


_kernel("gray", image.gray, "select image_id, row, col, 0 as channel, k as x from q")
_kernel("flip_x", image.flip_x, f"select image_id, {COLS - 1} - col as col, row, ch as channel, {_three} as x from p, range(3) t(ch)")
_kernel("flip_y", image.flip_y, f"select image_id, {ROWS - 1} - row as row, col, ch as channel, {_three} as x from p, range(3) t(ch)")
_kernel("crop", lambda a: image.crop(a, 16, 20, 12, 16), f"select i as image_id, y as row, x_ as col, ch as channel, coalesce({_three}, 0) as x from range({IMAGES}) a(i) cross join range(12) b(y) cross join range(16) c(x_) cross join range(3) t(ch) left join p on p.image_id = i and p.row = y + 16 and p.col = x_ + 20")
_kernel("erode", lambda a: image.erode(image.gray(a)[:, :, None]), _around("min(o.k)", 1))
_kernel("dilate", lambda a: image.dilate(image.gray(a)[:, :, None]), _around("max(o.k)", 1))
_kernel("morph_open", lambda a: image.morph_open(image.gray(a)[:, :, None]), _around("max(o.x)", 1, source="(" + _around("min(o.k)", 1) + ")"))
_kernel("morph_close", lambda a: image.morph_close(image.gray(a)[:, :, None]), _around("min(o.x)", 1, source="(" + _around("max(o.k)", 1) + ")"))
_kernel("integral", lambda a: image.integral(image.gray(a)[:, :, None]), f"select i as image_id, y as row, x_ as col, 0 as channel, coalesce(sum(k), 0) as x from range({IMAGES}) a(i) cross join range({ROWS + 1}) b(y) cross join range({COLS + 1}) c(x_) left join q on q.image_id = i and q.row < y and q.col < x_ group by i, y, x_")
_kernel("integral_tilted", lambda a: image.integral_tilted(image.gray(a)[:, :, None]), f"select i as image_id, y as row, x_ as col, 0 as channel, coalesce(sum(k), 0) as x from range({IMAGES}) a(i) cross join range({ROWS + 1}) b(y) cross join range({COLS + 1}) c(x_) left join q on q.image_id = i and q.row < y and q.col >= x_ - 1 - (y - 1 - q.row) and q.col < x_ + (y - 1 - q.row) group by i, y, x_")
_pool = lambda f: f"select image_id, y as row, x_ as col, 0 as channel, {f} as x from q, range({ROWS // 4}) a(y), range({COLS // 4}) b(x_) where q.row between y * 4 and y * 4 + 5 and q.col between x_ * 4 and x_ * 4 + 5 group by image_id, y, x_"
_kernel("max_pool", lambda a: image.max_pooling(image.gray(a)[:, :, None], 6, 4), _pool("greatest(max(k), 0)"))
_kernel("avg_pool", lambda a: image.average_pooling(image.gray(a)[:, :, None], 6, 4), _pool("avg(k)"))
_edge = f"c.row between 1 and {ROWS - 2} and c.col between 1 and {COLS - 2}"


def _laplacian(name: str, kernel: np.ndarray, weight: str) -> None:
    value = f"least(greatest(sum({weight} * o.k), 0) * 0.5, 255)"
    whole = f"select q.image_id, q.row, q.col, 0 as channel, coalesce(e.x, 0) as x from q left join ({_around(value, 1, _edge)}) e using (image_id, row, col)"
    _kernel(name, lambda a: image.laplacian(a, kernel, 0.5), whole)


_laplacian("laplacian1", image.LAPLACIAN4, "(case when o.row = c.row and o.col = c.col then -4 when o.row = c.row or o.col = c.col then 1 else 0 end)")
_laplacian("laplacian2", image.LAPLACIAN8, "(case when o.row = c.row and o.col = c.col then -8 else 1 end)")
_laplacian("laplacian3", image.LAPLACIAN_DIAGONAL, "(case when o.row = c.row and o.col = c.col then -4 when o.row = c.row or o.col = c.col then 2 else -1 end)")
_inner = f"c.row between 2 and {ROWS - 3} and c.col between 2 and {COLS - 3}"
_weights = "exp(-((o.row - c.row) * (o.row - c.row) + (o.col - c.col) * (o.col - c.col)) / 2.0)"
_kernel("gauss5x5", lambda a: image.gaussian5x5(image.gray(a)[:, :, None]), f"select q.image_id, q.row, q.col, 0 as channel, coalesce(e.x, k) as x from q left join ({_around(f'sum({_weights} * o.k) / sum({_weights})', 2, _inner)}) e using (image_id, row, col)")
_kernel("resize", lambda a: image.resize(a, 12, 16), f"select image_id, row / 2 as row, col / 2 as col, ch as channel, {_three} as x from p, range(3) t(ch) where row % 2 = 0 and col % 2 = 0".replace("row / 2", "row // 2").replace("col / 2", "col // 2"))
_kernel("hist_eq", lambda a: image.equalize(a, 1), "select image_id, row, col, 0 as channel, least(greatest((share - low) * 255 / (1 - low), 0), 255) as x from (select *, count(*) over (partition by image_id order by floor(g))::double / count(*) over (partition by image_id) as share, first_value(n0) over (partition by image_id order by floor(g)) as low from (select *, count(*) over (partition by image_id, floor(g))::double / count(*) over (partition by image_id) as n0 from p))")
_sigmoid = lambda t: f"(1 / (1 + exp(-5 * ({t} - 0.5))))"
_kernel("contrast_sigmoid", lambda a: image.contrast_sigmoid(a, 0.5, 2), f"select image_id, row, col, 0 as channel, least(greatest(({_sigmoid('(r - lo) / (hi - lo)')} - {_sigmoid('0')}) / ({_sigmoid('1')} - {_sigmoid('0')}), 0), 1) * (hi - lo) + lo as x from (select *, min(r) over (partition by image_id) as lo, max(r) over (partition by image_id) as hi from p)")
_edge8 = "greatest(sum((case when o.row = c.row and o.col = c.col then -8 else 1 end) * o.k), 0)"
_kernel("laplacian_binary", lambda a: image.laplacian(a, image.LAPLACIAN8, 0.0), f"select image_id, row, col, 0 as channel, case when x > max(x) over (partition by image_id) / 8 then 255 else 0 end as x from (select q.image_id, q.row, q.col, coalesce(e.x, 0) as x from q left join ({_around(_edge8, 1, _edge)}) e using (image_id, row, col))")
_corner = lambda dy, dx: f"(select image_id, row, col, ch, {_three} as x from p, range(3) t(ch)) c{dy}{dx} on c{dy}{dx}.image_id = i and c{dy}{dx}.ch = t.ch and c{dy}{dx}.row = 4 + least(y * 12 // 20 + {dy}, 11) and c{dy}{dx}.col = 4 + least(x_ * 12 // 20 + {dx}, 11)"
_fy, _fx = "(y * 12 % 20 / 20.0)", "(x_ * 12 % 20 / 20.0)"
_kernel("crop_resize", lambda a: image.crop_resize(a, 4, 4, 12, 12, 20, 20), f"select i as image_id, y as row, x_ as col, t.ch as channel, (c00.x * (1 - {_fy}) + c10.x * {_fy}) * (1 - {_fx}) + (c01.x * (1 - {_fy}) + c11.x * {_fy}) * {_fx} as x from range({IMAGES}) a(i) cross join range(20) b(y) cross join range(20) d(x_) cross join range(3) t(ch) join {_corner(0, 0)} join {_corner(0, 1)} join {_corner(1, 0)} join {_corner(1, 1)}")


# Relational forms.
@query(f"with {P}, w as (select image_id, row, col, k, sum(k) over (partition by image_id, row order by col) as s from q) select image_id, row, col, round(sum(s) over (partition by image_id, col order by row), 6) as x from w")
def integral_windows(spark, sf_dir):
    """Summed areas by two running sums: windows of a row, then of a column."""
    k = image.gray_of(F.col("b"), F.col("g"), F.col("r"))
    across, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    out = pixels(spark).withColumn("s", F.sum(k).over(across))
    return out.select("image_id", "row", "col", F.round(F.sum("s").over(down), 6).alias("x"))


_HSV = f"with {P}, m as (select *, greatest(b, g, r) as hi, least(b, g, r) as lo from p), h as (select *, hi - lo as w, case when hi = lo then 0 when hi = r then (g - b) / (hi - lo) * 60 when hi = g then (b - r) / (hi - lo) * 60 + 120 else (r - g) / (hi - lo) * 60 + 240 end as hue from m) select image_id, row, col, round(case when hue < 0 then hue + 360 else hue end, 6) as h, round(case when hi = 0 then 0 else w / hi * 255 end, 6) as s, round(hi, 6) as v from h"


@query(_HSV)
def hsv(spark, sf_dir):
    out = pixels(spark).withColumn("p", image.hsv_of(F.col("b"), F.col("g"), F.col("r")))
    return out.select("image_id", "row", "col", *(F.round(F.col(f"p.{c}") + 0.0, 6).alias(c) for c in "hsv"))


@query(f"with {P} select image_id, row, col, round(b, 4) as b, round(g, 4) as g, round(r, 4) as r from p")
def hsv_round_trip(spark, sf_dir):
    out = pixels(spark).withColumn("p", image.hsv_of(F.col("b"), F.col("g"), F.col("r"))).withColumn("p", image.bgr_of(F.col("p.h"), F.col("p.s"), F.col("p.v")))
    return out.select("image_id", "row", "col", *(F.round(F.abs(F.col(f"p.{c}")), 4).alias(c) for c in "bgr"))


@query(f"with {P} select image_id, row, col, floor((r + g + b) / 3) as c1, floor((r + 255 - b) / 2) as c2, floor((r + 2 * (255 - g) + b) / 4) as c3 from p")
def euclid_color(spark, sf_dir):
    out = pixels(spark).withColumn("p", image.opponent_of(F.col("b"), F.col("g"), F.col("r")))
    return out.select("image_id", "row", "col", "p.c1", "p.c2", "p.c3")


@query(f"with {P} select count(*) as pixels, 0 as off from p")
def euclid_color_round_trip(spark, sf_dir):
    """How many pixels come back off by more than the rounding allows (9 levels)."""
    out = pixels(spark).withColumn("p", image.opponent_of(F.col("b"), F.col("g"), F.col("r"))).withColumn("q", image.bgr_of_opponent(F.col("p.c1"), F.col("p.c2"), F.col("p.c3")))
    off = F.greatest(*(F.abs(F.col(c) - F.col(f"q.{c}")) for c in "bgr")) > 9
    return out.agg(F.count(F.lit(1)).alias("pixels"), F.sum(off.cast("int")).alias("off"))


@query(f"with {P} select image_id, row, col, round(greatest(least(tan(radians(60)) * (floor(g) - 127) + 127, 255), 0), 6) as x from p")
def contrast(spark, sf_dir):
    return pixels(spark).select("image_id", "row", "col", F.round(image.contrast_of(F.col("g"), 60.0), 6).alias("x"))


@query(f"with {P}, w as (select image_id, y, x_, i, j, ch from (select distinct image_id from p), range({ROWS - 8}) a(y), range({COLS - 8}) b(x_), range(8) c(i), range(8) d(j), range(3) t(ch)) select w.image_id, y as row, x_ as col, round(sum({_three}), 6) as total from w join p on p.image_id = w.image_id and p.row = y + i and p.col = x_ + j group by w.image_id, y, x_")
def patch_extract(spark, sf_dir):
    return image.patches(images(spark), 8).select("image_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round(vec.total("v"), 6).alias("total"))


_NEAREST = "select image_id, row, col, arg_min(c, (d, c)) as c from (select image_id, row, col, c, (b - cb) * (b - cb) + (g - cg) * (g - cg) + (r - cr) * (r - cr) as d from p, (values (0, 0, 0, 0), (1, 255, 0, 0), (2, 0, 255, 0), (3, 0, 0, 255)) t(c, cb, cg, cr)) group by image_id, row, col"
_AREAS = f"with recursive {P}, l as materialized ({_NEAREST}), link as materialized (select a.image_id, a.row * {COLS} + a.col as u, o.row * {COLS} + o.col as w from l a join l o on o.image_id = a.image_id and o.c = a.c and abs(o.row - a.row) <= 1 and abs(o.col - a.col) <= 1), reach as (select image_id, row * {COLS} + col as u, row * {COLS} + col as w from l union select r.image_id, r.u, k.w from reach r join link k on k.image_id = r.image_id and k.u = r.w)"


@query(f"{_AREAS}, s as (select image_id, u, count(*) as size from reach group by image_id, u), h as (select l.image_id, l.c + case when s.size > {round(0.1 * np.sqrt(ROWS * COLS))} then 0 else 4 end as n, count(*)::double as x from l join s on s.image_id = l.image_id and s.u = l.row * {COLS} + l.col group by all) select i as image_id, n_ as n, coalesce(x, 0) as x from range({IMAGES}) a(i) cross join range(8) b(n_) left join h on h.image_id = i and h.n = n_")
def ccv(spark, sf_dir):
    """Colour coherence with four centroids: pixels in large areas of each, then in small ones."""
    centroids = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], float)
    made = image.vector_of(images(spark), lambda a: image.colour_coherence(a, centroids))
    return made.select("image_id", F.posexplode("v").alias("n", "x")).select("image_id", F.col("n").cast("bigint").alias("n"), "x")


_cut = lambda at, unit: f"cast(floor(({at}) * {unit}) as int)"
_quarter = lambda dy, dx: f"coalesce(sum(k) filter (q.row >= {_cut(f'cy * 2 + {4 * dy}', ROWS / 32)} and q.row < {_cut(f'cy * 2 + {4 * dy + 4}', ROWS / 32)} and q.col >= {_cut(f'cx * 2 + {4 * dx}', COLS / 32)} and q.col < {_cut(f'cx * 2 + {4 * dx + 4}', COLS / 32)}), 0) as q{dy}{dx}"


@query(f"with {P}, c as (select image_id, cy, cx, {_quarter(0, 0)}, {_quarter(0, 1)}, {_quarter(1, 0)}, {_quarter(1, 1)} from q, range(12) a(cy), range(12) b(cx) group by image_id, cy, cx), d as (select image_id, (cy * 12 + cx) * 8 as first, [q00 + q10 - q01 - q11, q00 + q01 - q10 - q11, q00 - q11, q01 - q10] as d from c) select image_id, first + j as n, round(greatest(case when j % 2 = 0 then 1 else -1 end * d[j // 2 + 1], 0), 6) + 0.0 as x from d, range(8) t(j)")
def rectangle_feature(spark, sf_dir):
    """(image_id, n, x): all 1152 responses of each image."""
    made = image.vector_of(images(spark), image.rectangle_feature)
    return made.select("image_id", F.posexplode("v").alias("n", "x")).select("image_id", F.col("n").cast("bigint").alias("n"), F.round(F.col("x") + 0.0, 6).alias("x"))


def blob_images(spark: SparkSession, size: int = 192) -> DataFrame:
    """Bright and dark discs on gray."""
    y, x = (F.col("id") % (size * size) / size).cast("int"), (F.col("id") % size).cast("int")
    i = (F.col("id") / (size * size)).cast("int")
    disc = lambda cy, cx, r: (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r
    level = F.when(disc(60, 60 + i * 12, 12), 255.0).when(disc(132, 124, 16), 0.0).when(disc(56, 140, 10), 230.0).otherwise(128.0)
    rows = spark.range(2 * size * size).select(i.alias("image_id"), y.alias("row"), x.alias("col"), level.alias("k"))
    return image.to_images(rows, ["k"])


def _points(df: DataFrame) -> DataFrame:
    return df.select("image_id", "k", "y", "x", "radius", "level", F.round("response", 6).alias("response"), F.round("orientation", 6).alias("orientation"), F.size("desc").alias("n"))


@query()
def keypoints(spark, sf_dir):
    return _points(keypoint.keypoints(blob_images(spark)))


@query()
def keypoints_rectangle(spark, sf_dir):
    return _points(keypoint.keypoints(blob_images(spark), keypoint.Params(descriptor="rectangle", min_radius=8.0)))


@query()
def keypoints_dense(spark, sf_dir):
    return _points(keypoint.keypoints(blob_images(spark), grid=[(8.0, 4, 4), (16.0, 2, 2)]))


@query()
def keypoint_matches(spark, sf_dir):
    """Keypoints of one image that another has as well."""
    got = keypoint.keypoints(blob_images(spark)).withColumn("id", (F.col("image_id") * 10_000 + F.col("k")).cast("bigint"))
    return keypoint.matches(got.filter("image_id = 1").select(F.col("id").alias("qid"), F.col("desc").alias("v")), got.filter("image_id = 0").select(F.col("id").alias("m"), F.col("desc").alias("v")))


# Vectors of eight by eight pixels.
def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.images_of(vectors(spark, sf_dir), 8, 8)


_UNIT = "((y * 3 + x * 5 + j * 7) % 11 - 5) / 10.0"


@query(f"with {E}, w as (select y, x, j, {_UNIT} as w from range(3) a(y), range(3) b(x), range(4) c(j)), f as (select m as image_id, py as row, px as col, j as channel, 1 / (1 + exp(-(sum(v[((py + y) * 8 + px + x + 1)::int] * w) + j * 0.1))) as x from e, range(5) p(py), range(5) q(px), w group by m, py, px, j) select image_id, row, col, channel, round(x, 6) + 0.0 as x from f")
def dae_convolution(spark, sf_dir):
    """Feature maps of all vectors as images: the codes of their 3 x 3 patches by an encoder of stated weights."""
    y, x, j = np.mgrid[0:3, 0:3, 0:4]
    encoder = learn.Dae((((y * 3 + x * 5 + j * 7) % 11 - 5) / 10).reshape(9, 4), np.arange(4) * 0.1, np.zeros(9))
    return cells(image.convolve(vector_images(spark, sf_dir), encoder.encode, 3))


@query(f"with {E}, f as (select m as image_id, r, c, greatest(max(v[((r * 2 + y) * 8 + c * 2 + x + 1)::int]) filter (r * 2 + y < 8 and c * 2 + x < 8), 0) as x from e, range(4) a(r), range(4) b(c), range(3) d(y), range(3) f(x) group by m, r, c) select image_id, r as row, c as col, 0::bigint as channel, round(x, 6) + 0.0 as x from f")
def vector_pooling(spark, sf_dir):
    """All vectors as images, pooled by windows of three at every second pixel."""
    return cells(image.apply(vector_images(spark, sf_dir), lambda a: image.max_pooling(a, 3, 2)))


@query(f"with {E} select m as image_id, n % 8 as row, n // 8 as col, 0::bigint as channel, round(v[n + 1], 6) + 0.0 as x from e, range(64) t(n)")
def image_transpose(spark, sf_dir):
    return cells(image.transposed(vector_images(spark, sf_dir)))


@query(f"with {E} select m % 8 * (1 + (select max(m) from e) // 8) + m // 8 as m, round(list_sum(v), 6) as total from e")
def grid_transpose(spark, sf_dir):
    """All vectors as a grid of eight columns, its rows and columns exchanged."""
    rows = vectors(spark, sf_dir)
    last = rows.agg(F.max("m")).first()[0]
    return frame.transpose_grid(rows, 1 + last // 8, 8).select("m", F.round(vec.total("v"), 6).alias("total"))


# Background model.
@query("with f as (select user_id % 8 as camera_id, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as frame_no, value from events) select camera_id, round(avg(value), 6) as mean, round(avg(sqrt(2) * abs(value - m)), 6) as amplitude, count(*) as frames from (select *, avg(value) over (partition by camera_id) as m from f) group by camera_id")
def bgseg_train(spark, sf_dir):
    """Mean and amplitude of one-pixel frames."""
    out = background.train(background.frames_of_events(table(spark, sf_dir, "events")))
    return out.select("camera_id", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("amplitude")[0], 6).alias("amplitude"), "frames")


_FRAMES = "f as materialized (select user_id % 8 as camera_id, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as frame_no, value as x from events), m as (select camera_id, avg(x) as u from f group by camera_id), a as (select camera_id, any_value(u) as u, avg(sqrt((x - u) * (x - u) * 2.0)) as a from f join m using (camera_id) group by camera_id)"
_IN = "(s.u - s.a - 10 <= f.x and f.x <= s.u + s.a + 10)"


@query(f"with recursive {_FRAMES}, s as (select camera_id, -1::bigint as frame_no, u, a, 0 as mask from a union all select s.camera_id, f.frame_no, case when {_IN} then s.u + 0.05 * (f.x - s.u) else s.u end, s.a + case when {_IN} then 0.05 else 0.0125 end * (sqrt(2 * (f.x - s.u) * (f.x - s.u)) - s.a), case when {_IN} then 0 else 1 end from s join f on f.camera_id = s.camera_id and f.frame_no = s.frame_no + 1) select camera_id, count(*) as frames, sum(mask)::bigint as foreground from s where frame_no >= 0 group by camera_id")
def bgseg_fold(spark, sf_dir):
    """The model run over every camera's frames in order: how often a pixel was foreground."""
    frames = background.frames_of_events(table(spark, sf_dir, "events"))
    masks = background.segment(frames, background.train(frames))
    return masks.groupBy("camera_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("mask")[0]).alias("foreground"))
