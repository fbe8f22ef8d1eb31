"""Column expressions over fixed-length vectors (ARRAY<DOUBLE>): element-wise operations and reductions.

All of them are built-in higher-order functions, so rows never leave the JVM. Sums run from left to right, comparisons
skip NaN, and division follows IEEE 754 although ANSI mode is on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def col(v: Vector) -> Column:
    return F.col(v) if isinstance(v, str) else v


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def as_vector(v: Vector) -> Column:
    return col(v).cast("array<double>")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN instead of an error for b = 0."""
    sign = F.when(F.signum(F.lit(1.0) * a) > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, sign).otherwise(F.try_divide(a, b))


def sign(x: Column) -> Column:
    """+1 from zero on, else -1."""
    return F.when(x >= 0, 1.0).otherwise(-1.0)


def sign_strict(x: Column) -> Column:
    """+1 above zero, else -1."""
    return F.when(x > 0, 1.0).otherwise(-1.0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def trunc(x: Column) -> Column:
    """Towards zero."""
    return x.cast("double").cast("bigint").cast("double")


def round_half(x: Column) -> Column:
    """x + 0.5, cut towards zero."""
    return trunc(x + 0.5)


def log2(x: Column) -> Column:
    return F.ln(x) / F.ln(F.lit(2.0))


def popcount(x: Column) -> Column:
    return F.bit_count(x)


# Element-wise, one vector.
def each(v: Vector, f) -> Column:
    return F.transform(col(v), f)


def vsqrt(v: Vector) -> Column:
    return each(v, F.sqrt)


def vnot(v: Vector) -> Column:
    return each(v, lambda x: F.when(x != 0, 0.0).otherwise(1.0))


def vpow(v: Vector, exponent: float) -> Column:
    return each(v, lambda x: F.pow(x, num(exponent)))


def vinv(v: Vector) -> Column:
    return each(v, lambda x: ieee_div(F.lit(1.0), x))


def adds(v: Vector, c: float | Column) -> Column:
    return each(v, lambda x: x + num(c))


def subs(v: Vector, c: float | Column) -> Column:
    return each(v, lambda x: x - num(c))


def muls(v: Vector, c: float | Column) -> Column:
    return each(v, lambda x: x * num(c))


def divs(v: Vector, c: float | Column) -> Column:
    return each(v, lambda x: ieee_div(x, num(c)))


def clip(v: Vector, low: float, high: float) -> Column:
    return each(v, lambda x: F.greatest(F.least(x, num(high)), num(low)))


def fill(v: Vector, c: float) -> Column:
    return F.array_repeat(num(c), F.size(col(v)))


def in_range(v: Vector, lower: Vector, upper: Vector) -> Column:
    """1 where lower <= x <= upper, else 0."""
    zipped = F.arrays_zip(col(lower).alias("lo"), col(v).alias("x"), col(upper).alias("hi"))
    return F.transform(zipped, lambda t: F.when((t["lo"] <= t["x"]) & (t["x"] <= t["hi"]), 1.0).otherwise(0.0))


def subs_masked(dest: Vector, v: Vector, c: float, mask: Vector) -> Column:
    """v - c where the mask is not zero; elsewhere the element of `dest`."""
    zipped = F.arrays_zip(col(dest).alias("d"), col(v).alias("x"), col(mask).alias("m"))
    return F.transform(zipped, lambda t: F.when(t["m"] != 0, t["x"] - num(c)).otherwise(t["d"]))


# Element-wise, two vectors.
def both(a: Vector, b: Vector, f) -> Column:
    return F.zip_with(col(a), col(b), f)


def add(a: Vector, b: Vector) -> Column:
    return both(a, b, lambda x, y: x + y)


def sub(a: Vector, b: Vector) -> Column:
    return both(a, b, lambda x, y: x - y)


def mul(a: Vector, b: Vector) -> Column:
    return both(a, b, lambda x, y: x * y)


def div(a: Vector, b: Vector) -> Column:
    return both(a, b, ieee_div)


def vmax(a: Vector, b: Vector) -> Column:
    return both(a, b, lambda x, y: F.when(x > y, x).otherwise(y))


def vmin(a: Vector, b: Vector) -> Column:
    return both(a, b, lambda x, y: F.when(x < y, x).otherwise(y))


def equal(a: Vector, b: Vector) -> Column:
    """Whether all elements are equal; NaN equals nothing."""
    return F.forall(both(a, b, lambda x, y: (x == y) & ~F.isnan(x)), lambda x: x)


# Reductions.
def fold(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), f)


def dot(a: Vector, b: Vector) -> Column:
    return fold(mul(a, b), lambda s, x: s + x)


def total(v: Vector) -> Column:
    return fold(col(v), lambda s, x: s + x)


def norm1(v: Vector) -> Column:
    return fold(col(v), lambda s, x: s + F.abs(x))


def norm(v: Vector) -> Column:
    return F.sqrt(fold(col(v), lambda s, x: s + x * x))


def mean(v: Vector) -> Column:
    return total(v) / F.size(col(v))


def variance(v: Vector, about: Column | None = None) -> Column:
    """Sample variance of the elements, about their mean or a given one; of one element 0."""
    mu = mean(v) if about is None else about
    return F.aggregate(col(v), F.struct(F.lit(0.0).alias("s"), mu.alias("u")), lambda a, x: F.struct((a["s"] + (x - a["u"]) * (x - a["u"])).alias("s"), a["u"].alias("u")), lambda a: a["s"] / F.greatest(F.size(col(v)) - 1, F.lit(1)))


def _numbers(v: Vector) -> Column:
    return F.filter(col(v), lambda x: ~F.isnan(x))


def maximum(v: Vector) -> Column:
    return F.array_max(_numbers(v))


def minimum(v: Vector) -> Column:
    return F.array_min(_numbers(v))


def absmax(v: Vector) -> Column:
    return F.array_max(F.transform(_numbers(v), F.abs))


def argmax(v: Vector) -> Column:
    """The first place (from 0) of the largest element; -1 if there is none."""
    return (F.coalesce(F.array_position(col(v), maximum(v)), F.lit(0)) - 1).cast("int")


def argmin(v: Vector) -> Column:
    return (F.coalesce(F.array_position(col(v), minimum(v)), F.lit(0)) - 1).cast("int")


def max_pair(v: Vector) -> Column:
    return F.struct(argmax(v).alias("i"), maximum(v).alias("f"))


def min_pair(v: Vector) -> Column:
    return F.struct(argmin(v).alias("i"), minimum(v).alias("f"))


def _place(flags: Column, start: int) -> Column:
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1 + start).otherwise(-1).cast("int")


def nonzero_index(v: Vector, start: int, end: int) -> Column:
    """The first place in [start, end) that is not zero, else -1."""
    return _place(F.transform(F.slice(col(v), start + 1, end - start), lambda x: x != 0), start)


def find_index(v: Vector, start: int, end: int, key: float) -> Column:
    """The first place in [start, end) that equals `key`, else -1."""
    return _place(F.transform(F.slice(col(v), start + 1, end - start), lambda x: x == num(key)), start)


# Scaling of single vectors.
def normalize_l1(v: Vector) -> Column:
    return F.when(norm1(v) != 0, _scaled(v, norm1(v))).otherwise(col(v))


def normalize_l2(v: Vector) -> Column:
    return F.when(norm(v) != 0, _scaled(v, norm(v))).otherwise(col(v))


def _scaled(v: Vector, by: Column) -> Column:
    # The divisor is worked out once: it rides in a one-element array through the transform.
    return F.flatten(F.transform(F.array(by), lambda s: F.transform(col(v), lambda x: F.try_divide(x, s))))


def normalize_shift(v: Vector, low: float, high: float, epsilon: float = 1.1920929e-07) -> Column:
    """Moved and stretched to [low, high]; a constant vector stays as it is."""
    ends = F.array(F.struct(minimum(v).alias("lo"), maximum(v).alias("hi")))
    moved = F.flatten(F.transform(ends, lambda e: F.transform(col(v), lambda x: (x - e["lo"]) * F.try_divide(F.lit(float(high - low)), e["hi"] - e["lo"]) + num(low))))
    return F.when(maximum(v) - minimum(v) > epsilon, moved).otherwise(col(v))


def standardize(v: Vector, mu: Vector, sd: Vector) -> Column:
    return div(sub(v, mu), sd)


def standardize_local(v: Vector, epsilon: float) -> Column:
    """Each vector by its own mean and sqrt(variance + epsilon)."""
    own = F.array(F.struct(mean(v).alias("u"), F.sqrt(variance(v) + epsilon).alias("s")))
    return F.flatten(F.transform(own, lambda t: F.transform(col(v), lambda x: ieee_div(x - t["u"], t["s"]))))


# Distances.
def euclidean2(a: Vector, b: Vector) -> Column:
    return fold(both(a, b, lambda x, y: (x - y) * (x - y)), lambda s, x: s + x)


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(euclidean2(a, b))


def cosine(a: Vector, b: Vector) -> Column:
    """1 - cosine; 2 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 2.0).otherwise(1.0 - F.try_divide(dot(a, b), size))


def histogram_intersection(a: Vector, query: Vector) -> Column:
    """1 - sum of the lesser elements / sum of the query; 1 if that sum is 0."""
    common = fold(both(a, query, lambda x, y: F.least(x, y)), lambda s, x: s + x)
    return F.when(total(query) == 0, 1.0).otherwise(1.0 - F.try_divide(common, total(query)))


DISTANCES = {"euclidean2": euclidean2, "euclidean": euclidean, "cosine": cosine, "histogram_intersection": histogram_intersection}


# Shapes.
def element(v: Vector, n: int) -> Column:
    return F.get(col(v), F.lit(n))


def reshape(v: Vector, width: int) -> Column:
    """A vector as an array of vectors of `width` elements."""
    v = col(v)
    return F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))


def row_of(m: Column, cols: int) -> Column:
    return F.floor(m / cols).cast("bigint")


def col_of(m: Column, cols: int) -> Column:
    return F.pmod(m, F.lit(cols)).cast("bigint")


def index_of(row: Column, column: Column, cols: int) -> Column:
    return (row * cols + column).cast("bigint")
