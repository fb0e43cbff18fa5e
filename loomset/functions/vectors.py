"""Vector expressions over arrays of doubles, inside the row and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.binding import let

#: A norm below this counts as this, so a zero vector stays zero.
LEAST_NORM = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(v: Column) -> Column:
    return let(v, lambda w: let(1.0 / F.greatest(norm(w), F.lit(LEAST_NORM)), lambda by: scale(w, by)))


def cosine(a: Column, b: Column) -> Column:
    length = lambda v: F.greatest(norm(v), F.lit(LEAST_NORM))
    return let(a, lambda x: let(b, lambda y: dot(x, y) / (length(x) * length(y))))


def mean_of(v: Column) -> Column:
    return total(v) / F.size(v)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Without affine part; the variance is that of the values themselves."""
    centred = lambda w: let(mean_of(w), lambda m: F.transform(w, lambda x: x - m))
    return let(v, lambda w: let(centred(w), lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda s: F.transform(c, lambda x: x / s))))


def top_places(v: Column, k: int, by_size: bool = True) -> Column:
    """Places, from 0, of the k largest values (or largest in size); of equal ones the first."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x) if by_size else -x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def keep_top(v: Column, k: int, by_size: bool = True) -> Column:
    """The vector with all but its k largest values at 0."""
    return let(v, lambda w: let(top_places(w, k, by_size), lambda kept: F.transform(w, lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(F.lit(0.0)))))


def top_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of the k largest places that two vectors have in common."""
    n = F.least(F.lit(k), F.size(a), F.size(b))
    return F.size(F.array_intersect(top_places(a, k), top_places(b, k))) / n


def apply_matrix(v: Column, rows: Column) -> Column:
    """``v`` times a matrix given by its columns: one value for each of ``rows``."""
    return let(v, lambda w: F.transform(rows, lambda r: dot(w, r)))


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def last_position(states: Column, mask: Column) -> Column:
    """Of token vectors, the last that the mask holds; the first if it holds none."""
    return F.element_at(states, F.greatest(F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.lit(1)))


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask holds."""
    count = F.greatest(F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.lit(1))
    zero = F.transform(F.get(states, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(F.arrays_zip(states.alias("s"), mask.alias("m")), zero, lambda a, t: F.zip_with(a, t["s"], lambda x, y: x + y * t["m"]))
    return let(count, lambda n: F.transform(summed, lambda x: x / n))


def gaussian(key: Column, i: Column) -> Column:
    """A standard normal number fixed by a key and a place, wherever the row is computed."""
    u = lambda salt: (F.conv(F.substring(F.sha2(F.concat_ws(":", key, i.cast("string"), F.lit(salt)), 256), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(F.least(u("a"), F.lit(1.0)))) * F.cos(2.0 * 3.141592653589793 * u("b"))


def gaussian_vector(key: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: gaussian(key, i))
