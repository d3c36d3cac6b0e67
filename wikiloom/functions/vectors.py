"""Vector functions on array<double>, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stand-in embedding.
DUMMY_DIMS, DUMMY_STEP, DUMMY_SCALE = 768, 7919, 10000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` computed once, where the body is a lambda that would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a null vector, unequal lengths or a zero vector."""
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b))
    return F.when(bad, 0.0).otherwise(let(norm(a) * norm(b), lambda scale: F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)))


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; unequal lengths are an error, a zero vector gives NaN."""
    ok = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length"))).otherwise(norm(a) * norm(b))
    return F.when(ok == 0, F.lit(float("nan"))).otherwise(dot(a, b) / ok)


def sql_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null in, null out; of unequal lengths the tail counts in the norm only; 0 for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def l2_normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def stored_vector(a: Column) -> Column:
    """A vector as tables hold it: single precision, half the bytes; computations cast it back."""
    return a.cast("array<float>")


def string_hash(c: Column) -> Column:
    """The absolute value of the 32-bit rolling hash h = 31 h + unit over UTF-16 units, as long.

    Characters beyond the basic plane count as their two surrogates.
    """
    units = F.flatten(
        F.transform(
            F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")),
            lambda p: F.when(p > 65535, F.array(F.lit(55296) + F.floor((p - 65536) / 1024), F.lit(56320) + (p - 65536) % 1024)).otherwise(F.array(p)),
        )
    )
    folded = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: F.pmod(h * 31 + u, F.lit(4294967296)))
    return F.abs(F.when(folded >= 2147483648, folded - 4294967296).otherwise(folded))


def dummy_embedding(c: Column, dims: int = DUMMY_DIMS) -> Column:
    """A deterministic stand-in for a model's embedding: unit vector of fractions of sines of the text's hash."""
    waves = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.sin((h + i * DUMMY_STEP).cast("double")) * DUMMY_SCALE)
    return l2_normalize(F.transform(let(string_hash(c), waves), lambda x: (x - F.floor(x)) * 2 - 1))
