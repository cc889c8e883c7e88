"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column, dim: int) -> Column:
    """``a`` in double precision and of unit length; null where it is zero or of another length."""
    doubles = F.transform(a, lambda x: x.cast("double"))
    with_size = F.transform(F.array(doubles), lambda v: F.struct(v.alias("v"), dot(v, v).alias("s")))
    return F.transform(with_size, lambda x: F.when((F.size(x["v"]) == dim) & (x["s"] > 0), F.zip_with(x["v"], F.array_repeat(F.sqrt(x["s"]), dim), lambda y, r: y / r)))[0]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def hashed_terms(text: Column, dim: int) -> Column:
    """A deterministic stand-in for an embedding: counts of hashed terms, of unit length. No model is behind it."""
    return hashed_tokens(tokens(text), dim)


def hashed_tokens(terms: Column, dim: int) -> Column:
    slots = F.transform(terms, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    spread = lambda ss: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(ss) - F.size(F.array_remove(ss, i))).cast("double"))
    # one-element arrays bind a value to a name, so that it is computed once
    counts = F.transform(F.array(slots), spread)[0]
    unit = lambda c, n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)
    return F.transform(F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), norm(c).alias("n"))), lambda x: unit(x["c"], x["n"]))[0]
