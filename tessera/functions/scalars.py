"""Scalar and set functions as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# strings


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_int(text: Column) -> Column:
    """Null where the text is no whole number."""
    return text.try_cast("long")


def parse_double(text: Column) -> Column:
    return text.try_cast("double")


# word distances


def hamming(x: Column, y: Column) -> Column:
    """Mismatches of two equally long words."""
    return F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (~a.eqNullSafe(b)).cast("int")), F.lit(0), lambda s, d: s + d)


def dna_distance(x: Column, y: Column) -> Column:
    """Mismatches; n matches nothing."""
    return F.aggregate(F.zip_with(F.split(F.lower(x), ""), F.split(F.lower(y), ""), lambda a, b: F.when((a == b) & (a != "n"), 0).otherwise(1)), F.lit(0), lambda s, d: s + d)


def dna_packed_distance(x: Column, y: Column, k: int) -> Column:
    """k minus the matches of two four-bit codes."""
    return F.lit(k) - F.bit_count(x.bitwiseAND(y))


def embedded_distance(x: Column, y: Column) -> Column:
    """Of two dual bit embeddings (longs): half the differing bits."""
    return F.shiftright(F.bit_count(x.bitwiseXOR(y)), 1)


def matrix_distance(x: Column, y: Column, dist: dict[tuple[str, str], int]) -> Column:
    """Sum of symbol distances by a map literal; for single pairs.  Bulk work goes through the block kernel."""
    table = F.create_map(*[v for (a, b), d in dist.items() for v in (F.lit(a + b), F.lit(d))])
    return F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: F.element_at(table, F.concat(a, b))), F.lit(0), lambda s, d: s + d)


# sets as sorted arrays of distinct values; bit sets as arrays of longs


def as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def jaccard(x: Column, y: Column) -> Column:
    """Size of the intersection over size of the union; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def bits_of(values: Column, words: int) -> Column:
    """A set of numbers under 64 * words as an array of longs."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(F.filter(values, lambda v: F.floor(v / 64) == w), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (v % 64).cast("int")))))


def _over(x: Column, y: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(op(a, b))), F.lit(0), lambda s, n: s + n)


def bits_and(x: Column, y: Column) -> Column:
    return _over(x, y, lambda a, b: a.bitwiseAND(b))


def bits_or(x: Column, y: Column) -> Column:
    return _over(x, y, lambda a, b: a.bitwiseOR(b))


def bits_hamming(x: Column, y: Column) -> Column:
    return _over(x, y, lambda a, b: a.bitwiseXOR(b))


def bits_similarity(x: Column, y: Column) -> Column:
    """Jaccard of bit sets; 0 where the union is empty."""
    return F.coalesce(bits_and(x, y) / F.nullif(bits_or(x, y), F.lit(0)), F.lit(0.0))


def equal_bits(x: Column, y: Column, length: int) -> Column:
    """Share of equal bits of two dense signatures of `length` bits."""
    return (length - bits_hamming(x, y)) / length


def bits_union(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseOR(b))


def bits_intersect(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseAND(b))


def bits_remove(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))


def bits_complement(x: Column) -> Column:
    return F.transform(x, lambda a: F.bitwise_not(a))


def cardinality(x: Column) -> Column:
    return F.aggregate(F.transform(x, lambda a: F.bit_count(a)), F.lit(0), lambda s, n: s + n)


# numbers


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def one_minus_exp(x: Column) -> Column:
    """1 - e^x without cancellation near 0."""
    return -F.expm1(x)


def at_least_one_of(p: Column, n: int) -> Column:
    """1 - (1 - p)^n, exact for small p."""
    return -F.expm1(n * F.log1p(-p))
