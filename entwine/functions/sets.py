"""Similarities of strings as sets. Sizes and overlaps come from array functions, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(c: Column, n: int, whole: bool = True) -> Column:
    """The set of n-grams of a string; a shorter one is its only gram (none, unless whole), an empty one has none."""
    length = F.char_length(c)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(length - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    return F.when(length == 0, F.array().cast("array<string>")).when(length < n, F.array(c) if whole else F.array().cast("array<string>")).otherwise(grams)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _guarded(na: Column, nb: Column, ratio: Column, both_empty: float) -> Column:
    return F.when((na == 0) & (nb == 0), both_empty).when((na == 0) | (nb == 0), 0.0).otherwise(ratio)


def _sized(a: Column, b: Column, ratio: Column, both_empty: float) -> Column:
    return _guarded(F.size(a), F.size(b), ratio, both_empty)


def dice(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    return _sized(a, b, 2.0 * overlap(a, b) / (F.size(a) + F.size(b)), both_empty)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    both = overlap(a, b)
    return _sized(a, b, both / (F.size(a) + F.size(b) - both), both_empty)


def jaccard_of(na: Column, nb: Column, both: Column, both_empty: float = 1.0) -> Column:
    """jaccard() of sets of known sizes and overlap."""
    return _guarded(na, nb, both / (na + nb - both), both_empty)


def containment(a: Column, b: Column) -> Column:
    return _sized(a, b, overlap(a, b) / F.least(F.size(a), F.size(b)), 0.0)


def share_or_one(n: Column, both: Column) -> Column:
    """The part of a set of n members that another has; an empty one is contained in any."""
    return F.when(n == 0, 1.0).otherwise(both / F.greatest(n, F.lit(1)))


def share_of(a: Column, b: Column) -> Column:
    """The part of a that b has."""
    return overlap(a, b) / F.greatest(F.size(a), F.lit(1))
