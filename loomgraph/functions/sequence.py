"""Sequences as expressions: codes of permutations, common subsequences, distance of step lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the set of steps, of their counts and of their order in the likeness of two step lists.
SET, COUNTS, ORDER = 0.38, 0.32, 0.30


def inversions(permutation: Column) -> Column:
    """For each value i of a permutation of 0..n-1, how many larger values stand before it. Empty stays empty."""
    ahead = lambda i: F.slice(permutation, 1, F.array_position(permutation, i) - 1)
    return F.transform(F.array_sort(permutation), lambda i: F.size(F.filter(ahead(i), lambda x: x > i)))


def permutation(inversions_: Column) -> Column:
    """The permutation of an inversion code: from the largest value down, each goes in behind as many larger ones as its code says."""
    descending = F.reverse(F.transform(inversions_, lambda n, i: F.struct(i.alias("value"), n.alias("behind"))))
    start = F.slice(F.transform(inversions_, lambda n, i: i), 1, 0)
    return F.aggregate(descending, start, lambda made, x: F.concat(F.slice(made, 1, x["behind"]), F.array(x["value"]), F.slice(made, x["behind"] + 1, F.size(made))))


def common_order(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, a row of the usual table at a time; for short lists, as the work is the product of their lengths."""

    def next_row(row: Column, x: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            longer = F.greatest(F.element_at(row, j + 1), F.element_at(made, -1))
            return F.concat(made, F.array(F.when(F.element_at(b, j) == x, F.element_at(row, j) + 1).otherwise(longer)))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    table = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), next_row, lambda row: F.element_at(row, -1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(table)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the intersection as multisets."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def sequence_distance(a: Column, b: Column) -> Column:
    """Distance in [0, 1] of two step lists at four digits; two empty ones are alike."""
    longest = F.greatest(F.size(a), F.size(b))
    sets = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    counts = 2.0 * shared_count(a, b) / (F.size(a) + F.size(b))
    like = sets * SET + counts * COUNTS + common_order(a, b) / longest * ORDER
    return F.when(longest == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - like)), 4))
