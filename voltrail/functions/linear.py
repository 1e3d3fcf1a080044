"""Linear systems as column expressions: one small system in each row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def eliminated(system: Column, size: int) -> Column:
    """A positive definite system, given as rows of coefficients with right sides last, in diagonal form.

    Elimination without pivoting, which such systems do not need. A system that is singular gives nulls or NaN.
    """
    def cleared(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)
        return F.transform(rows, lambda row, i: F.when(i == k, row).otherwise(
            _less(row, pivot, F.get(row, k) / F.nullif(F.get(pivot, k), F.lit(0.0)))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, cleared)


def solution(diagonal: Column, size: int, right: int = 0) -> Column:
    """The unknowns for one of the right sides of an eliminated system."""
    return F.transform(diagonal, lambda row, i: F.get(row, F.lit(size + right)) / F.nullif(F.get(row, i), F.lit(0.0)))


def _less(row: Column, pivot: Column, factor: Column) -> Column:
    return F.zip_with(row, F.transform(pivot, lambda v: v * factor), lambda a, b: a - b)


def with_penalty(system: Column, penalty: Column) -> Column:
    """Adds a penalty for each unknown to the diagonal (ridge)."""
    return F.transform(system, lambda row, i: F.transform(
        row, lambda v, j: F.when(i == j, v + F.get(penalty, i)).otherwise(v)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)
