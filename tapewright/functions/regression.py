"""Least squares by group: products summed in one aggregate, then solved inside expressions.

A table's products of columns, in rows of m, are a symmetric matrix. An exchange step on a pivot
column turns it into the matrix in which that column explains the others; after steps on all
regressors, the last column holds the coefficients, the last cell the sum of squared residuals, and
the square of the regressors the inverse of their products. A second step on a pivot undoes the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def products(columns: list[Column], weight: Column | None = None) -> Column:
    """An aggregate: all sums of products of two columns, row after row; the first column is usually F.lit(1.0)."""
    m = len(columns)
    sums = {(i, j): F.sum(columns[i] * columns[j] * (1.0 if weight is None else weight)) for i in range(m) for j in range(i, m)}
    return F.array(*[sums[min(i, j), max(i, j)] for i in range(m) for j in range(m)])


def exchanged(a: Column, p: Column, m: int) -> Column:
    """The matrix after a step on column p; null cells where the pivot is 0."""
    pivot = F.get(a, p * m + p)

    def cell(q: Column) -> Column:
        j = q % m
        i = ((q - j) / m).cast("int")
        row, column = F.get(a, p * m + j), F.get(a, i * m + p)
        inside = F.get(a, q) - F.try_divide(row * column, pivot)
        return F.when((i == p) & (j == p), F.try_divide(F.lit(1.0), pivot)).when(i == p, F.try_divide(row, pivot)).when(j == p, -F.try_divide(column, pivot)).otherwise(inside)

    return F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), cell)


def solved(a: Column, m: int, pivots: int | None = None) -> Column:
    """The matrix after steps on its first `pivots` columns, all but the last by default."""
    steps = F.sequence(F.lit(0), F.lit((m - 1 if pivots is None else pivots) - 1))
    return F.aggregate(steps, a, lambda x, p: exchanged(x, p, m))


def coefficient(a: Column, i: int, m: int) -> Column:
    return F.get(a, F.lit(i * m + m - 1))


def cell(a: Column, i: int, j: int, m: int) -> Column:
    return F.get(a, F.lit(i * m + j))


def spread(sums: Column, i: int, m: int) -> Column:
    """Deviation, times the root of the rows, of column i of the products of a table whose first column is 1."""
    return F.sqrt(F.greatest(cell(sums, i, i, m) - F.try_divide(cell(sums, 0, i, m) * cell(sums, 0, i, m), cell(sums, 0, 0, m)), F.lit(0.0)))
