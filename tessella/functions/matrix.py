"""3 x 3 matrices as arrays of nine numbers, row by row (L1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.binding import let


def _cells(m: Column) -> list[Column]:
    return [F.get(m, F.lit(i)).cast("double") for i in range(9)]


def _determinant(cells: list[Column]) -> Column:
    a, b, c, d, e, f, g, h, i = cells
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def determinant(m: Column) -> Column:
    return let(m, lambda x: _determinant(_cells(x)))


def _inverse(m: Column) -> Column:
    a, b, c, d, e, f, g, h, i = cells = _cells(m)
    adjugate = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return let(_determinant(cells), lambda det: F.when(det != 0, F.array(*[x / det for x in adjugate])))


def invert(m: Column) -> Column:
    """The inverse; null where the determinant is 0."""
    return let(m, _inverse)


def multiply(m: Column, n: Column) -> Column:
    """The product of two matrices."""
    row = lambda a, b: [sum((a[3 * r + k] * b[3 * k + c] for k in range(1, 3)), a[3 * r] * b[c]) for r in range(3) for c in range(3)]
    return let(m, lambda x: let(n, lambda y: F.array(*row(_cells(x), _cells(y)))))
