"""Column helpers with the null rules that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_to_next(n: Column, marks: Sequence[int], beyond: float) -> Column:
    """Distance to the next mark above ``n``; ``beyond`` past the last; null stays null."""
    out = F.when(n.isNull(), F.lit(None).cast("double"))
    for m in marks:
        out = out.when(n < m, (F.lit(m) - n).cast("double"))
    return out.otherwise(F.lit(float(beyond)))


def bins(value: Column, edges: Sequence[float]) -> Column:
    """Index of the right-open interval [edges[i], edges[i+1]) that holds the value; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
        out = out.when((value >= a) & (value < z), F.lit(i))
    return out


def clip(value: Column, low: float, high: float) -> Column:
    """Clipped; null stays null, which greatest and least alone would lose."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def flag(condition: Column) -> Column:
    """1.0 / 0.0, and 0.0 where the comparison is null."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))
