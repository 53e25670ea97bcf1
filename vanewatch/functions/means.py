"""Means that do not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holds readings below 1e14 with up to 14 decimals; Spark sums it with ten digits more.
EXACT = "decimal(28, 14)"


def exact_mean(name: str) -> Column:
    """Mean of a double column: an exact sum, rounded to a double once, over the count.

    A sum of doubles rounds after every row, so its last bits follow the order of rows, and a mean
    halfway between two rounded values may fall to either side. A group with a value that the
    decimal does not hold exactly (long fractions, huge numbers, NaN, infinities) keeps ``avg``.
    """
    value = F.col(name)
    held = value.try_cast(EXACT)
    whole = F.bool_and(value.isNull() | held.cast("double").eqNullSafe(value))
    return F.coalesce(F.when(whole, F.try_sum(held).cast("double") / F.nullif(F.count(held), F.lit(0))), F.avg(value))
