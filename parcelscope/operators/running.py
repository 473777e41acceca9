"""The nearest earlier value within a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def last_before(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, low: int, high: int, ranges: int = RANGES
) -> DataFrame:
    """Adds ``name``: the ``value`` of the row with the greatest smaller ``order`` among rows of the same keys that have one.

    ``order`` is a whole number, for most rows from ``low`` to ``high``, which is cut into ``ranges``; a window looks back within the rows of one key and
    range, and a second one over the last value of each range, of which a key has at most ``ranges``. So a key that
    holds most rows is spread over tasks. Of equal orders none is before the other; nulls in keys are equal.
    """
    width = max(1, -(-(high - low + 1) // ranges))
    place = F.floor((F.least(F.greatest(F.col(order), F.lit(low - 1)), F.lit(high + 1)) - low) / width).cast("long")
    cut = df.withColumn("_cut", place).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_cut").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*[f"_of_{key}" for key in keys]).orderBy("_of_cut").rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order)))
    ends = cut.groupBy(*[F.col(key).alias(f"_of_{key}") for key in keys], F.col("_cut").alias("_of_cut")).agg(at_end.alias("_end"))
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(back)).drop("_end")
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    here = cut.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
    # merged and not broadcast: rounds of calls would bring the last values to the driver each time
    found = here.join(carried.hint("merge"), [*same, F.col("_cut") == F.col("_of_cut")], "left")
    return found.withColumn(name, F.coalesce("_here", "_carried")).select(*df.columns, name)
