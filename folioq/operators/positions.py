"""Places and running sums in an order, where a group may have any number of rows.

A window over a group sorts it in one task. Here the whole table is sorted by range, so a large group is cut into several
partitions; what a partition needs to know of those before it are a few sums, a row for each group and partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioq.operators.recurse import kept

PART, AT = "_part", "_at"


def _sorted(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df sorted by group and order, with each row's partition and its place in that; written, so that both stay."""
    rows = kept(df.orderBy(*by, *order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    return rows.select(*df.columns, F.shiftright("_m", 33).alias(PART), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias(AT))


def _with_before(rows: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """rows with the sum of value over their group's earlier partitions, and the group's first place in their own."""
    own = rows.groupBy(*by, PART).agg(F.min(AT).alias("_first"), F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    info = own.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col(PART).alias("_b_part"), "_first", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(out))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.col(PART) == F.col("_b_part"))
    return rows.join(info, same).drop(*[f"_b_{c}" for c in by], "_b_part")


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "place") -> DataFrame:
    """df with each row's place (from 0) in its group."""
    rows = _with_before(_sorted(df, by, order), by, F.lit(1), "_before")
    return rows.withColumn(out, (F.col("_before") + F.col(AT) - F.col("_first")).cast("long")).select(*df.columns, out)


def summed_before(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, out: str = "before") -> DataFrame:
    """df with the sum of what comes before each row in its group."""
    rows = _with_before(_sorted(df, by, order), by, F.col(value), "_before")
    here = Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(here), F.lit(0))).select(*df.columns, out)
