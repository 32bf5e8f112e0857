"""Roll-ups of a register's rows: the newest of each key, and one value of many or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, key: str, order: list[str], fill: list[str] = ()) -> DataFrame:
    """The newest row of each key by `order`, greatest first; blank `fill` columns are taken from the newest row that has them."""
    by = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_nth", F.row_number().over(by)).withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in fill})
    return rows.filter("_nth = 1").drop("_nth")


def only_value(column: Column) -> Column:
    """The one distinct value of a group, null if there are several or none."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def joined_ids(column: Column, most: int = 255) -> Column:
    """The distinct values in order, by semicolons; null if that is longer than `most`."""
    text = F.array_join(F.array_sort(F.collect_set(column)), ";")
    return F.when(F.length(text) <= most, text)
