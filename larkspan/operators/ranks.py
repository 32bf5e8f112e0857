"""Gapless numbers within groups that no task has to hold as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str) -> DataFrame:
    """Add `out`: the row's number from 0 within `group`, by `bucket` and then by `order`.

    `bucket` must not fall along `order`. A task sorts one bucket of one group; the buckets' counts, a small table, are
    summed up over the buckets before. Null group values are a group of their own.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & local[k].eqNullSafe(offsets[f"_k{i}"])
    return local.join(offsets, same).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_bucket", *[f"_k{i}" for i in range(len(keys))])
