"""Differences between proposed and held key/value tags, and what may be written of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import same_value


def update_ops(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """key, k, op (add, mod), v, was: proposed tags (key, k, v, add_only) against the held ones (key, k, v).

    A key that the object lacks is added; one with another value is modified unless it is add-only.
    """
    held = current.select("key", "k", F.col("v").alias("was"))
    both = proposed.join(held, ["key", "k"], "left")
    op = F.when(F.col("was").isNull(), "add").when(~F.col("add_only") & ~same_value(F.col("k"), F.col("v"), F.col("was")), "mod")
    return both.withColumn("op", op).filter(F.col("op").isNotNull()).select("key", "k", "op", "v", "was")


def address_ops(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Address parts are all or nothing: if one held part differs, none is written; else the missing ones are added."""
    ops = proposed.join(current.select("key", "k", F.col("v").alias("was")), ["key", "k"], "left")
    differs = F.col("was").isNotNull() & ~same_value(F.col("k"), F.col("v"), F.col("was"))
    ops = ops.withColumn("away", F.max(differs).over(Window.partitionBy("key")))
    return ops.filter(~F.col("away") & F.col("was").isNull()).select("key", "k", F.lit("add").alias("op"), "v")


def disputed(ops: DataFrame) -> DataFrame:
    """element and k that several records would write different values to, with how many."""
    found = ops.groupBy("element", "k").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high")
    several = ops.join(found, ["element", "k"]).groupBy("element", "k", "low", "high").agg(F.count_distinct("v").alias("n_values"))
    return several.select("element", "k", "n_values", "low", "high")


def apply_ops(current: Column, written: Column, deleted: Column) -> Column:
    """The tags of an object after its ops: a map without the deleted keys, and with the written ones over the held ones."""
    kept = F.map_filter(current, lambda k, v: ~F.map_contains_key(written, k) & ~F.array_contains(deleted, k))
    return F.map_concat(kept, written)


def record_blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, value, constant: which columns of a record's rows are one value, and that value (null: varying)."""
    values = lambda c: F.col(c).cast("string")
    one = rows.groupBy(key).agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", lambda c: F.min(values(c))), ("high", lambda c: F.max(values(c))), ("nulls", lambda c: F.count_if(values(c).isNull())), ("all", lambda c: F.count(F.lit(1))))])
    said = lambda i: (F.col(f"low_{i}").eqNullSafe(F.col(f"high_{i}"))) & ((F.col(f"nulls_{i}") == 0) | (F.col(f"nulls_{i}") == F.col(f"all_{i}")))
    blocks = F.array(*[F.struct(F.lit(c).alias("column"), said(i).alias("constant"), F.when(said(i), F.col(f"low_{i}")).alias("value")) for i, c in enumerate(columns)])
    return one.select(key, F.explode(blocks).alias("b")).select(key, "b.*")
