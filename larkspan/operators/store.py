"""The candidate snapshot: merged, swept and checked for conflicts as whole tables, joined on the source record's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash


def content_hash(columns: Sequence[str]) -> Column:
    """16 hexadecimal digits over the JSON of the columns: equal content, equal hash."""
    return short_hash(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def merge_snapshot(old: DataFrame, new: DataFrame, decided: DataFrame) -> DataFrame:
    """key, hash, seen, state after a run: old (key, hash, seen), new (key, hash, seen), decided (key).

    state: kept (decided, never altered), same (only seen is touched), changed, added, vanished (unseen and undecided: to be
    left out), from one full outer join. An empty `new` vanishes nothing: deletion needs a complete read.
    """
    any_read = not new.isEmpty()
    old = old.join(decided.select("key").distinct().withColumn("decided", F.lit(True)), "key", "left")
    both = old.alias("o").join(new.alias("n"), "key", "full_outer")
    was, is_ = F.col("o.seen").isNotNull(), F.col("n.seen").isNotNull()
    state = (
        F.when(was & F.col("o.decided"), "kept").when(was & ~is_, "vanished" if any_read else "kept")
        .when(~was, "added").when(F.col("o.hash") == F.col("n.hash"), "same").otherwise("changed")
    )
    both = both.withColumn("state", state)
    mine = F.col("state").isin("kept", "vanished")
    return both.select("key", F.when(mine, F.col("o.hash")).otherwise(F.col("n.hash")).alias("hash"), F.when(mine, F.col("o.seen")).otherwise(F.col("n.seen")).alias("seen"), "state")


def upsert(old: DataFrame, new: DataFrame, decided: DataFrame) -> DataFrame:
    """key, hash, seen of a snapshot after rows that have landed since: the latest of each key, but decided ones stay as they are; nothing vanishes."""
    latest = new.groupBy("key").agg(F.max(F.struct("seen", "hash")).alias("n"))
    both = old.alias("o").join(latest, "key", "full_outer").join(decided.select("key", F.lit(True).alias("kept")).distinct(), "key", "left")
    mine = F.col("n").isNull() | (F.col("kept") & F.col("o.seen").isNotNull())
    return both.select("key", F.when(mine, F.col("o.hash")).otherwise(F.col("n.hash")).alias("hash"), F.when(mine, F.col("o.seen")).otherwise(F.col("n.seen")).alias("seen"))


def sweep_vanished(candidates: DataFrame, decided: DataFrame, run_start: Column) -> DataFrame:
    """Candidates without those that a run made (hash), that it has not seen since its start, and that nobody decided."""
    unseen = F.col("hash").isNotNull() & (F.col("seen").isNull() | (F.date_trunc("second", "seen") < F.date_trunc("second", run_start)))
    decided = decided.select("key").distinct().withColumn("decided", F.lit(True))
    return candidates.join(decided, "key", "left").filter(~unseen | F.coalesce("decided", F.lit(False))).drop("decided")


def conflicts(candidates: DataFrame, elements: DataFrame, decided: DataFrame) -> DataFrame:
    """key, element, base, head: undecided candidates (key, element, version, base_version) whose object has moved on."""
    open_ = candidates.join(decided.select("key"), "key", "left_anti")
    base = F.coalesce("base_version", "version")
    both = open_.join(elements.select("element", F.col("version").alias("head")), "element").filter(F.col("head") > base)
    return both.select("key", "element", base.alias("base"), "head")
