"""Steps of a job: checkpoints in the folder that driver and executors share, and costly expressions that are worked out once, on all cores."""

from __future__ import annotations

import tempfile

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only local mode, where it is unset, may make a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return tempfile.mkdtemp(prefix="larkspan-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint: computed once for all their readers, and not again when executors are lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    """As many tasks as keep all cores busy, and no fewer than a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows by a hash of `by` over as many tasks as there are cores: a small file, or one of few row groups, is read by few tasks, and they would do all that follows."""
    return df.repartition(tasks(df.sparkSession), *by)


def worked_once(df: DataFrame, by: list[str], made: Mapping[str, Column]) -> DataFrame:
    """The rows with columns `made` of the columns `by`, each worked out once for all rows that are alike in them, by as many tasks as there are cores.

    For what takes long and is often the same, such as opening hours: a small file, or one of few row groups, is read by few tasks, and they would do all of it.
    """
    each = df.select(*by).distinct().repartition(tasks(df.sparkSession), *by)
    # From the checkpoint a filter on what was made reads it; without one Spark would work it out again for each mention, and plan for minutes.
    each = checkpointed(each.select(*[F.col(c).alias(f"_{c}") for c in by], *[column.alias(name) for name, column in made.items()]))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(each, on, "left").drop(*[f"_{c}" for c in by])
