"""What the corpus operators share: tables in the shared folder, batches of bounded size, gapless numbering."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, and what separates words, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of a vectorised operator works on at a time: its arrays stay near the processor's cache.
SLICE_BYTES = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share; steps are written there.")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="larkspan-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back: lineage ends here and survives lost executors.

    Spark keeps a step's shuffle files until the driver collects the objects that stand for them, so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `stored` (or rows taken from one by a filter) after their last reader has been written."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(name: str, columns: Sequence[str]) -> str:
    """`name`, with as many underscores behind as make it none of `columns` (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds at most `limit` bytes in each, one row at least."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        if col.nbytes <= limit:
            yield batch
            continue
        sizes = (pc.multiply(pc.list_value_length(col), 4) if pa.types.is_list(col.type) else pc.binary_length(col)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str, value: str | None = None) -> DataFrame:
    """Add `out`: the row's number from 0 within `group`, or with `value` the sum of it over the rows before.

    Rows are ordered by `bucket`, then by `order`. No task holds a group: each sorts one bucket of one group, and the
    buckets' totals, a small table, are summed over the buckets before. Rows that tie in everything are alike, so which
    of them comes first does not matter. Null group values are a group of their own.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", bucket).repartition(*keys)
    amount = F.sum(value) if value else F.count(F.lit(1))
    totals = dealt.groupBy(*keys).agg(amount.alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    if value:
        local = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        local = F.row_number().over(inside) - 1
    ranked = dealt.withColumn("_local", local)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & ranked[k].eqNullSafe(offsets[f"_k{i}"])
    return ranked.join(offsets, same).withColumn(out, (F.col("_local") + F.col("_before")).cast("long")).drop("_local", "_before", "_bucket", *[f"_k{i}" for i in range(len(keys))])
