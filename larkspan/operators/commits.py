"""Versions of candidates and their tags: a run's rows merged by whole tables, checked, written, and only then named as the present version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a candidate and of its tags, as versions keep them.
CANDIDATE = ("key", "area", "hash", "seen", "element", "base")
TAG = ("key", "position", "op", "k", "v")


def save_run(old: DataFrame, old_tags: DataFrame, new: DataFrame, new_tags: DataFrame, decided: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates (CANDIDATE, state) and tags (TAG) after a run wrote `new` and `new_tags`.

    decided: key. listed: key, area, what the sources' areas still list. A candidate that a reviewer has decided stays as it is, with its tags (kept). One that another
    area holds stays there (held), unless that area lists it no more: then the run's area takes it over (moved). Of the others those with equal content are only
    seen again (same), the rest are replaced with all their tags (changed) or are new (added); what the run says nothing of stays (old). A record that two areas of the run
    write is the one's with the lesser area, so none is queued twice.
    """
    mine = F.row_number().over(Window.partitionBy("key").orderBy("area"))
    new = new.withColumn("_nth", mine).filter("_nth = 1").drop("_nth")
    n = new.select("key", F.struct(*CANDIDATE).alias("n"))
    o = old.select("key", F.struct(*CANDIDATE).alias("o"))
    shut = decided.select("key").distinct().withColumn("decided", F.lit(True))
    still = listed.select("key", F.col("area").alias("held_in")).distinct().withColumn("listed", F.lit(True))
    both = o.join(n, "key", "full_outer").join(shut, "key", "left").withColumn("held_in", F.col("o.area")).join(still, ["key", "held_in"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    away = F.col("o.area") != F.col("n.area")
    state = (
        F.when(F.col("n").isNull(), "old").when(F.col("o").isNull(), "added").when(yes("decided"), "kept").when(away & yes("listed"), "held")
        .when(away, "moved").when(F.col("o.hash").eqNullSafe(F.col("n.hash")), "same").otherwise("changed")
    )
    both = both.withColumn("state", state)
    stays, written = F.col("state").isin("old", "kept", "held"), ("added", "moved", "changed")
    taken = F.when(stays, F.col("o")).when(F.col("state") == "same", F.col("o").withField("seen", F.col("n.seen"))).otherwise(F.col("n"))
    rows = both.select(taken.alias("c"), "state").select("c.*", "state")
    replaced = rows.filter(F.col("state").isin(*written)).select("key")
    from_new = new_tags.join(new.select("key", "area"), ["key", "area"], "left_semi") if "area" in new_tags.columns else new_tags
    tags = old_tags.select(*TAG).join(replaced, "key", "left_anti").unionByName(from_new.select(*TAG).join(replaced, "key", "left_semi"))
    return rows, tags


def problems(candidates: DataFrame, tags: DataFrame, before: DataFrame, before_tags: DataFrame, decided: DataFrame) -> DataFrame:
    """key, problem: what forbids that these tables become the present version; none if they may.

    A key twice, a tag without its candidate, a position twice, or a decided candidate that is not what it was, or has other tags.
    """
    say = lambda df, what: df.select("key", F.lit(what).alias("problem"))
    twice = candidates.groupBy("key").count().filter("count > 1")
    orphans = tags.select("key").distinct().join(candidates.select("key"), "key", "left_anti")
    places = tags.groupBy("key", "position").count().filter("count > 1").select("key").distinct()
    shut = decided.select("key").distinct()
    digest = lambda df, cols: df.join(shut, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("d"))
    changed = []
    for was, is_, cols in ((before, candidates, CANDIDATE), (before_tags, tags, TAG)):
        a, b = digest(was, cols), digest(is_, cols).withColumnRenamed("d", "e")
        changed.append(a.join(b, "key", "left").filter(~F.col("d").eqNullSafe(F.col("e"))).select("key"))
    return say(twice, "a key twice").unionByName(say(orphans, "tags without a candidate")).unionByName(say(places, "a position twice")).unionByName(say(changed[0].unionByName(changed[1]).distinct(), "a decided candidate has changed"))


def present(spark: SparkSession, folder: str) -> int | None:
    """The number of the present version, null before the first."""
    try:
        named = spark.read.parquet(f"{folder}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return named.agg(F.max("version")).first()[0]


def commit(candidates: DataFrame, tags: DataFrame, decided: DataFrame, folder: str) -> int:
    """Write the tables as the next version, check what has been written, and name it; a version with problems is never named, and raises.

    Readers take the version that the manifest names last, so they see all of a commit or nothing. One that fails half-way, or is written again, overwrites only
    its own unnamed folder. Commits are made by one writer at a time.
    """
    spark = candidates.sparkSession
    last = present(spark, folder)
    version = 0 if last is None else last + 1
    for df, name in ((candidates.select(*CANDIDATE), "candidates"), (tags.select(*TAG), "tags")):
        df.write.mode("overwrite").parquet(f"{folder}/{name}/{version}")
    written = read(spark, folder, version)
    before = read(spark, folder, last) if last is not None else tuple(df.limit(0) for df in written)
    wrong = problems(*written, *before, decided).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['key']}: {r['problem']}" for r in wrong))
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and tags of a version, the present one if none is given."""
    version = present(spark, folder) if version is None else version
    return spark.read.parquet(f"{folder}/candidates/{version}"), spark.read.parquet(f"{folder}/tags/{version}")


def upload_plan(staged: DataFrame, elements: DataFrame, per_batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(element, version, tags, after, keys, batch): what staged operations make of each object, and (key, element, reason) of what stands in the way.

    staged: key, element, base, k, v (null deletes). elements: element, version, tags (map). An object that is gone, or has a later version than a record was matched
    to, is in the way, and so is a key that two records on one object would write differently: then nothing of the object is sent. All records of an
    object are one change of it; one after which it is as it was is left out. Batches hold `per_batch` objects in the order of their first record.
    """
    head = elements.select("element", "version", "tags")
    both = staged.select("key", "element", "base").distinct().join(head, "element", "left")
    late = F.when(F.col("version").isNull(), "gone").when(F.col("version") > F.col("base"), "changed since")
    blocked = both.select("key", "element", late.alias("reason")).filter("reason is not null")
    said = staged.groupBy("element", "k").agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "v"), F.lit("-"))).alias("n")).filter("n > 1")
    blocked = blocked.unionByName(staged.join(said.select("element", "k"), ["element", "k"], "left_semi").select("key", "element", F.lit("disputed").alias("reason")).distinct())
    free = staged.join(blocked.select("element").distinct(), "element", "left_anti")
    ops = free.groupBy("element").agg(F.map_from_entries(F.collect_set(F.when(F.col("v").isNotNull(), F.struct("k", "v")))).alias("put"), F.collect_set(F.when(F.col("v").isNull(), F.col("k"))).alias("cut"), F.min("key").alias("first"), F.array_sort(F.collect_set("key")).alias("keys"))
    after = F.map_concat(F.map_filter("tags", lambda k, v: ~F.map_contains_key("put", k) & ~F.array_contains("cut", k)), "put")
    made = ops.join(head, "element").withColumn("after", after).filter(F.array_sort(F.map_entries("tags")) != F.array_sort(F.map_entries("after")))
    # Numbered by a hundred thousand keys at a time, so that no task orders all of them.
    span = F.floor(F.col("first") / 100_000)
    inside = made.withColumns({"_span": span, "_nth": F.row_number().over(Window.partitionBy(span).orderBy("first", "element"))})
    spans = inside.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = inside.join(spans.select("_span", before.alias("_before")), "_span")
    return out.select("element", "version", "tags", "after", "keys", F.floor((F.col("_before") + F.col("_nth") - 1) / per_batch).cast("long").alias("batch")), blocked
