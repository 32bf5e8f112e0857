"""What reviewers see: the queue, tallies, batches to upload, runs on hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import xml_escape
from .ranks import numbered

#: Candidates on a page of the queue, and objects in a changeset.
PAGE, BATCH = 50, 50
#: Positions that are ranked in one task.
SPAN = 100_000


def queue_page(candidates: DataFrame, decided: DataFrame, page: int, order: list[Column], kind: str | None = None, low: float = 0.0, high: float = 1.0, size: int = PAGE) -> DataFrame:
    """One page of the undecided candidates of a kind and a band of confidence; a page past the end is the last one.

    The count and the page are two jobs; the page itself is a top-k, no full sort.
    """
    open_ = candidates.filter(F.col("conf").between(low, high))
    open_ = (open_ if kind is None else open_.filter(F.col("type") == kind)).join(decided.select("key"), "key", "left_anti")
    pages = max(1, -(-open_.count() // size))
    page = min(max(1, page), pages)
    ranked = open_.orderBy(*order).limit(page * size)
    rank = F.row_number().over(Window.orderBy(*order))
    return ranked.withColumn("rank", rank).filter(F.col("rank") > (page - 1) * size)


def tallies(candidates: DataFrame, decisions: DataFrame, group: str, since: Column) -> DataFrame:
    """Per group: candidates, decided, pending, accepted since a time, and the share accepted (null without decisions)."""
    d = decisions.select("key", F.lit(True).alias("has"), (F.col("kind") == "accepted").alias("yes"), "decided_at")
    both = candidates.join(d, "key", "left")
    out = both.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count("has").alias("decided"), F.count_if(F.col("yes") & (F.col("decided_at") >= since)).alias("accepted_lately"), F.count_if("yes").alias("accepted"),
    )
    return out.select(group, "n", "decided", F.greatest(F.lit(0), F.col("n") - F.col("decided")).alias("pending"), "accepted", "accepted_lately", F.when(F.col("decided") > 0, F.round(F.col("accepted") / F.col("decided"), 4)).alias("share"))


def batches(staged: DataFrame, scope: str, size: int = BATCH) -> DataFrame:
    """Staged rows (scope, element, position) in batches of `size` objects of a scope, objects in the order of their first row.

    Ranks are dealt over spans of positions, so that a scope with very many objects is no single task's work.
    """
    objects = staged.groupBy(scope, "element").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    placed = numbered(objects, [scope], ["first", "element"], F.floor(F.col("first") / SPAN), "nth")
    return placed.select(scope, "element", "n_rows", F.floor(F.col("nth") / size).alias("batch"))


def run_state(runs: DataFrame) -> DataFrame:
    """source, last_id, last_result, hold: each source's last run, and whether its last three all failed."""
    last = Window.partitionBy("source").orderBy("started", "id").rowsBetween(-2, 0)
    failed = F.col("result") == "failed"
    hold = (F.sum(failed.cast("int")).over(last) == 3) & (F.count(F.lit(1)).over(last) == 3)
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started"), F.desc("id")))
    return runs.withColumn("hold", hold).withColumn("nth", newest).filter("nth = 1").select("source", F.col("id").alias("last_id"), F.col("result").alias("last_result"), "hold")


def change_xml(objects: DataFrame) -> DataFrame:
    """element and xml: a modify block from tags (array of k, v), keys in order."""
    tags = F.transform(F.array_sort("tags"), lambda t: F.concat(F.lit('<tag k="'), xml_escape(t["k"]), F.lit('" v="'), xml_escape(t["v"]), F.lit('"/>')))
    return objects.select("element", F.concat(F.lit('<modify><node id="'), F.col("element").cast("string"), F.lit('">'), F.array_join(tags, ""), F.lit("</node></modify>")).alias("xml"))
