"""The reviewers' desk as tables: orders of the queue, worst flags, scopes, staged rows, history, and what runs report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered

#: Days after which a candidate is stale, and how many messages of a run are shown.
STALE_DAYS, SHOWN = 60, 3
#: Columns by which a queue is sorted; age is by the time of the fetch, the other way round.
SORTS = ("type", "name", "tags", "source", "age", "flags", "conf")


def with_flags(candidates: DataFrame, tags: DataFrame, now: Column) -> DataFrame:
    """Candidates (key, head_version, fetched_at) with n_tags and flag, the rank of their worst problem.

    tags: key, invalid, n_evidence. 5 a version conflict, 4 an invalid tag, 3 no tag with evidence, 2 some without, 1 stale,
    0 none. One grouped pass over the tags in place of three subqueries for each candidate.
    """
    per = tags.groupBy("key").agg(F.count(F.lit(1)).alias("n_tags"), F.max("invalid").alias("_bad"), F.max(F.col("n_evidence") > 0).alias("_any"), F.max(F.col("n_evidence") == 0).alias("_bare"))
    out = candidates.join(per, "key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stale = F.col("fetched_at") <= now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    flag = F.when(F.col("head_version").isNotNull(), 5).when(yes("_bad"), 4).when(~yes("_any"), 3).when(yes("_bare"), 2).when(stale, 1).otherwise(0)
    return out.withColumn("flag", flag).withColumn("n_tags", F.coalesce("n_tags", F.lit(0).cast("long"))).drop("_bad", "_any", "_bare")


def queue_order(sort: str, ascending: bool) -> list[Column]:
    """How a queue is ordered: by one of SORTS, then the surest first, then by key."""
    by = {
        "type": F.when(F.col("type") == "new", 0).when(F.col("type") == "closure", 1).otherwise(2), "name": F.lower("name"), "tags": F.col("n_tags"), "source": F.col("source"),
        "age": F.col("fetched_at"), "flags": F.col("flag"), "conf": F.col("conf"),
    }[sort]
    up = ascending != (sort == "age")
    return [by.asc() if up else by.desc(), F.desc("conf"), F.asc("key")]


def scope_areas(areas: DataFrame, candidates: DataFrame, decided: DataFrame, links: DataFrame) -> DataFrame:
    """area, queued, pending, sources and place: every area, the one with most waiting first (place 1).

    areas: area; candidates: key, area; decided: key; links: area, source. The areas are a catalogue, ranked in one task.
    """
    both = candidates.join(decided.select("key", F.lit(1).alias("_d")), "key", "left")
    queued = both.groupBy("area").agg(F.count(F.lit(1)).alias("queued"), F.count("_d").alias("_decided"))
    sources = links.groupBy("area").agg(F.count(F.lit(1)).alias("sources"))
    out = areas.join(queued, "area", "left").join(sources, "area", "left").na.fill(0, ["queued", "_decided", "sources"])
    out = out.withColumn("pending", F.col("queued") - F.col("_decided"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pending"), "area"))).select("area", "queued", "pending", "sources", "place")


def scope_counts(scoped: DataFrame, wanted: str | None = None) -> DataFrame:
    """scope, pending and total of a wanted area or "all"; without one, or of an unknown one, of the area with most waiting."""
    if wanted == "all":
        return scoped.agg(F.lit(None).cast("string").alias("scope"), F.sum("pending").alias("pending"), F.sum("queued").alias("total"))
    known = F.max_by(F.struct(F.col("area").cast("string").alias("scope"), "pending", F.col("queued").alias("total")), F.struct((F.col("area").cast("string") == F.lit(wanted)).cast("int") if wanted is not None else F.lit(0), -F.col("place")))
    return scoped.agg(known.alias("x")).select("x.*")


def staged_rows(decisions: DataFrame, candidates: DataFrame, sources: DataFrame, ops: DataFrame) -> DataFrame:
    """Staged decisions (key, decided_at) with their candidate, its source's label and its operations in order.

    candidates: key, element, type, source; sources: source, name, licence; ops: key, position, op, k, v. A candidate has
    few operations, so they stand in one array.
    """
    tags = ops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "op", "k", "v"))).alias("ops"))
    label = F.concat(F.col("name"), F.when(F.col("licence").isNotNull(), F.concat(F.lit(" ("), F.col("licence"), F.lit(")"))).otherwise(""))
    out = decisions.join(candidates, "key").join(sources.select("source", label.alias("label")), "source")
    return out.join(tags, "key", "left").select("key", "decided_at", "element", "type", "label", F.coalesce("ops", F.array().cast("array<struct<position:int,op:string,k:string,v:string>>")).alias("ops"))


def staged_batch(staged: DataFrame, nth: int, size: int) -> DataFrame:
    """The rows (key, element, decided_at) of the nth batch of `size` objects, counted from 1; past the end the last one.

    Objects are in the order of their first row, rows in that of their decision; ranks are dealt over days.
    """
    first = staged.groupBy("element").agg(F.min(F.struct("decided_at", "key")).alias("first"))
    placed = numbered(first, [], ["first", "element"], F.to_date("first.decided_at"), "place")
    batches = max(1, -(-placed.count() // size))
    page = min(max(1, nth), batches)
    here = placed.filter((F.col("place") >= (page - 1) * size) & (F.col("place") < page * size)).select("element", "place")
    return staged.join(here, "element").withColumn("batch", F.lit(page))


def changeset_history(changesets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Changesets (changeset, uploaded_at, result), the newest first by place, with how many rows each carried."""
    carried = decisions.groupBy("changeset").agg(F.count(F.lit(1)).alias("carried"))
    out = changesets.join(carried, "changeset", "left").withColumn("carried", F.coalesce("carried", F.lit(0).cast("long")))
    days = F.date_diff(F.lit("2100-01-01").cast("date"), F.to_date("uploaded_at"))
    return numbered(out, [], [F.desc("uploaded_at"), "changeset"], days, "place")


def nested(candidates: DataFrame, tags: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates (key) with their tags (tag, key, position, k) in order, each with its evidence (tag, position, text) in order."""
    parts = evidence.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_parts"))
    none = F.array().cast("array<string>")
    held = tags.join(parts, "tag", "left").select("key", F.struct("position", "k", F.coalesce(F.transform("_parts", lambda p: p["text"]), none).alias("evidence")).alias("t"))
    return candidates.join(held.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("tags")), "key", "left")


def pick_due(sources: DataFrame, now: Column, enabled: bool = True) -> DataFrame:
    """The next source to run: the one asked for longest ago, else the first that is enabled, not failing and due. At most a row."""
    asked = sources.filter("requested_at is not null").select(F.struct(F.lit(0).alias("late"), F.col("requested_at").alias("at"), "source").alias("x"))
    due = sources.filter(F.col("enabled") & ~F.col("failing") & (F.col("next_at").isNull() | (F.col("next_at") <= now)))
    due = due.select(F.struct(F.lit(1).alias("late"), F.lit(None).cast("timestamp").alias("at"), "source").alias("x"))
    both = asked.unionByName(due) if enabled else asked
    return both.agg(F.min("x").alias("x")).filter("x is not null").select("x.source", (F.col("x.late") == 0).alias("asked"))


def crossings(counts: DataFrame, limit: int) -> DataFrame:
    """Runs (source, id, at, pending) at which a source's queue went from under the limit to it or over: one notice each time."""
    before = F.coalesce(F.lag("pending").over(Window.partitionBy("source").orderBy("at", "id")), F.lit(0))
    return counts.withColumn("before", before).filter((F.col("before") < limit) & (F.col("pending") >= limit))


def run_results(areas: DataFrame) -> DataFrame:
    """run, result, message from a run's areas (run, area, ok, error): failed if none is ok, partial if some say an error, else ok.

    The message has the first three different errors and how many more there are.
    """
    errors = F.array_sort(F.collect_set("error"))
    out = areas.groupBy("run").agg(F.max("ok").alias("any_ok"), errors.alias("errors"))
    more = F.size("errors") - SHOWN
    message = F.concat(F.array_join(F.slice("errors", 1, SHOWN), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    result = F.when(~F.col("any_ok"), "failed").when(F.size("errors") > 0, "partial").otherwise("ok")
    return out.select("run", result.alias("result"), message.alias("message"))


def source_tag(column: Column) -> Column:
    """The different sources of a group's rows in order, by semicolons."""
    return F.array_join(F.array_sort(F.collect_set(column)), ";")


def objects_label(kind: Column) -> Column:
    """How many nodes, ways and relations a group has: "2 nodes, 1 way"."""
    parts = []
    for k in ("node", "way", "relation"):
        n = F.count_if(kind == k)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {k}"), F.when(n == 1, "").otherwise("s"))))
    return F.concat_ws(", ", *parts)


def warning_lines(*kinds: Column) -> Column:
    """Lines of several kinds of warnings (arrays, or null) as one text, in the order of the kinds."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(*[F.coalesce(k, none) for k in kinds]), "\n")


def evidence_text(values: Column, shown: int = SHOWN) -> Column:
    """The different values of an input that are not empty, in the order of the rows (array): the first three, and … for more."""
    seen = F.array_distinct(F.filter(values, lambda v: v != ""))
    return F.concat(F.array_join(F.slice(seen, 1, shown), ", "), F.when(F.size(seen) > shown, ", …").otherwise(""))


def note_text(note: str, inputs: Sequence[str]) -> Column:
    """A note with {input} replaced by the input's value; a blank or missing one leaves nothing."""
    out = F.lit(note)
    for i in inputs:
        out = F.replace(out, F.lit("{" + i + "}"), F.coalesce(F.col(i).cast("string"), F.lit("")))
    return out


def conflict_tags(conflicts: DataFrame, ops: DataFrame, heads: DataFrame) -> DataFrame:
    """key, k, theirs, ours: per conflicting candidate (key, element) each written key with the head's value and the proposed one.

    ops: key, k, op, v; heads: element, tags (map). What both say is no conflict; a deletion has no value of ours.
    """
    both = conflicts.select("key", "element").join(ops.select("key", "k", "op", "v"), "key").join(heads, "element", "left")
    theirs, ours = F.try_element_at("tags", F.col("k")), F.when(F.col("op") != "del", F.col("v"))
    return both.select("key", "k", theirs.alias("theirs"), ours.alias("ours")).filter(~F.col("theirs").eqNullSafe(F.col("ours")))


def seeds_by_host(seeds: DataFrame, elements: DataFrame) -> DataFrame:
    """Seed addresses (url, host) with the elements (element, host) whose site they are on; element is null where there is none."""
    return seeds.join(elements.select("host", "element"), "host", "left").select("url", "host", "element")


def changed_reads(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """The offered files or pages (url, mark: an ETag or a content hash) that are new or differ from the stored ones; a missing mark counts as changed."""
    return offered.join(stored.filter("mark is not null").select("url", "mark"), ["url", "mark"], "left_anti")


def read_fingerprint(*parts: Column) -> Column:
    """What a read depends on as 16 hexadecimal digits: if it differs from the stored one, everything is read again."""
    return F.substring(F.sha1(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})), 1, 16)
