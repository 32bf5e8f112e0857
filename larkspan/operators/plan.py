"""What a source's tags would change on objects: additions, changes, deletions and moves, as rows of operations.

Proposed tags are rows (key, k, v, add_only, grp); objects are rows (key, tags: a map). An object has few tags, so they
travel as one map; records are many, and all work is by record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tags import HELD_ADDRESS, RETIRED, key_on
from ..functions.values import phone_digits, same_value
from ..steps import checkpointed

#: Keys under which an object may carry the phone that a key proposes, and keys that leave a gap-filling value no gap (fixed values).
PHONES = ("phone", "contact:phone", "mobile", "contact:mobile")
FILLED_BY = {"socket:type2": ("socket:type2_cable",), "socket:type2:output": ("socket:type2", "socket:type2_cable")}
#: Counts of connectors of no stated type, which typed counts replace (fixed values).
UNTYPED = ("socket:unknown", "socket:unknown:output")
OP = ("key", "k", "op", "v", "was", "pair")


def tag_map(rows: DataFrame) -> DataFrame:
    """key and tags (a map) of rows key, k, v. Of a key that repeats on an object the greatest value stays."""
    one = rows.groupBy("key", "k").agg(F.max("v").alias("v"))
    return one.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


def _with_tags(proposed: DataFrame, objects: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return proposed.join(objects.select("key", "tags"), "key", "left").withColumn("tags", F.coalesce("tags", empty))


def address_ops(proposed: DataFrame, objects: DataFrame) -> DataFrame:
    """Operations of proposed address parts (addr:*): all or nothing.

    If a part differs from the object's, held as addr:* or contact:*, none is written. Else missing parts are added, and
    held contact:* parts move to addr:*, as an addition and a deletion that name each other as pair.
    """
    both = _with_tags(proposed.select("key", "k", "v"), objects)
    other = F.regexp_replace("k", "^addr:", "contact:")
    held = F.coalesce(F.try_element_at("tags", F.col("k")), F.try_element_at("tags", other))
    differs = held.isNotNull() & ~same_value(F.col("k"), F.col("v"), held)
    # From a checkpoint, as additions and moves both read it.
    both = checkpointed(both.withColumn("held", held).withColumn("away", F.max(differs).over(Window.partitionBy("key"))).filter("not away"))
    none = F.lit(None).cast("string")
    added = both.filter("held is null").select("key", "k", F.lit("add").alias("op"), "v", none.alias("was"), none.alias("pair"))
    moved = both.dropDuplicates(["key"]).select("key", "tags", F.explode(F.array(*[F.lit(k) for k in HELD_ADDRESS])).alias("k"))
    moved = moved.withColumn("to", F.regexp_replace("k", "^contact:", "addr:")).withColumn("v", F.try_element_at("tags", F.col("k")))
    moved = moved.filter(F.col("v").isNotNull() & ~F.map_contains_key("tags", F.col("to")))
    ends = F.array(F.struct(F.col("to").alias("k"), F.lit("add").alias("op"), F.col("k").alias("pair")), F.struct(F.col("k").alias("k"), F.lit("del").alias("op"), F.col("to").alias("pair")))
    moves = moved.select("key", "v", F.explode(ends).alias("e")).select("key", "e.k", "e.op", "v", none.alias("was"), "e.pair")
    return added.unionByName(moves)


def update_ops(proposed: DataFrame, objects: DataFrame, main_keys: Sequence[str] = (), never: Sequence[str] = ()) -> DataFrame:
    """Operations (key, k, op, v, was, pair) that turn objects' tags into what the source says; none for what agrees.

    A contact goes under the key that the object uses. Left out are: add-only values where the key or one that fills it is
    held, keys never to be replaced, a main tag beside its own retired twin, a phone that stands under another key, and
    authentication:none where the object says otherwise. Firm typed socket counts delete untyped ones. Address parts
    (grp addr) go through address_ops.
    """
    parts = F.coalesce(F.col("grp") == "addr", F.lit(False))
    both = _with_tags(proposed.filter(~parts), objects)
    tag = lambda k: F.try_element_at("tags", k if isinstance(k, Column) else F.lit(k))
    add_only = F.col("add_only") | ((F.col("k") == "opening_hours") & (F.trim("v") == "24/7"))
    both = both.withColumn("at", key_on(F.col("k"), F.col("tags"))).withColumn("held", tag(F.col("at"))).withColumn("add_only", add_only)
    filled = F.lit(False)
    for k, others in FILLED_BY.items():
        filled = filled | ((F.col("k") == k) & F.coalesce(*[F.when(tag(o).isNotNull(), True) for o in others], F.lit(False)))
    twin = F.lit(False)
    for k in main_keys:
        twin = twin | ((F.col("k") == k) & F.coalesce(*[F.when(tag(f"{p}:{k}").isNotNull(), True) for p in RETIRED], F.lit(False)))
    elsewhere = F.col("k").isin("phone", "operator:phone") & F.exists(
        F.array(*[F.when(F.col("at") != o, tag(o)) for o in PHONES]), lambda v: F.coalesce((v != "") & (phone_digits(v) == phone_digits(F.col("v"))), F.lit(False))
    )
    said = F.map_filter("tags", lambda k, v: ((k == "payment:membership_card") | (F.startswith(k, F.lit("authentication:")) & (k != "authentication:none"))) & (v == "yes"))
    ruled_out = (F.col("k") == "authentication:none") & (F.size(said) > 0)
    both = both.filter(~(F.col("add_only") & filled) & ~twin & ~elsewhere & ~ruled_out)
    replaced = ~F.col("add_only") & ~F.col("at").isin(*never) if never else ~F.col("add_only")
    op = F.when(F.col("held").isNull(), "add").when(replaced & ~same_value(F.col("k"), F.col("v"), F.col("held")), "mod")
    none = F.lit(None).cast("string")
    # From a checkpoint, so that values are compared once: not for the filter and the rows, nor for each reader.
    ops = checkpointed(both.select("key", F.col("at").alias("k"), op.alias("op"), "v", F.col("held").alias("was"), none.alias("pair"), "add_only")).filter("op is not null")
    typed = ops.filter(F.col("k").rlike("^socket:(?!unknown)[^:]+$") & ~F.col("add_only")).select("key").distinct()
    untyped = typed.join(objects, "key").select("key", F.explode(F.array(*[F.lit(k) for k in UNTYPED])).alias("k"), "tags").withColumn("v", tag(F.col("k"))).filter("v is not null")
    ops = ops.drop("add_only").unionByName(untyped.select("key", "k", F.lit("del").alias("op"), "v", none.alias("was"), none.alias("pair")))
    return ops.unionByName(address_ops(proposed.filter(parts), objects))


def new_ops(proposed: DataFrame) -> DataFrame:
    """Operations of a new object: every tag is added."""
    none = F.lit(None).cast("string")
    return proposed.select("key", "k", F.lit("add").alias("op"), "v", none.alias("was"), none.alias("pair"))


def closure_ops(closed: DataFrame, objects: DataFrame, main_keys: Sequence[str]) -> DataFrame:
    """Operations of closed places (key, own: the record's main key or null): the main tag becomes disused:, hours and phone go."""
    both = closed.join(objects, "key")
    first = F.coalesce(F.col("own"), *[F.when(F.map_contains_key("tags", F.lit(k)), F.lit(k)) for k in main_keys])
    both = both.withColumn("main", first).withColumn("value", F.try_element_at("tags", F.col("main"))).filter("value is not null")
    none = F.lit(None).cast("string")
    op = lambda k, name, v, was: F.struct(k.alias("k"), F.lit(name).alias("op"), v.alias("v"), was.alias("was"))
    gone = [F.when(F.map_contains_key("tags", F.lit(k)), op(F.lit(k), "del", F.try_element_at("tags", F.lit(k)), none)) for k in ("opening_hours", "phone")]
    ops = F.array_compact(F.array(op(F.concat(F.lit("disused:"), F.col("main")), "mod", F.col("value"), F.concat_ws("=", "main", "value")), *gone))
    return both.select("key", F.explode(ops).alias("o")).select("key", "o.k", "o.op", "o.v", "o.was", none.alias("pair"))


def applied(ops: DataFrame, objects: DataFrame) -> DataFrame:
    """key, tags, after and changes: objects' tags after their operations, and whether anything is then different.

    A closure's mod of disused:k also takes k away.
    """
    by_key = ops.groupBy("key").agg(
        F.collect_list(F.when(F.col("op") != "del", F.struct("k", "v"))).alias("written"),
        F.array_union(F.collect_set(F.when(F.col("op") == "del", F.col("k"))), F.collect_set(F.when((F.col("op") == "mod") & F.startswith("k", F.lit("disused:")), F.regexp_replace("k", "^disused:", "")))).alias("gone"),
    )
    both = objects.select("key", "tags").join(by_key, "key", "left")
    written = F.map_from_entries(F.coalesce("written", F.array().cast("array<struct<k:string,v:string>>")))
    both = both.withColumn("written", written).withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    kept = F.map_filter("tags", lambda k, v: ~F.map_contains_key("written", k) & ~F.array_contains("gone", k))
    both = both.select("key", "tags", F.map_concat(kept, "written").alias("after"))
    entries = lambda m: F.array_sort(F.map_entries(m))
    return both.withColumn("changes", entries("tags") != entries("after"))


def rebase(ops: DataFrame, objects: DataFrame) -> DataFrame:
    """The operations as they stand against the objects' tags of today; what they already say is left out.

    An addition over a value that someone set becomes a change that shows it. A move whose other half is done is a plain
    write. A record without operations left has no rows.
    """
    both = _with_tags(ops.select(*OP), objects).withColumn("now", F.try_element_at("tags", F.col("k")))
    op = F.when(F.col("op") == "del", F.when(F.col("now").isNotNull(), "del")).when(F.col("now").isNull(), "add").when(F.col("now") != F.col("v"), "mod")
    gone = F.col("op") == "del"
    left = both.withColumn("now_op", op).filter("now_op is not null")
    left = left.select("key", "k", F.col("now_op").alias("op"), F.when(gone, F.col("now")).otherwise(F.col("v")).alias("v"), F.when(~gone, F.col("now")).otherwise(F.col("was")).alias("was"), "pair")
    other = left.select("key", F.col("k").alias("pair"), F.lit(True).alias("there"))
    return left.join(other, ["key", "pair"], "left").select("key", "k", "op", "v", "was", F.when(F.col("there"), F.col("pair")).alias("pair"))


def confidence(ops: DataFrame) -> DataFrame:
    """key and conf of rows key, conf: the mean over a record's operations, to two decimals (the nearest hundredth of the double, halves up)."""
    return ops.groupBy("key").agg((F.floor(F.avg("conf") * 100 + 0.5) / 100).alias("conf"))


def disputed_with_groups(ops: DataFrame, others: DataFrame) -> DataFrame:
    """The operations (record, element, k, op, v, grp, pair) that another record (record, element, k, v) on the object contradicts.

    With one operation of a group, or one half of a move, go the others. Not records but the distinct values of a key on an
    object are compared, with the least and the greatest record that says each: however many records say the same, it is one.
    """
    said = others.groupBy("element", "k", "v").agg(F.min("record").alias("lo"), F.max("record").alias("hi"))
    written = ops.filter("op <> 'del'").select("element", "k", "v").distinct()
    o, t = written.alias("o"), said.alias("t")
    against = (F.col("o.element") == F.col("t.element")) & (F.col("o.k") == F.col("t.k")) & ~F.col("o.v").eqNullSafe(F.col("t.v")) & ~same_value(F.col("t.k"), F.col("t.v"), F.col("o.v"))
    unlike = o.join(t, against).groupBy("o.element", "o.k", "o.v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    direct = ops.filter("op <> 'del'").join(unlike, ["element", "k", "v"]).filter((F.col("lo") != F.col("record")) | (F.col("hi") != F.col("record")))
    groups = direct.filter("grp is not null").select("record", "grp").distinct().withColumn("by_group", F.lit(True))
    keys = direct.select("record", "k").distinct()
    out = ops.join(keys.withColumn("itself", F.lit(True)), ["record", "k"], "left").join(groups, ["record", "grp"], "left")
    out = out.join(keys.select("record", F.col("k").alias("pair"), F.lit(True).alias("by_pair")), ["record", "pair"], "left")
    return out.filter(F.coalesce((F.col("itself") & (F.col("op") != "del")), F.col("by_group"), F.col("by_pair"), F.lit(False))).select(*ops.columns)


def suppressed(ops: DataFrame, facts: DataFrame, organisations: Sequence[str] = (), shell_key: str | None = None) -> DataFrame:
    """Operations (key, k, op, v, grp) with reason: why one is left out of a record's plan; null where it stays. The first reason counts.

    facts, a row for each key: counts ("all" where the object is a part of the site that the source counts, "own" where several records share it, so that
    only outputs stay; may be missing), far (the object lies far from the address), placeless (it is mapped as no place), gone (it is
    no longer the place), shared (other records match it, or it carries others' ids), grounds (it is a block within the mapped ground), main (the record's
    main key), mapped_on and within (days between the object's mapping and a date that is believed), disputed (keys that another record on it contradicts).
    What names the organisation (keys `organisations`) goes with what reaches it; on a block its own key (`shell_key`) stays as it is mapped.
    """
    both = ops.join(facts, "key", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    dated = F.col("k") == "start_date"
    reached = (F.coalesce(F.col("grp"), F.lit("")) == "addr") | F.col("k").rlike("^(addr|contact):") | F.col("k").isin("phone", "website", "email", "fax", "mobile", *organisations)
    late = F.col("mapped_on").isNull() | (F.date_diff(F.col("v").try_cast("date"), F.col("mapped_on")) > F.col("within"))
    counted = F.lit(False)
    if "counts" in facts.columns:
        count = F.col("k").rlike("^(capacity|socket:.+)$")
        counted = count & ((F.col("counts") == "all") | ((F.col("counts") == "own") & ((F.col("op") == "del") | ~F.endswith("k", F.lit(":output")))))
    reason = (
        F.when(F.coalesce(counted, F.lit(False)), "counts").when(yes("far") & yes("placeless") & (reached | ~F.startswith("k", F.lit("ref:"))), "far").when(yes("far") & (reached | dated), "far")
        .when(yes("grounds") & ((F.col("k") == "name") | (F.col("k") == shell_key if shell_key else F.lit(False))), "grounds").when(yes("gone") & ((F.col("k") == F.col("main")) | dated), "no longer the place")
        .when(yes("shared") & dated, "shared").when(dated & F.col("within").isNotNull() & F.coalesce(late, F.lit(True)), "mapped before")
        .when(F.coalesce(F.array_contains("disputed", F.col("k")), F.lit(False)), "disputed")
    )
    return both.select(*ops.columns, reason.alias("reason"))


def mod_warnings(ops: DataFrame, surveys: DataFrame) -> DataFrame:
    """key, k, warning: a line for each held value that an operation would overwrite; surveys: key, survey (day or null)."""
    why = F.when(F.col("survey").isNotNull(), F.concat(F.lit(", and a mapper checked this object on "), F.col("survey"))).otherwise("; a mapper may have set it on purpose")
    both = ops.filter("op = 'mod'").join(surveys, "key", "left")
    return both.select("key", "k", F.concat(F.lit("OSM has "), F.col("k"), F.lit("="), F.col("was"), F.lit(" where the source says "), F.col("v"), why).alias("warning"))
