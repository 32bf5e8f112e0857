"""What a reviewer's picks write: operations read off the object as it was matched, or a refusal that names the pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The longest key or value that the map holds.
LONGEST = 255


def _current(proposals: DataFrame, unchanged: DataFrame) -> DataFrame:
    """key, k, cur: what the object holds, from what is left alone and from what proposals change or delete; the last of a key counts."""
    held = F.when(F.col("op") == "del", F.col("v")).when(F.col("op") == "mod", F.col("was"))
    changed = proposals.select("key", "k", held.alias("cur"), F.col("position").alias("at")).filter("cur is not null")
    rows = unchanged.select("key", "k", F.col("v").alias("cur"), F.lit(-1).alias("at")).unionByName(changed)
    return rows.groupBy("key", "k").agg(F.max_by("cur", "at").alias("cur"))


def decide(picks: DataFrame, proposals: DataFrame, unchanged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, nth, tag_id, op, k, v, was) of the records whose picks can be written, and (key, reason) of the others, the first reason each.

    picks: key, seq, kind (tag, set or del), arg (a proposal's position, key=value, or a key). proposals: key, position, id, k, op, v, was, pair,
    grp, invalid, evidenced. unchanged: key, k, v. A proposal is written as it is, if it is valid and has evidence. A typed value says only what
    a key should be: whether that adds or changes is read off the object. Nothing is written twice; a move is written whole or not at all,
    and its old key is only removed; of a group all or nothing. Records with a row in picks that is null in kind have picked nothing.

    Every check is a column of the picks or an equi-join by record and key; a refusal is the least by stage and order. All sides grow with the records and are
    often made by explode, whose size Spark takes to be that of its input, so the joins are merges: a broadcast would bring them whole to the driver.
    """
    by_place = proposals.select("key", F.col("position").cast("string").alias("arg"), F.col("id").alias("p_id"), F.col("k").alias("p_k"), F.col("op").alias("p_op"), F.col("v").alias("p_v"), F.col("was").alias("p_was"), "invalid", "evidenced")
    stage = F.when(F.col("kind") == "tag", 0).when(F.col("kind") == "set", 1).when(F.col("kind") == "del", 2)
    rows = picks.withColumn("stage", stage).filter("stage is not null")
    once = F.row_number().over(Window.partitionBy("key", "stage", F.when(F.col("stage") == 0, F.trim("arg")).otherwise(F.col("seq").cast("string"))).orderBy("seq"))
    rows = rows.withColumn("nth", once).filter("nth = 1").drop("nth").withColumn("arg", F.when(F.col("stage") == 0, F.trim("arg")).otherwise(F.col("arg")))
    rows = rows.join(by_place.hint("merge"), ["key", "arg"], "left")
    split = F.instr("arg", "=")
    rows = rows.withColumns({
        "k": F.when(F.col("stage") == 0, F.col("p_k")).when(F.col("stage") == 1, F.trim(F.substring("arg", F.lit(1), F.greatest(split - 1, F.lit(0))))).otherwise(F.col("arg")),
        "v": F.when(F.col("stage") == 0, F.col("p_v")).when(F.col("stage") == 1, F.trim(F.substring("arg", split + 1, F.length("arg")))), "split": split,
    })
    first = proposals.groupBy("key", "k").agg(F.min_by("id", "position").alias("first_id"))
    rows = rows.join(_current(proposals, unchanged).hint("merge"), ["key", "k"], "left").join(first.hint("merge"), ["key", "k"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = (
        F.when(F.col("stage") == 0, F.when(F.col("p_k").isNull(), F.lit("no proposal stands there")).when(yes("invalid"), F.concat("k", F.lit(" is not valid"))).when(~yes("evidenced"), F.concat("k", F.lit(" has no evidence"))))
        .when(F.col("stage") == 1, F.when((F.col("split") == 0) | (F.col("k") == ""), F.lit("a tag needs a key")).when(F.col("v") == "", F.concat("k", F.lit(" needs a value"))).when((F.length("k") > LONGEST) | (F.length("v") > LONGEST), F.concat("k", F.lit(f" is longer than {LONGEST} characters"))).when(F.col("cur") == F.col("v"), F.concat("k", F.lit(" is already "), "v")))
        .otherwise(F.when(F.col("cur").isNull(), F.concat("k", F.lit(" is not on the object"))))
    )
    # A pick that is refused itself writes nothing, so a later one of the key is no second writing; the first refusal counts anyway.
    rows = rows.withColumn("own", own)
    again = F.row_number().over(Window.partitionBy("key", "k", F.col("own").isNull()).orderBy("stage", "seq"))
    rows = rows.withColumn("reason", F.coalesce("own", F.when(again > 1, F.concat("k", F.lit(" is written twice")))))
    op = F.when(F.col("stage") == 0, F.col("p_op")).when(F.col("stage") == 2, F.lit("del")).when(F.col("cur").isNull(), "add").otherwise("mod")
    ops = rows.select("key", "stage", "seq", "reason", F.when(F.col("stage") == 0, F.col("p_id")).otherwise(F.col("first_id")).alias("tag_id"), op.alias("op"), "k", F.when(F.col("stage") == 2, F.col("cur")).otherwise(F.col("v")).alias("v"), F.when(F.col("stage") == 0, F.col("p_was")).when(F.col("stage") == 1, F.col("cur")).alias("was"))

    by_row = ops.filter("reason is not null").select("key", F.struct(F.col("stage").alias("a"), F.col("seq").cast("long").alias("b"), F.lit(0).alias("c")).alias("at"), "reason")
    everyone = picks.select("key").distinct()
    nothing = everyone.join(ops.select("key").distinct().hint("merge"), "key", "left_anti").select("key", F.struct(F.lit(3).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c")).alias("at"), F.lit("nothing is picked").alias("reason"))
    parts = _half_written(proposals.join(everyone.hint("merge"), "key", "left_semi"), ops.filter("reason is null").select("key", "k", "op"))
    refused = by_row.unionByName(nothing).unionByName(parts).groupBy("key").agg(F.min_by("reason", "at").alias("reason"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("stage", "seq"))
    return ops.join(refused.hint("merge"), "key", "left_anti").select("key", nth.alias("nth"), "tag_id", "op", "k", "v", "was"), refused


def _half_written(proposals: DataFrame, written: DataFrame) -> DataFrame:
    """Refusals for moves of which one half is written, or whose old key is written anew, and for groups of which a part is."""
    wrote = written.select("key", F.col("k").alias("wk"), F.col("op").alias("w_op")).groupBy("key", "wk").agg(F.first("w_op").alias("w_op"))

    def held(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(wrote.select("key", F.col("wk").alias(column), F.col("w_op").alias(out)).hint("merge"), ["key", column], "left")

    at = lambda stage, c: F.struct(F.lit(stage).alias("a"), F.col("position").cast("long").alias("b"), F.lit(c).alias("c")).alias("at")
    moves = held(held(proposals.filter("pair is not null"), "k", "k_op"), "pair", "pair_op")
    source = F.when(F.col("op") == "del", F.col("k")).otherwise(F.col("pair"))
    target = F.when(F.col("op") == "del", F.col("pair")).otherwise(F.col("k"))
    source_op = F.when(F.col("op") == "del", F.col("k_op")).otherwise(F.col("pair_op"))
    said: Column = F.when(F.col("k_op").isNull() != F.col("pair_op").isNull(), F.concat(source, F.lit(" moves to "), target, F.lit(": both or neither"))).when(source_op != "del", F.concat(source, F.lit(" moves to "), target, F.lit(": it can only be removed")))
    moved = moves.withColumn("reason", said).filter("reason is not null").select("key", at(4, 0), "reason")
    groups = held(proposals.filter("grp is not null"), "k", "k_op").groupBy("key", "grp").agg(
        F.min("position").alias("position"), F.min_by("k", F.when(F.col("k_op").isNotNull(), F.col("position"))).alias("taken"), F.count("k_op").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k_op").isNull(), F.struct("position", "k")))), lambda x: x["k"]), ", ").alias("left"),
    )
    part = F.concat("taken", F.lit(" is part of "), F.when(F.col("grp") == "addr", "the address").otherwise(F.concat(F.lit("the group "), "grp")), F.lit(": all or nothing, without "), "left")
    return moved.unionByName(groups.filter("n > 0 and left <> ''").select("key", at(5, 0), part.alias("reason")))
