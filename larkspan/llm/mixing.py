"""Mixing sources to target weights by a golden-ratio schedule of equal blocks of shuffled words."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, numbered, stored

#: Words in a block of the mix.
BLOCK = 128
#: The step of the schedule's points: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Slots of the schedule that are numbered in one task, and cells by which points find their source.
CHUNK, CELLS = 16384, 4096
#: More slots than the targets need, so that the low-discrepancy schedule leaves few blocks to append; what goes beyond a
#: target is cut.
SPARE = 0.02


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target from one row a source (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all words. No target passes
    `most` times its source's size; what is cut is shared by weight among the others until none is above. That is one
    level of words per weight for all that are not cut: sources are taken in order of most * size / weight, and one is cut
    if the level without it reaches its own. Works on the catalogue of sources, which is far smaller than the documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.withColumn("_nr", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("_w", F.element_at(cycle, (F.col("_nr") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_level", "_nr")
    rows = rows.withColumns(
        {
            "_words": F.lit(float(share)) * F.sum("source_size").over(everything),
            "_before": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_weights": F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("_cut", (F.col("_words") - F.col("_before")) / F.col("_weights") >= F.col("_level"))
    left = F.first("_words").over(everything) - F.sum(F.when(F.col("_cut"), F.col("_cap")).otherwise(0.0)).over(everything)
    level = left / F.sum(F.when(~F.col("_cut"), F.col("_w")).otherwise(0.0)).over(everything)
    return rows.select("source", "source_size", F.when(F.col("_cut"), F.col("_cap")).otherwise(level * F.col("_w")).alias("target"), "_nr")


def _schedule(spark: SparkSession, targets: DataFrame, words: float, block: int) -> DataFrame:
    """_nr (source), _turn, the number in the source of each of its slots, and slot, its place in the whole mix.

    Slots are golden-ratio points mapped through the cumulative targets. The last block of a pass is short, and a small
    source may get no point: the turns that a source then lacks to fill its target come after the last slot, in the order of turns.
    """
    slots = math.ceil(words * (1 + SPARE) / block)
    cumulative = Window.orderBy("_nr")
    ranges = targets.select(
        "_nr", (F.coalesce(F.sum("target").over(cumulative.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.lit(words)).alias("_lo"),
        (F.sum("target").over(cumulative.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(words)).alias("_hi"),
    ).filter("_hi > _lo")
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS).cast("long"), F.floor(F.col("_hi") * CELLS).cast("long"))))
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(slots).withColumn("_p", point - F.floor(point)).withColumn("_cell", F.floor(F.col("_p") * CELLS).cast("long"))
    placed = points.join(cells, "_cell").filter("_p >= _lo and _p < _hi").select("_nr", F.col("id").alias("slot"))
    turns = numbered(placed, ["_nr"], ["slot"], F.floor(F.col("slot") / CHUNK), "_turn").select("_nr", "_turn", "slot")
    passes = F.floor(F.floor("target") / F.col("source_size"))
    rest = F.floor("target") - passes * F.col("source_size")
    due = targets.filter("target >= 1").select("_nr", (passes * F.ceil(F.col("source_size") / block) + F.ceil(rest / block)).alias("_due"))
    due = due.join(placed.groupBy("_nr").agg(F.count(F.lit(1)).alias("_dealt")), "_nr", "left").withColumn("_dealt", F.coalesce("_dealt", F.lit(0)))
    late = due.filter("_dealt < _due").select("_nr", F.explode(F.sequence("_dealt", F.col("_due") - 1)).alias("_turn")).withColumn("slot", F.lit(slots) + F.col("_turn"))
    return turns.unionByName(late)


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """How many words of each document a mix of the sources takes, and where: doc_id, source, size, source_size, target, taken, first_slot, text_hash.

    Each source's documents, shuffled by MD5 of their id, form a stream of words cut into blocks of `block`. The
    schedule's slots are dealt to sources by golden-ratio points and numbered in each; the n-th slot of a source takes
    its n-th block, from the first again after the last, until the target is filled (the last block in part), so that each
    source is taken its target's whole words. A document gets the words that its blocks share with it. Null texts have size 0 and are taken 0 words; null sources are one source;
    repeated rows count each. A source's schedule and stream are numbered over many tasks, however large the source is.
    """
    spark = df.sparkSession
    base = stored(
        df.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_o"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text"),
        ), "mix-sizes",
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    joined = base.join(targets, base["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    if not words:
        return joined.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.col("_text").alias("text_hash"))
    stream = numbered(joined.filter("size > 0"), ["_nr"], ["_o", "doc_id", "size", "_text"], F.substring("_o", 1, 3), "_at", "size")
    blocks = F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))
    pieces = stream.withColumn("_block", F.explode(blocks))
    turns = _schedule(spark, targets, words, block).join(targets.select("_nr", "source_size", "target"), "_nr")
    per_pass = F.ceil(F.col("source_size") / block)
    turns = turns.withColumn("_block", F.col("_turn") % per_pass).withColumn("_pass", F.floor(F.col("_turn") / per_pass))
    ahead = F.col("_pass") * F.col("source_size") + F.col("_block") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("_block") * block)
    turns = turns.withColumn("_take", F.least(length, F.floor(F.col("target")) - ahead)).filter("_take > 0").select("_nr", "_block", "_take", "slot")
    start = F.col("_block") * block
    common = F.least(F.col("_at") + F.col("size"), start + F.coalesce(F.col("_take"), F.lit(0))) - F.greatest(F.col("_at"), start)
    taken = (
        pieces.join(turns, ["_nr", "_block"], "left")
        .groupBy("_nr", "_at", "doc_id", "source", "size", "source_size", "target", "_text")
        .agg(F.sum(F.greatest(common, F.lit(0))).cast("long").alias("taken"), F.min(F.when(common > 0, F.col("slot"))).cast("long").alias("first_slot"))
    )
    empty = joined.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), "_text")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "_text").unionByName(empty).withColumnRenamed("_text", "text_hash")


def mixed_texts(df: DataFrame) -> DataFrame:
    """The rows of `df` that the mix takes, one for each time: whole texts, and one in a source cut to its first words.

    Rows that are equal in id, source and text are one row with the sum of what is taken of them; so a row that repeats
    very often meets no other row of its key. Other columns of such rows are those of one of them.
    """
    taken = mix(df).filter("taken > 0").groupBy("doc_id", "source", "size", "text_hash").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    taken = stored(taken.select(F.struct("*").alias("_t")), "mix-taken")
    held = df.select(F.struct("*").alias("_d"), F.xxhash64("text").alias("_h"))
    same = F.col("_d.doc_id").eqNullSafe(F.col("_t.doc_id")) & F.col("_d.source").eqNullSafe(F.col("_t.source")) & (F.col("_h") == F.col("_t.text_hash"))
    joined = held.join(taken.filter("_t.rows = 1"), same).select("_d", "_t")
    again = taken.filter("_t.rows > 1")
    if not again.isEmpty():
        joined = joined.unionByName(held.join(again, same).groupBy("_t").agg(F.min_by("_d", F.xxhash64("_d")).alias("_d")))
    size, total = F.col("_t.size"), F.col("_t.taken")
    each = joined.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / size)))).withColumn("_w", F.least(size, total - F.col("_pass") * size))
    part = F.array_join(F.slice(F.regexp_extract_all("_d.text", F.lit(WORD), 0), F.lit(1), F.col("_w").cast("int")), " ")
    text = F.when(F.col("_w") < size, part).otherwise(F.col("_d.text"))
    return each.select(*[text.alias("text") if c == "text" else F.col("_d")[c].alias(c) for c in df.columns])


def op8_golden_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' shares and first places in a mix of the sources."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o, row_number() OVER (ORDER BY doc_id, text) AS tie
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nr
  FROM d GROUP BY source),
w AS (SELECT *, CASE nr % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS words,
         coalesce(sum(cap) OVER (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(w) OVER (ORDER BY cap / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w),
c AS (SELECT *, (words - before) / weights >= cap / w AS cut FROM l),
t AS (
  SELECT source, source_size, nr,
         CASE WHEN cut THEN cap ELSE (words - sum(CASE WHEN cut THEN cap ELSE 0.0::DOUBLE END) OVER ())
              / sum(CASE WHEN cut THEN 0.0::DOUBLE ELSE w END) OVER () * w END AS target
  FROM c),
u AS (SELECT *, floor(target)::BIGINT AS filled FROM t),
a AS (
  SELECT d.*, u.source_size, u.target, u.filled,
         coalesce(sum(size) OVER (PARTITION BY u.nr ORDER BY d.o, d.doc_id, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
r AS (
  SELECT nr, source_size, filled, coalesce(sum(target) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) / (SELECT sum(target) FROM t) AS lo,
         sum(target) OVER (ORDER BY nr ROWS UNBOUNDED PRECEDING) / (SELECT sum(target) FROM t) AS hi,
         filled // source_size * ((source_size + 127) // 128) + (filled % source_size + 127) // 128 AS due
  FROM u WHERE source_size > 0),
n AS (SELECT ceil((SELECT sum(target) FROM t) * 1.02::DOUBLE / 128)::BIGINT AS slots),
p AS (SELECT id, id * 0.6180339887498949::DOUBLE - floor(id * 0.6180339887498949::DOUBLE) AS p FROM (SELECT unnest(range(slots)) AS id FROM n)),
g AS (SELECT nr, id AS slot, row_number() OVER (PARTITION BY nr ORDER BY id) - 1 AS turn FROM p JOIN r ON p.p >= lo AND p.p < hi),
e AS (
  SELECT nr, slot, turn FROM g
  UNION ALL SELECT nr, slots + turn, turn FROM (SELECT r.nr, unnest(range(coalesce(dealt, 0), due)) AS turn FROM r LEFT JOIN (SELECT nr, count(*) AS dealt FROM g GROUP BY nr) x ON x.nr = r.nr), n),
k AS (
  SELECT e.nr, slot, turn % ((source_size + 127) // 128) * 128 AS start,
         least(128, source_size - turn % ((source_size + 127) // 128) * 128, filled - turn // ((source_size + 127) // 128) * source_size - turn % ((source_size + 127) // 128) * 128) AS take
  FROM e JOIN r ON e.nr = r.nr),
f AS (SELECT a.tie, min(slot) AS first_slot FROM a JOIN u ON a.source IS NOT DISTINCT FROM u.source JOIN k ON k.nr = u.nr AND k.take > 0 AND k.start < a.pos + a.size AND k.start + k.take > a.pos GROUP BY a.tie)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, filled - pos)) + least(size, greatest(0, filled - source_size - pos)))::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM a LEFT JOIN f ON a.tie = f.tie
"""
