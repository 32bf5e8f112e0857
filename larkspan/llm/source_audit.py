"""How far the sources of a language are from each other, and the terms that set a source apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stored

#: A language keeps the terms that so many of its documents hold; probabilities are counted in UNITs.
MIN_DOCS, UNIT = 10, 1_000_000_000
#: Ranks of a source's terms.
TOP = 10
#: Value bits that one histogram of the radix selection tells apart, and bytes of a term.
DIGIT_BITS, DIGIT_BYTES = 16, 2
#: A group of which at most so many rows (and TOP) can still be among the first is ranked as it is.
FEW = 1024
#: Terms that a task counts before it puts out what it has.
HELD_TERMS = 300_000

#: Bytes that are no part of a term become spaces, A-Z become lower case; bytes above 127 belong to letters of other scripts.
_TABLE = bytes(c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: how often a term occurs in the task's documents and in how many; a row with an empty term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        keys = [(g, t, n, docs[t]) for g, (words, docs) in groups.items() for t, n in words.items()]
        terms = pa.array([t for _, t, _, _ in keys], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g, *_ in keys], pa.string()), pa.array([g[1] for g, *_ in keys], pa.string()), terms, pa.array([k[2] for k in keys], pa.int64()), pa.array([k[3] for k in keys], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for text, *group in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            key = (group[0] or "", group[1] or "")
            if key not in groups:
                groups[key] = (Counter({b"": 0}), Counter())
            words, docs = groups[key]
            found = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_TABLE).split()
            before = len(words)
            words.update(found)
            docs.update(set(found))
            held += len(words) - before
            if held > HELD_TERMS:
                yield out()
                groups.clear()
                held = 0
    yield out()


def _share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (of + 2 * terms)), in decimals, since counts of a large corpus leave 64 bits; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * whole(n + 2), whole(F.nullif(of + 2 * terms, F.lit(0)))) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exact in 64 bits since both are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, total): the kept terms that occur in a source, with their count there and in the language; (lang, source, n, terms,
    total): all groups with their kept terms' count, the number of the language's kept terms, and their count in the language.

    Texts are read once. Tasks count their own terms, so a frequent term or source sends one row from a task.
    """
    text = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counted = text.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # One shuffle by term serves the sums by source and those by language.
    sums = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"total": F.sum("n").over(of_term), "in": F.sum("docs").over(of_term)})
    kept = stored(sums.filter((F.col("in") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "total"), "source-terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.countDistinct(F.nullif("term", F.lit(""))).alias("terms"))
    groups = stored(by_source.join(by_lang, "lang").select("lang", "source", "n", "terms", "total"), "source-groups")
    return kept.filter("term <> ''"), groups


def divergences(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value, from rows (lang, source, term, p) and groups (lang, source, terms, p0).

    Most terms are absent from most sources, and an absent term has the source's base share p0. So each source's distinct shares, with the
    number of terms that have them, are held against every other source's base share, both ways; what that says twice of terms absent from both
    is taken off, and only for terms that both hold is the difference to it summed. Sums are made in the tasks before they are shuffled; what is
    joined are shares by language and sources by term, never documents.
    """
    here = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    held = here.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    absent = groups.join(held, ["lang", "source"], "left").select("lang", "source", F.col("p0").alias("p"), (F.col("terms") - F.coalesce("held", F.lit(0))).alias("n"))
    shares = here.unionByName(absent).join(groups.select("lang", "source", "p0", "terms"), ["lang", "source"])
    g, h = shares.alias("g"), groups.alias("h")
    ends = [F.least("g.source", "h.source").alias("a"), F.greatest("g.source", "h.source").alias("b")]
    # Both ways are added up, and what they both count of the terms that neither holds is taken off once.
    one = F.col("g.n") * F.coalesce(_apart(F.col("g.p"), F.col("h.p0")), F.lit(0))
    against_base = g.join(h, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source"))).select(F.col("g.lang").alias("lang"), *ends, one.alias("v")).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    f, s = groups.alias("g"), groups.alias("h")
    twice = f.join(s, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") < F.col("h.source"))).select(
        F.col("g.lang").alias("lang"), *ends, (-F.col("g.terms") * F.coalesce(_apart(F.col("g.p0"), F.col("h.p0")), F.lit(0))).alias("v")
    )
    with_base = rows.join(groups.select("lang", "source", "p0"), ["lang", "source"]).select("lang", "source", "term", "p", "p0")
    x, y = with_base.alias("g"), with_base.alias("h")
    both = x.join(y, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.term") == F.col("h.term")) & (F.col("g.source") < F.col("h.source")))
    p, q, p0, q0 = (F.col(c) for c in ("g.p", "h.p", "g.p0", "h.p0"))
    shared = both.select(F.col("g.lang").alias("lang"), *ends, (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("v")).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    pairs = against_base.unionByName(twice).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    way = F.explode(F.array(*[F.struct(F.col(s).alias("source"), F.col(t).alias("item")) for s, t in ("ab", "ba")]))
    return pairs.select("lang", way.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def _refined(rows: DataFrame, digit: Column, top: bool) -> DataFrame:
    """rows (lang, source, item, value, wanted) that can still be among a group's `wanted` first by the digit: those before the boundary digit (done), and at it.

    The histogram has a row for each group and digit, made in the tasks first. `wanted` becomes what the boundary digit's rows still have to give.
    """
    rows = rows.withColumn("digit", digit)
    counts = rows.groupBy("lang", "source", "digit").agg(F.count(F.lit(1)).alias("m"), F.first("wanted").alias("want"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("digit") if top else F.asc("digit"))
    before = F.coalesce(F.sum("m").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = counts.withColumn("before", before).filter(F.col("before") < F.col("want"))
    # All digits before the boundary are taken whole; the boundary's rows are, too, if they are not too many.
    bounds = bounds.select("lang", "source", "digit", (F.col("want") - F.col("before")).alias("left"), "m")
    out = rows.join(bounds, ["lang", "source", "digit"]).withColumn("open", (F.col("m") > F.col("left") + FEW))
    return out.select("lang", "source", "item", "value", F.col("left").cast("int").alias("wanted"), "open")


def first_ranks(rows: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the `top` rows of each group by value (not negative) downwards, then by the item's UTF-8 bytes.

    A radix selection: a histogram over the value's highest bits finds where the group's top-th row lies; rows below are out, those above are in,
    and only the boundary's rows are looked at again, by the next bits, then by the item's bytes where values tie. It ends for a group as soon as
    few rows are left at the boundary; those that came so far, at most some FEW a digit, are then put in order.
    """
    rows = rows.select("lang", "source", "item", "value", F.lit(top).alias("wanted"))
    found, step, shift, at = None, rows, 64 - DIGIT_BITS, 1
    while True:
        if shift >= 0:
            digit = F.shiftrightunsigned(F.col("value"), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            after = stored(_refined(step, digit, True), "radix-values")
            shift -= DIGIT_BITS
        else:
            after = stored(_refined(step, F.substring(F.col("item").cast("binary"), at, DIGIT_BYTES), False), "radix-terms")
            at += DIGIT_BYTES
        done = after.filter("not open").drop("open", "wanted")
        found = done if found is None else found.unionByName(done)
        step = after.filter("open").drop("open")
        if step.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other of its language ('pair'), and the terms it has more of than its language ('term').

    Null lang, source and text are read as ''. A repeated row counts as often as it stands there; ids are not read, so null or repeated ones do
    not matter, and other columns may have any names. Documents without terms make their group known, a language without kept terms has pairs of
    value 0 and no terms, a source that is alone in its language has no pairs, and an empty table gives nothing. Texts and terms may be of any
    length; a task holds one text and the terms it counts.
    """
    terms, groups = term_counts(docs, min_docs)
    groups = groups.withColumn("p0", _share(F.lit(0), F.col("n"), F.col("terms")))
    of_group = groups.select("lang", "source", F.col("n").alias("of"), "terms", F.col("total").alias("of_lang"))
    share = terms.join(of_group, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("of"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("of_lang"), F.col("terms")).alias("q"))
    share = stored(share, "source-shares")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = divergences(share.select("lang", "source", "term", "p"), groups).withColumn("rank", rank)
    more = share.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    ranked = first_ranks(more, top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(ranked, "term"))


def op13_radix_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sources against each other and their terms against their languages'."""
    return source_divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
