"""Passages sought in documents: where they stand, and the text around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hours import bound

#: White space, the kinds beyond ASCII too; words are what stands between.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
#: Characters of context on each side, words of a passage that it is sought by, and letters by which part of a word is.
CONTEXT, KEY_WORDS, KEY_LETTERS = 60, 5, 3


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _run(words: Column, at: Column, n: int) -> Column:
    """A hash of n words in a row, from those of the words."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def _hashed(use: Callable[[Column], Column]) -> Column:
    """`use` of the words' hashes: each word is hashed once, however many rows of words it is in."""
    return bound(F.transform("w", lambda x: F.xxhash64(x)), use)


def _runs(n: int) -> Column:
    """The distinct hashes of n words in a row."""
    return F.array_distinct(_hashed(lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _run(h, i, n))))


def _letters(n: int) -> Column:
    """Every n letters in a row."""
    runs = F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))
    return F.when(F.length("word") >= n, runs).otherwise(F.array().cast("array<string>"))


def _in_words(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id and item_id where a word of the document holds the passage's longest word (doc_id, w; item_id, w)."""
    part = F.get(F.array_sort("w", lambda a, b: F.length(b) - F.length(a)), 0)
    quotes = quotes.select("item_id", part.alias("part")).withColumn("key", F.substring("part", 1, KEY_LETTERS))
    words = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
    keyed = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*[_letters(n + 1) for n in range(KEY_LETTERS)]))).alias("key"))
    held = keyed.join(quotes, "key").filter(F.contains("word", "part")).select("word", "item_id").distinct()
    return words.join(held, "word").select("doc_id", "item_id")


def quote_hits(docs: DataFrame, quotes: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id, item_id, text, at, before, found, after: the first place of each passage (item_id, quote) in each document
    (doc_id, text) that holds it.

    A passage is sought as it stands, else with white space collapsed on both sides, else in lower case too. It may begin and
    end within a word. `at` counts in the text as it stands; `before`, `found` and `after` are collapsed. Passages without
    words are nowhere.

    The words within a passage are whole words wherever it stands, so passages and documents meet under up to five of
    them; those of one or two words meet documents with a word that holds the longer of theirs.
    """
    quotes = quotes.filter(F.length(collapse(F.col("quote"))) > 0).withColumn("w", _words(F.col("quote")))
    quotes = quotes.withColumn("k", F.least(F.lit(KEY_WORDS), F.greatest(F.lit(0), F.size("w") - 2)))
    split = docs.filter(F.col("text").isNotNull()).select("doc_id", _words(F.col("text")).alias("w"))
    pairs = split.sparkSession.createDataFrame([], quotes.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id").schema)
    for k in sorted(r["k"] for r in quotes.select("k").distinct().collect()):
        some = quotes.filter(F.col("k") == k)
        if not k:
            pairs = pairs.unionByName(_in_words(split, some))
            continue
        blocks = split.filter(F.size("w") >= k).select("doc_id", F.explode(_runs(k)).alias("block"))
        pairs = pairs.unionByName(blocks.join(some.select("item_id", _hashed(lambda h: _run(h, F.lit(1), k)).alias("block")), "block").select("doc_id", "item_id"))
    both = pairs.distinct().join(docs.select("doc_id", "text"), "doc_id").join(quotes.select("item_id", "quote"), "item_id")
    text, quote = collapse(F.col("text")), collapse(F.col("quote"))
    spaced = F.array_join(F.transform(F.split(quote, " "), _literal), SPACE)
    pattern = (
        F.when(F.contains("text", "quote"), _literal(F.col("quote"))).when(F.contains(text, quote), spaced)
        .when(F.contains(F.lower(text), F.lower(quote)), F.concat(F.lit("(?iu)"), spaced))
    )
    hits = both.withColumn("_p", pattern).filter("_p is not null").withColumn("_s", F.split("text", F.col("_p"), 2))
    head, tail = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    found = F.substring(F.col("text"), F.length(head) + 1, F.length("text") - F.length(head) - F.length(tail))
    one = lambda c: F.regexp_replace(c, SPACE, " ")
    return hits.select(
        "doc_id", "item_id", "text", F.when(tail.isNotNull(), F.length(head) + 1).cast("long").alias("at"),
        F.right(F.ltrim(one(head)), F.lit(context)).alias("before"), collapse(found).alias("found"), F.left(F.rtrim(one(tail)), F.lit(context)).alias("after"),
    )
