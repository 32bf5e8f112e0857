"""Canonical exact digests of texts: normalise, fold, hash wide, and tell unlike texts in one bucket apart."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, slices, stored


def canonical(text: str | None) -> bytes:
    """Compatibility-normalised, case-folded text with runs of white space as one space and none at the ends, in UTF-8.

    A null text counts as empty. Folding can undo normal form, so what is not ASCII is normalised again after it.
    """
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def _digest(text: str | None) -> tuple[str, bytes]:
    form = canonical(text)
    return xxhash.xxh3_128_hexdigest(form), hashlib.sha256(form).digest()


def _told_apart(df: DataFrame, columns: list[tuple[str, str]], buckets: DataFrame) -> DataFrame:
    """Turn each bucket column into a fingerprint: the bucket itself, with a number behind it where unlike texts share it."""
    clashing = buckets.groupBy("_b").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).filter("_lo <> _hi").select("_b")
    numbers = (
        buckets.join(clashing, "_b", "left_semi").distinct()
        .withColumn("_nr", F.row_number().over(Window.partitionBy("_b").orderBy("_s")))
    )
    for bucket, sha in columns:
        n = numbers.select(F.col("_b").alias(bucket), F.col("_s").alias(sha), "_nr")
        df = df.join(n, [bucket, sha], "left").withColumn(bucket, F.when(F.col("_nr") > 1, F.concat_ws("-", bucket, "_nr")).otherwise(F.col(bucket))).drop("_nr")
    return df


DIGESTS = "doc_id long, n_chars long, bucket string, sha binary"


def fingerprint(df: DataFrame) -> DataFrame:
    """doc_id, n_chars and the exact fingerprint of every text; texts have one fingerprint if their canonical forms are equal.

    Buckets are 128-bit xxhash values. Inside a bucket the canonical bytes are compared through their SHA-256, which is
    carried instead of them; where they differ (never yet seen) the later forms get a number, so unlike texts never share
    a fingerprint. Null texts count as empty; repeated rows stay; an empty table gives none.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            both = [_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([b for b, _ in both], pa.string()), pa.array([s for _, s in both], pa.binary())], names=["doc_id", "n_chars", "bucket", "sha"])

    base = stored(df.select("doc_id", "text").mapInArrow(hashed, DIGESTS), "fingerprints")
    out = _told_apart(base, [("bucket", "sha")], base.select(F.col("bucket").alias("_b"), F.col("sha").alias("_s")))
    return out.select("doc_id", "n_chars", F.col("bucket").alias("fingerprint"))


EDITS = "kind int, part int, doc_id long, n_chars long, edited_sha256 binary, bucket string, sha binary, edited_bucket string, edited_sha binary, next_bucket string, next_sha binary, text string"


def _edited(doc_id, text: str, following: str, own: tuple, after: tuple) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    return (0, None, doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(), *own, *(own if edited == text else _digest(edited)), *after, None)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in EDITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one that follows it in this task's range; the first and the last text go out for the neighbours."""
    part, held = TaskContext.get().partitionId(), None
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            own = _digest(text)
            if held is None:
                rows.append((1, part, doc_id, None, None, None, None, None, None, None, None, text))
            else:
                rows.append(_edited(held[0], held[1], text, held[2], own))
            held = (doc_id, text, own)
        if rows:
            yield _rows(rows)
    if held is not None:
        yield _rows([(2, part, held[0], None, None, None, None, None, None, None, None, held[1])])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_edited(d, t, n, _digest(t), _digest(n)) for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        if rows:
            yield _rows(rows)


def fingerprint_edits(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and of the next document's text.

    The next document is the one with the next lower doc_id (null ids last, ties by text); after the last comes the first.
    An edited text has its last floor(n/2) code points replaced by the first as many, or all, of the next document's.
    The texts are dealt once by ranges of doc_id and read in order; only a range's first and last text are looked up
    across ranges, so no task and not the driver sees more than its range. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint and next_fingerprint. Null texts are empty; repeated ids and rows follow each other in the order of
    their texts, a single row is its own next, an empty table gives none, and other columns may have any names. A task holds two texts at a time.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    dealt = df.select("doc_id", "text").repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    base = stored(dealt.mapInArrow(_with_next, EDITS), "edits")
    heads = base.filter("kind = 1").select("part", F.col("text").alias("following"))
    ring = Window.orderBy("part")
    places = heads.select("part").withColumn("_to", F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.partitionBy())))
    tails = (
        base.filter("kind = 2").select("part", "doc_id", "text").join(places, "part")
        .join(heads.withColumnRenamed("part", "_to"), "_to").select("doc_id", "text", "following")
    )
    rows = base.filter("kind = 0").unionByName(tails.mapInArrow(_at_edges, EDITS))
    pairs = [("bucket", "sha"), ("edited_bucket", "edited_sha"), ("next_bucket", "next_sha")]
    buckets = rows.select(F.explode(F.array(*[F.struct(F.col(b).alias("_b"), F.col(s).alias("_s")) for b, s in pairs[:2]])).alias("x")).select("x.*")
    out = _told_apart(rows, pairs, buckets)
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.col("bucket").alias("fingerprint"), F.col("edited_bucket").alias("edited_fingerprint"), F.col("next_bucket").alias("next_fingerprint"))


def likeness(a: str, b: str):
    """Of two exact fingerprints: 1 if they are equal, else 0."""
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))


def op6_exact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprint_edits(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
