"""A linear toxicity classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, slices, stored
from .words import distinct

#: Lengths of the n-grams, and the buckets they are hashed into.
LENGTHS, BITS = (4, 5, 6), 20
#: At most so many labelled rows are learned from (by a hash of doc_id, so that reruns agree); the driver and a broadcast
#: hold no more than follows from it.
TRAIN_ROWS = 20_000
#: Bytes of text worked on at a time: small arrays stay in the processor's cache.
STEP = 1 << 17
#: Buckets with a weight: those that tell the two classes apart best.
FEATURES = 4096
#: Tasks that count n-grams of the training rows, and blocks of buckets that are added up and judged apart.
TRAIN_TASKS, BLOCKS = 12, 16
#: Training rows that one step of the fit works on at a time.
CHUNK = 2048
#: A text whose score reaches this is predicted toxic.
THRESHOLD = 0.3

_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[[c for c in range(128) if not chr(c).isalnum()]] = 32


@dataclass
class ToxicityModel:
    """Weight of each bucket (0 for most; the log-count ratio is multiplied in) and the constant term."""

    weights: np.ndarray
    bias: float


def ngram_hits(texts: list[str | None], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of the n-grams of lower-cased texts; with `wanted`, only of the buckets it marks.

    ASCII signs and white space count as spaces, and a space stands before and after each text. Null texts are empty.
    """
    parts = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _LOWER[np.minimum(codes, 127)], codes)
    ends = np.cumsum([len(p) for p in parts])
    found: list[np.ndarray] = []
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(codes):
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        if n not in LENGTHS:
            continue
        bucket = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        found.append(text[inside].astype(np.int64) << BITS | bucket[at[inside]])
    pairs = distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic (0 or 1) of at most `limit` labelled documents that are not held out.

    An id with several labels is toxic if one says so, one with several rows is learned from once, by its least text; null labels and
    ids are left out. The sample of labels is what is broadcast, and its bound is `limit`, so the documents are read once and only the
    sample's texts are shuffled.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of buckets and class, in how many texts of this task each bucket occurs, and how many texts there are."""
    counts, rows = np.zeros((2, 1 << BITS), np.uint16), [0, 0]
    for batch in slices(batches, limit=STEP):
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        text, bucket = ngram_hits(batch.column("text").to_pylist(), None)
        for k in (0, 1):
            counts[k] += np.bincount(bucket[toxic[text] == k], minlength=1 << BITS).astype(np.uint16)
            rows[k] += int((toxic == k).sum())
    cells = counts.reshape(2, BLOCKS, -1)
    sent = [pa.array([c.tobytes() for c in cells[k]], pa.binary()) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), *sent, *(pa.array([n] * BLOCKS, pa.int64()) for n in rows)], names=["block", "clean", "toxic", "n_clean", "n_toxic"])


def _judged(table: pa.Table) -> pa.Table:
    """A block's buckets that tell the classes apart best, with chi-square and log-count ratio; and a row with the totals (bucket null)."""
    counts = np.zeros((2, (1 << BITS) // BLOCKS), np.int64)
    for k, name in enumerate(("clean", "toxic")):
        for c in table.column(name):
            counts[k] += np.frombuffer(c.as_buffer(), np.uint16)
    totals = [sum(table.column(c).to_pylist()) for c in ("n_clean", "n_toxic")]
    n, held = sum(totals), counts.sum(0)
    ratio = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
    chi = np.zeros(len(held))
    if all(totals):
        expected = held * totals[1] / n
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.where((held >= 3) & (held < n), (counts[1] - expected) ** 2 / (expected * (1 - held / n) * (totals[0] / n)), 0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    best = best[chi[best] > 0]
    first = table.column("block")[0].as_py() * len(held)
    return pa.table({
        "bucket": pa.array([None, *(best + first).tolist()], pa.int32()), "chi": pa.array([0.0, *chi[best]], pa.float64()), "ratio": pa.array([0.0, *ratio[best]], pa.float64()),
        "n_clean": pa.array([totals[0]] * (len(best) + 1), pa.int64()), "n_toxic": pa.array([totals[1]] * (len(best) + 1), pa.int64()),
    })


def _fit(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float = 0.01, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty by accelerated full-batch gradient steps; the last weight is the constant."""
    n, m = len(rows), len(ratios)
    chunks = [rows[a : a + CHUNK] for a in range(0, n, CHUNK)]
    cols = [np.concatenate([*c, np.empty(0, np.uint16)]) for c in chunks]
    row_of = [np.repeat(np.arange(len(c), dtype=np.uint16), [len(r) for r in c]) for c in chunks]
    # Largest curvature, bounded by the greatest sum of absolute values of a row and of a column.
    row_sum = max(np.bincount(r, np.abs(ratios[c]), 1).max() for r, c in zip(row_of, cols, strict=True)) + 1
    col_sum = sum(np.bincount(c, np.abs(ratios[c]), m) for c in cols)
    step = 1 / (0.25 * row_sum * max(col_sum.max(initial=0), n) / n + penalty / n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    look_w, look_b, t = w, b, 1.0
    for _ in range(steps):
        back, total, look = np.zeros(m), 0.0, ratios * look_w
        for k, (r, c) in enumerate(zip(row_of, cols, strict=True)):
            part = y[k * CHUNK : (k + 1) * CHUNK]
            g = 1 / (1 + np.exp(-(np.bincount(r, look[c], len(part)) + look_b))) - part
            back += np.bincount(c, g[r], m)
            total += g.sum()
        back *= ratios
        new_w = look_w - step * (back / n + penalty / n * look_w)
        new_b = look_b - step * total / n
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn a model from the labelled documents that are not held out.

    The log-count ratio of a bucket is the log of how much likelier a toxic than a clean text is to hold it, from counts
    over all training rows (plus 1); they are added up and judged by block of buckets, so the driver gets no table of counts. The FEATURES buckets with the largest chi-square get a weight by logistic
    regression on presence times ratio. Without labels of both classes the model is the constant of what there is (0.5
    of two made-up rows mixed in), and every text scores alike.
    """
    sample = stored(training_rows(docs, labels, limit).repartition(TRAIN_TASKS), "toxic-training")
    counted = sample.mapInArrow(_counts, "block int, clean binary, toxic binary, n_clean long, n_toxic long")
    judged = stored(counted.groupBy("block").applyInArrow(_judged, "bucket int, chi double, ratio double, n_clean long, n_toxic long"), "toxic-buckets")
    said = judged.filter("bucket is null").first()
    clean, toxic = (said["n_clean"], said["n_toxic"]) if said else (0, 0)
    if not (clean and toxic):
        dropped(sample, judged)
        share = (toxic + 1) / (clean + toxic + 2)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    best = sorted((r["bucket"], r["ratio"]) for r in judged.filter("bucket is not null").orderBy(F.desc("chi"), "bucket").limit(FEATURES).select("bucket", "ratio").collect())
    chosen, ratio = np.array([b for b, _ in best], np.int64), np.array([x for _, x in best], float)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = sample.sparkSession.sparkContext.broadcast(place)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            text, bucket = ngram_hits(batch.column("text").to_pylist(), sent.value >= 0)
            cols = sent.value[bucket].astype(np.uint16)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            rows = [cols[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("toxic")], names=["cols", "toxic"])

    got = sorted((r["cols"], r["toxic"]) for r in sample.mapInArrow(present, "cols binary, toxic int").collect())
    sent.destroy()
    dropped(sample, judged)
    w, b = _fit([np.frombuffer(c, np.uint16) for c, _ in got], np.array([t for _, t in got], float), ratio)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratio
    return ToxicityModel(weights, b)


def score(df: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns `keep` of every row of `df` and, as `name`, its score: how likely the text is toxic, from 0 to 1.

    The model (4 MB) is broadcast; row by row, without a shuffle, so repeated rows score alike and an empty table gives
    none. Empty and null texts score by the constant term alone. A column of `keep` called `name` is replaced. A task
    holds one text's n-grams at a time.
    """
    keep = tuple(c for c in keep if c != name)
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    cols = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        wanted = weights != 0
        for batch in slices(batches, limit=STEP):
            text, bucket = ngram_hits(batch.column("text").to_pylist(), wanted)
            z = np.bincount(text, weights[bucket].astype(np.float64), batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*keep, name])

    return df.select(*cols).mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in [*keep]) + ("," if keep else "") + f" `{name}` double")


def op10_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity scores by a classifier learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
