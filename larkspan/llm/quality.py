"""A quality classifier: the labels of the nearest labelled texts in a latent space, weighted by similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, slices, stored
from .words import Words, utf8

#: Buckets that features are hashed into, and dimensions of the latent space.
BITS, DIMS = 14, 64
BUCKETS = 1 << BITS
#: At most so many labelled rows are learned from (by a hash of doc_id, so that reruns agree); the driver and a broadcast
#: hold no more than follows from it.
TRAIN_ROWS = 8192
#: Neighbours that vote, those that tie with the last included, and the power of the similarity that a vote weighs.
NEIGHBOURS, POWER = 12, 4
#: Bytes and rows worked on at a time, positions of a long text, and labelled vectors of one block of products.
STEP, ROWS, WINDOW, BLOCK = 1 << 17, 64, 1 << 20, 2048
#: Groups of tasks whose counts of documents are added up first.
GROUPS = 64
#: Passes of the subspace iteration, and directions beside DIMS.
PASSES, SPARE = 3, 8
#: Whole numbers for weights, directions and unit vectors. Products of whole numbers below 2^53 (2^24 for the last, in single
#: precision) are exact in any order, so equal texts have equal scores however they are batched.
WEIGHT_STEPS, DIRECTION_STEPS, VECTOR_STEPS = 64, 1 << 14, 4000
#: A text whose score reaches this is predicted to be of quality.
THRESHOLD = 0.3

_SHAPE = np.array([1 if c >= 128 or chr(c).islower() else 2 if chr(c).isupper() else 4 if chr(c).isdigit() else 5 if chr(c) == " " else 6 if chr(c) == "\n" else 8 + c % 24 for c in range(256)], np.uint32)


@dataclass
class QualityModel:
    """weights of buckets (by rarity), directions (bucket by dimension) and the labelled vectors, all whole numbers, with labels and label shares."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    prior: float


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each three bytes, and of the shapes (small, capital, digit, sign) of each five."""
    x = data.astype(np.uint32)
    letters = (x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]
    letters = (letters ^ (letters >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    s = _SHAPE[data]
    shapes = np.zeros(max(0, len(s) - 4), np.uint32)
    for i in range(5 if len(s) > 4 else 0):
        shapes = shapes * np.uint32(0x85EBCA6B) + s[i : len(s) - 4 + i] + np.uint32(7)
    shapes = (shapes ^ (shapes >> np.uint32(13))) * np.uint32(0x2C1B3C6D)
    return letters >> np.uint32(32 - BITS), shapes >> np.uint32(32 - BITS)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def counted(texts: pa.Array) -> np.ndarray:
    """How often each bucket's features occur in each text: a matrix of texts by buckets.

    A space stands before and behind each text. Features are triples of bytes, fives of their shapes, and the text's
    length, share of distinct features and share of words that repeat the word before, which count as a twentieth of its
    length. The bytes of a long text are worked on in windows.
    """
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(n), lengths + 2)
    padded[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), lengths)] = data
    counts = np.zeros(n * BUCKETS, np.int64)
    for at in range(0, len(padded), WINDOW):
        part, of = padded[at : at + WINDOW + 4], text[at : at + WINDOW + 4]
        for width, found in zip((3, 5), _grams(part), strict=True):
            found = found[:WINDOW]
            inside = of[: len(found)] == of[width - 1 : width - 1 + len(found)]
            counts += np.bincount(of[: len(found)][inside] * BUCKETS + found[inside], minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    held, total = np.count_nonzero(counts, axis=1), counts.sum(1)
    words = Words(texts)
    said_again = np.bincount(words.text[1:][(words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])], minlength=n)
    for i in range(n):
        rich, size = int(20 * held[i] / max(1, total[i])), int(lengths[i] + 2).bit_length()
        again = int(10 * said_again[i] / max(1, words.first[i + 1] - words.first[i]))
        for name in (f"rich {rich}", f"size {size}", f"again {again}"):
            counts[i, _bucket(name)] += (int(lengths[i]) + 2) // 20 + 1
    return counts


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=STEP):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's texts each bucket occurs, and how many texts there are."""
    counts, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in _steps(batches):
        counts += np.count_nonzero(counted(batch.column("text")), axis=0)
        rows += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([counts.tobytes()], pa.binary()), pa.array([rows], pa.int64())], names=["part", "counts", "n"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


def rarity(docs: DataFrame) -> np.ndarray:
    """The log of how rarely each bucket occurs, from all documents; the driver adds up GROUPS tables of 128 KB."""
    kind = "part int, counts binary, n long"
    sums = docs.select("text").mapInArrow(_held, kind).groupBy("part").applyInArrow(_added, kind).collect()
    held = sum((np.frombuffer(r["counts"], np.int64) for r in sums), np.zeros(BUCKETS, np.int64))
    return np.log((sum(r["n"] for r in sums) + 1) / (held + 1))


def weighted(counts: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Whole weights: the log of the count times rarity."""
    flat, out = counts.ravel(), np.zeros(counts.size)
    at = np.flatnonzero(flat)
    out[at] = np.rint(WEIGHT_STEPS * np.log1p(flat[at]) * rare[at % BUCKETS])
    return out.reshape(counts.shape)


def _unit(projected: np.ndarray) -> np.ndarray:
    """Vectors of VECTOR_STEPS length in whole numbers; what has no direction stays 0."""
    length = np.sqrt((projected * projected).sum(1, keepdims=True))
    return np.rint(projected / np.where(length > 0, length, 1) * VECTOR_STEPS).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text can be divided by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and good (0 or 1) of at most `limit` labelled documents that are not held out.

    An id with several labels is good if all say so, one with several rows is learned from once, by its least text; null
    labels and ids are left out. What is broadcast is the sample of labels, which `limit` bounds.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "good").agg(F.min("text").alias("text"))


def _blocks(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows as dense matrices of unit rows, a few at a time."""
    for at in range(0, len(rows), 4 * ROWS):
        some = rows[at : at + 4 * ROWS]
        dense = np.zeros((len(some), BUCKETS), np.float32)
        for i, (cols, values) in enumerate(some):
            dense[i, cols] = values / max(1.0, np.sqrt((values.astype(float) ** 2).sum()))
        yield at, dense


def latent_directions(rows: list[tuple[np.ndarray, np.ndarray]], dims: int = DIMS) -> np.ndarray:
    """The leading right singular vectors of the rows (columns, values), as whole numbers: randomised subspace iteration over blocks of rows.

    The largest component of a direction is positive, and the random start is fixed, so that reruns agree.
    """
    width = min(dims + SPARE, max(1, len(rows)))
    basis = np.random.default_rng(20241105).standard_normal((BUCKETS, width)).astype(np.float32)
    for _ in range(PASSES):
        basis = np.linalg.qr(basis)[0]
        after = np.zeros_like(basis)
        for _, dense in _blocks(rows):
            after += dense.T @ (dense @ basis)
        basis = after
    basis = np.linalg.qr(basis)[0]
    inner = np.zeros((width, width))
    for _, dense in _blocks(rows):
        y = (dense @ basis).astype(float)
        inner += y.T @ y
    values, turns = np.linalg.eigh(inner)
    found = basis @ turns[:, np.argsort(-values)[:dims]]
    signs = np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    return np.rint(found * np.where(signs == 0, 1, signs) * DIRECTION_STEPS)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> QualityModel:
    """Rarity from all documents, directions and labelled vectors from the labelled documents that are not held out.

    The sample's weights come to the driver, at most `limit` rows of BUCKETS, most of them 0. Without labels there are no
    vectors, and every text scores 0.5.
    """
    rare = rarity(docs)
    sample = stored(training_rows(docs, labels, limit), "quality-training")
    sent = docs.sparkSession.sparkContext.broadcast(rare)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            found = weighted(counted(batch.column("text")), sent.value)
            cols = [np.flatnonzero(f).astype(np.uint16) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("good"), pa.array([c.tobytes() for c in cols], pa.binary()), pa.array([f[c].astype(np.uint16).tobytes() for f, c in zip(found, cols, strict=True)], pa.binary())],
                names=["doc_id", "good", "cols", "weights"],
            )

    got = sorted(sample.select("doc_id", "text", "good").mapInArrow(sparse, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, good int, cols binary, weights binary").collect())
    sent.destroy()
    dropped(sample)
    rows = [(np.frombuffer(r["cols"], np.uint16), np.frombuffer(r["weights"], np.uint16)) for r in got]
    good = np.array([r["good"] for r in got], float)
    if not rows:
        return QualityModel(rare, np.zeros((BUCKETS, 1)), np.zeros((0, 1), np.float32), good, 0.5)
    directions = latent_directions(rows)
    # Not of unit rows but of the weights themselves, as texts are projected when they are scored.
    projected = np.stack([w.astype(float) @ directions[c] for c, w in rows])
    return QualityModel(rare, directions, _unit(projected), good, float(good.mean()))


def vote(vectors: np.ndarray, model: QualityModel, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Each vector's score: the good labels' part of its nearest labelled vectors' votes, each class weighed by how rare it is among all.

    Products with all labelled vectors are made block by block, exact. A vote weighs the cosine's fourth power, nothing if
    it is negative; those that tie with the last neighbour vote too. Where nothing votes the score is the share of good labels.
    """
    n, known = len(vectors), len(model.vectors)
    if not known or not 0 < model.prior < 1:
        return np.full(n, model.prior)
    products = np.concatenate([vectors @ model.vectors[a : a + BLOCK].T for a in range(0, known, BLOCK)], axis=1).astype(float)
    lengths = [np.sqrt((v.astype(float) ** 2).sum(1)) for v in (vectors, model.vectors)]
    cosines = products / np.where(lengths[1] > 0, lengths[1], 1)
    k = min(neighbours, known)
    last = np.partition(cosines, known - k, axis=1)[:, known - k]
    row, col = np.nonzero(cosines >= last[:, None])
    votes = np.maximum(cosines[row, col] / np.where(lengths[0] > 0, lengths[0], 1)[row], 0) ** POWER
    good = np.bincount(row, votes * model.good[col], n) / model.prior
    bad = np.bincount(row, votes * (1 - model.good[col]), n) / (1 - model.prior)
    return np.where(good + bad > 0, good / np.where(good + bad > 0, good + bad, 1), model.prior)


def score(df: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score, from 0 to 1, of every row of `df`.

    The model is broadcast (directions and at most TRAIN_ROWS vectors); row by row, without a shuffle, so repeated rows
    score alike, null ids stay, and an empty table gives none. Null texts are empty; an empty text has a size like
    others and so has neighbours. Other columns may have any names. A task holds a few texts at a time, a long text in windows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _steps(batches):
            projected = weighted(counted(batch.column("text")), model.rarity) @ model.directions
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vote(_unit(projected), model))], names=["doc_id", "score"])

    return df.select("doc_id", "text").mapInArrow(work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def op12_latent_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality scores by the votes of labelled texts that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
