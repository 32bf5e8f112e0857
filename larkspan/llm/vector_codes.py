"""Product codes of vectors: each part's nearest codebook entry, found in the annulus of norms that can still hold it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored

#: Parts of a vector, entries of a part's codebook, rounds in which the entries move, and steps that a component of 1 has.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components stay below this, so that sums of squared differences are exact in 64 bits.
LIMIT = 1 << 27
#: Pairs of a part and an entry that are worked on at a time, and entries next in norm that give the first distance.
STEP, PROBES = 1 << 18, 4


@dataclass
class Codebooks:
    """entries: integers by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return PARTS * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def annular_nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest entry (ties to the lower index), the squared distance, and how many distances were computed.

    An entry whose norm differs from the point's by more than the best distance so far is farther away. So the entries
    are sorted by norm, those next in norm give a first distance, and a binary search finds the interval of norms that
    it allows, ends included. Only entries in this annulus are compared, in integers. The interval is a little wider than
    the square roots say, so that their rounding excludes no entry.
    """
    n, m = len(points), len(entries)
    squares = (entries * entries).sum(1)
    order = np.argsort(squares, kind="stable")
    by_norm, norms = entries[order], np.sqrt(squares[order].astype(float))
    mine = np.sqrt((points * points).sum(1).astype(float))
    best = np.full(n, np.iinfo(np.int64).max)
    first = np.clip(np.searchsorted(norms, mine) - PROBES // 2, 0, max(0, m - PROBES))
    for k in range(min(PROBES, m)):
        apart = points - by_norm[first + k]
        np.minimum(best, (apart * apart).sum(1), out=best)
    reach = np.sqrt(best.astype(float))
    slack = 1e-9 * (1 + mine + reach)
    lo, hi = np.searchsorted(norms, mine - reach - slack, "left"), np.searchsorted(norms, mine + reach + slack, "right")
    index, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    ends = np.cumsum(hi - lo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        width = (hi - lo)[at:to]
        starts = np.cumsum(width) - width
        row = np.repeat(np.arange(at, to), width)
        col = np.arange(int(width.sum())) - np.repeat(starts, width) + np.repeat(lo[at:to], width)
        apart = points[row] - by_norm[col]
        d = (apart * apart).sum(1)
        distance[at:to] = np.minimum.reduceat(d, starts)
        index[at:to] = np.minimum.reduceat(np.where(d == distance[row], order[col], m), starts)
        at = to
    return index, distance, int(ends[-1]) + n * min(PROBES, m) if n else 0


def _kept(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector without null or non-finite components, and each row's length."""
    col = batch.column("vector")
    lengths = pc.list_value_length(col).fill_null(0).to_numpy()
    ends = np.cumsum(lengths)
    flat = col.flatten()
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)))])
    return (bad[ends] == bad[ends - lengths]) & np.asarray(pc.is_valid(col)), lengths


def _integers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that stay, those of them that have a code (`dim` components within LIMIT), and the integers of these."""
    kept, lengths = _kept(batch)
    coded = kept & (lengths == dim)
    values = np.floor(batch.column("vector").filter(pa.array(coded)).flatten().to_numpy(zero_copy_only=False) * float(SCALE)).reshape(-1, dim)
    fits = (np.abs(values) < LIMIT).all(1)
    coded[np.flatnonzero(coded)[~fits]] = False
    return kept, coded, values[fits].astype(np.int64)


def _first_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length that has codes, a task's ENTRIES least ids, each with its least vector."""
    held: dict[int, dict[int, tuple[int, ...]]] = {}
    for batch in batches:
        lengths = _kept(batch)[1]
        ids = batch.column("vec_id")
        for dim in {int(x) for x in np.unique(lengths) if x and x % PARTS == 0}:
            _, coded, values = _integers(batch, dim)
            found = held.setdefault(dim, {})
            mine = ids.filter(pa.array(coded))
            real = np.flatnonzero(np.asarray(pc.is_valid(mine)))
            numbers = mine.fill_null(0).to_numpy()
            for i in real[np.argsort(numbers[real], kind="stable")]:
                v, number = tuple(values[i].tolist()), int(numbers[i])
                if number in found:
                    found[number] = min(found[number], v)
                elif len(found) < ENTRIES:
                    found[number] = v
                elif number < (last := max(found)):
                    del found[last]
                    found[number] = v
                else:
                    break
    rows = [(dim, i, v) for dim, found in held.items() for i, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([list(r[2]) for r in rows], pa.list_(pa.int64()))], names=["dim", "vec_id", "v"])


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def first_codebooks(df: DataFrame) -> Codebooks | None:
    """The parts of the ENTRIES least ids' vectors; None where no row has a code. The driver gets these rows only."""
    found = stored(_vectors(df).select("vec_id", "vector").mapInArrow(_first_ids, "dim int, vec_id long, v array<long>").groupBy("dim", "vec_id").agg(F.min("v").alias("v")), "first-vectors")
    least = found.orderBy("vec_id", "v").first()
    rows = found.filter(F.col("dim") == least["dim"]).orderBy("vec_id").limit(ENTRIES).collect() if least else []
    dropped(found)
    if not rows:
        return None
    return Codebooks(np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def _sums(sent):
    """A task's sum and count by part, entry and position, of the parts that are nearest to the entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        totals, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            _, _, values = _integers(batch, books.dim)
            for p, part in enumerate(np.split(values, PARTS, axis=1)):
                index, _, _ = annular_nearest(part, books.entries[p])
                np.add.at(totals[p], index, part)
                counts[p] += np.bincount(index, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        width = totals.shape[2]
        cols = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), totals[part, entry].ravel(), np.repeat(counts[part, entry], width)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["part", "entry", "position", "total", "n"])

    return work


def moved(df: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floor of the mean of the parts nearest to it; an entry that has none stays.

    Sums are made in the tasks, added up by Spark in decimals, which do not overflow, and one number for each component of
    the codebooks comes to the driver.
    """
    sent = df.sparkSession.sparkContext.broadcast(books)
    parts = _vectors(df).select("vector").mapInArrow(_sums(sent), "part int, entry int, position int, total long, n long")
    rows = parts.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()
    sent.destroy()
    entries = books.entries.copy()
    for r in rows:
        entries[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return Codebooks(entries)


def train(df: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after `rounds` of moving all entries; None where no row has a code."""
    books = first_codebooks(df)
    for _ in range(rounds if books else 0):
        books = moved(df, books)
    return books


def encoded(df: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code (an entry's index for each part, two hex digits each) and error (the squared distances' sum).

    Rows whose vector is null or holds null or non-finite components go. A vector of another length than the codebooks', or
    with components that no codebook can hold (LIMIT), stays with a null code and error. Ids need not be distinct and may
    be null, repeated rows have equal codes, equal distances go to the lower index; an empty table gives none, and other columns
    may have any names.
    """
    sent = df.sparkSession.sparkContext.broadcast(books)
    kind = df.schema["label"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            kept, coded, values = _integers(batch, books.dim) if books else (_kept(batch)[0], np.zeros(batch.num_rows, bool), np.empty((0, PARTS), np.int64))
            codes, errors = np.empty((len(values), PARTS), np.uint8), np.zeros(len(values), np.int64)
            for p, part in enumerate(np.split(values, PARTS, axis=1) if len(values) else []):
                codes[:, p], distance, _ = annular_nearest(part, books.entries[p])
                errors += distance
            place = np.where(coded, np.cumsum(coded) - 1, 0)[kept]
            absent = ~coded[kept]
            places = pa.array(place, mask=absent)
            code = pa.array([c.tobytes().hex() for c in codes], pa.string()).take(places)
            stay = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(stay), batch.column("label").filter(stay), code, pa.array(errors, pa.int64()).take(places)], names=["vec_id", "label", "code", "error"])

    return _vectors(df).mapInArrow(work, f"vec_id {df.schema['vec_id'].dataType.simpleString()}, label {kind}, code string, error long")


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over the rows of the label; rows without a label are one group.

    Sums are a table of their own, so that Spark sees its size: small, it is broadcast; large, the join is split where a label is crowded.
    """
    sums = stored(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")


def op11_annular_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' product codes, their errors, those of their labels, and the digest of the codebooks."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(df)
    codes = stored(encoded(df, books), "vector-codes")
    digest = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return label_errors(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """The assignment to codebook n, and codebook n + 1."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(range(1, w + 1), lambda j: (p.v[j] - c.v[j]) * (p.v[j] - c.v[j])))::BIGINT AS d FROM p JOIN c{n} c ON p.part = c.part)
  GROUP BY vec_id, part),
s{n} AS (
  SELECT part, entry, j, sum(x) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(1, w + 1)) AS j FROM a{n} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part)
  GROUP BY part, entry, j),
m{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY j) AS v FROM s{n} GROUP BY part, entry),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.part = c.part AND m.entry = c.entry),"""


OP11_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, w, v[part * w + 1:part * w + w] AS v FROM (SELECT vec_id, v, w, unnest(range(16)) AS part FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
c0 AS MATERIALIZED (SELECT p.part, f.entry, p.v FROM p JOIN f ON p.vec_id = f.vec_id),{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS digest FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS j FROM c2))
SELECT r.vec_id, r.code, r.error, sum(r.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, b.digest AS codebooks_sha256
FROM r JOIN k ON k.vec_id = r.vec_id CROSS JOIN b
"""
