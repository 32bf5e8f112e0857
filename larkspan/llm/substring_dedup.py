"""Removal of long repeated word sequences by suffix automata of reference shards, dealt by content-chosen seeds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stored
from .words import Words, mix64, powers

#: Words in a window, the length from which a repeat is removed, and in a seed, a shorter run of words inside each window.
WINDOW, SEED = 35, 12
#: Bits of the filter of seeds that occur more than once (8 MB, however large the input), and tasks that build it.
FILTER_BITS, FILTER_TASKS = 26, 8
#: Segments of one seed that one automaton holds; with more, they are dealt over several and the windows are compared across.
SHARD_SEGMENTS = 2000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """The suffix automaton of several word sequences, with how often (up to weights) each of its states occurs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last, self.breaks = 0, 0

    def _extend(self, word: int, weight: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new, p = len(nexts), self.last
        nexts.append({})
        length.append(length[p] + 1)
        self.count.append(weight)
        link.append(0)
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                self.count.append(0)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = twin
                    p = link[p]
        self.last = new
        return new

    def add(self, words: list[int], weight: int) -> list[int]:
        """Insert a sequence that occurs `weight` times; the state after each of its words. A sign of its own follows it, so no match spans two."""
        states = [self._extend(w, weight) for w in words]
        self.breaks -= 1
        self._extend(self.breaks, 0)
        return states

    def longest_repeats(self) -> list[int]:
        """For each state, the length of its longest suffix that occurs more than once: the matching statistics of what was added."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        count = list(self.count)
        for v in order:
            count[self.link[v]] += count[v]
        longest = [0] * len(count)
        for v in reversed(order):
            longest[v] = self.length[v] if count[v] > 1 else longest[self.link[v]]
        return longest


class Runs:
    """The windows of a column's texts in runs that share a seed.

    A window's seed is its least 12-word hash (the first, if several are equal), so equal windows have equal seeds at equal places. The
    windows around one seed are neighbours, at most 24; the words they cover are the seed's segment. text, start (word in the text),
    windows, seed and content (hash of the segment) have an entry for each run.
    """

    def __init__(self, col: pa.Array, window: int = WINDOW, seed: int = SEED):
        w = self.words = Words(col)
        self.window = window
        span, n = window - seed + 1, max(0, len(w) - window + 1)
        empty = np.empty(0, np.int64)
        self.at = self.text = self.start = self.windows = empty
        self.seed = self.content = np.empty(0, np.uint64)
        if not n:
            return
        values, places = w.grams(seed)
        grams = np.full(len(w), np.uint64((1 << 64) - 1))
        grams[places] = values
        least, width = grams, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[span - width : span - width + n])
        where = np.zeros(n, np.int64)
        for j in reversed(range(span)):
            hit = grams[j : j + n] == least
            where[hit] = np.flatnonzero(hit) + j
        valid = np.flatnonzero(w.text[:n] == w.text[window - 1 :])
        if not len(valid):
            return
        first = np.ones(len(valid), bool)
        first[1:] = (where[valid[1:]] != where[valid[:-1]]) | (np.diff(valid) != 1)
        begin = np.flatnonzero(first)
        self.at = valid[begin]
        self.windows = np.diff(np.append(begin, len(valid)))
        self.text = w.text[self.at]
        self.start = self.at - w.first[self.text]
        self.seed = least[self.at]
        power, inverse = powers(max(1 << 22, 1 << int(len(w)).bit_length()))
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w.hash * power[: len(w)], out=sums[1:])
        stop = self.at + self.windows + window - 1
        self.content = mix64((sums[stop] - sums[self.at]) * inverse[self.at] + (self.windows * 64 + where[self.at] - self.at).astype(np.uint64))


def _seed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        every = np.sort(Runs(batch.column("text")).seed)
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
        seeds, counts = every[begins], np.diff(np.append(begins, len(every)))
        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts)], names=["seed", "n"])


def _places(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(seeds)
    return h >> np.uint64(64 - FILTER_BITS), h & np.uint64((1 << FILTER_BITS) - 1)


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """Two bits of a table of fixed size for every seed; a seed without both set is surely not among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for place in _places(batch.column("seed").to_numpy().view(np.uint64)):
                bits[place.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in seeds.repartition(FILTER_TASKS).mapInArrow(work, "bits binary").collect():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


def _repeated(runs: Runs, bits: np.ndarray) -> np.ndarray:
    """The runs whose seed may occur more than once."""
    keep = np.ones(len(runs.seed), bool)
    for place in _places(runs.seed):
        keep &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(keep)


def _segments(sent):
    """The distinct segments of a slice of texts: seed, content, how often, and 32 bits of each word's hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = Runs(batch.column("text"))
            rows = _repeated(runs, sent.value)
            if not len(rows):
                continue
            rows = rows[np.lexsort((runs.content[rows], runs.seed[rows]))]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (runs.seed[rows[1:]] != runs.seed[rows[:-1]]) | (runs.content[rows[1:]] != runs.content[rows[:-1]])
            counts = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
            rows = rows[fresh]
            sizes = runs.windows[rows] + runs.window - 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(runs.at[rows] - ends[:-1], sizes) + np.arange(ends[-1])
            data = (runs.words.hash[take] >> np.uint64(32)).astype(np.uint32)
            blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(runs.seed[rows].view(np.int64)), pa.array(runs.content[rows].view(np.int64)), pa.array(counts.astype(np.int64)), blobs], names=["seed", "content", "n", "words"])

    return work


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build the automaton of each reference shard (the segments of one seed, which come together) and stream them through it.

    Puts out, per segment, a bit for each window that occurs more than once (mask); for a seed that is dealt over several
    shards also each window's hash, for the comparison across.
    """
    held: list[tuple[int, list[int], int]] = []
    key: tuple | None = None

    def shard() -> list[tuple]:
        if len(held) == 1 and not key[2]:
            content, words, n = held[0]
            return [(key[0], content, (1 << (len(words) - WINDOW + 1)) - 1 if n > 1 else 0, None)]
        auto = SuffixAutomaton()
        states = [auto.add(words, min(n, 2)) for _, words, n in held]
        longest, rows = auto.longest_repeats(), []
        for (content, words, _), path in zip(held, states, strict=True):
            mask = 0
            for i, state in enumerate(path[WINDOW - 1 :]):
                if longest[state] >= WINDOW:
                    mask |= 1 << i
            hashes = None
            if key[2]:
                hashes = [int.from_bytes(hashlib.blake2b(np.array(words[i : i + WINDOW], np.uint32).tobytes(), digest_size=8).digest(), "little", signed=True) for i in range(len(words) - WINDOW + 1)]
            rows.append((key[0], content, mask, hashes))
        return rows

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], names=["seed", "content", "mask", "windows"])

    for batch in batches:
        rows: list[tuple] = []
        for seed, salt, many, content, n, words in zip(*(batch.column(c).to_pylist() for c in ("seed", "salt", "many", "content", "n", "words")), strict=True):
            if key is not None and key[:2] != (seed, salt):
                rows += shard()
                held = []
            key = (seed, salt, many)
            held.append((content, np.frombuffer(words, np.uint32).tolist(), n))
        if rows:
            yield out(rows)
    if held:
        yield out(shard())


def _places_in_texts(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = Runs(batch.column("text"))
            rows = _repeated(runs, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(runs.text[rows])), pa.array(runs.start[rows].astype(np.int32)), pa.array(runs.seed[rows].view(np.int64)), pa.array(runs.content[rows].view(np.int64))], names=["row", "start", "seed", "content"])

    return work


def repeated_windows(df: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text) and at (array of start, mask): where the row's windows lie that occur more than once.

    Reference shards are made by seeds: equal windows have the same seed, so all segments with a seed that occurs more than once form one
    shard, and only documents with that seed are streamed through its automaton. Equal segments are in it once, with their number.
    A seed with very many unlike segments has several shards, whose windows are then compared by hash.
    """
    spark = df.sparkSession
    counts = df.select("text").mapInArrow(_seed_counts, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    sent = spark.sparkContext.broadcast(_seed_filter(counts.filter("n > 1").select("seed")))
    segments = (
        df.select("text").mapInArrow(_segments(sent), "seed long, content long, n long, words binary")
        .groupBy("seed", "content").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    )
    segments = stored(segments, "segments")
    large = segments.groupBy("seed").count().filter(F.col("count") > SHARD_SEGMENTS).select("seed", F.ceil(F.col("count") / SHARD_SEGMENTS).alias("shards"))
    dealt = segments.join(large, "seed", "left").withColumns({"many": F.col("shards").isNotNull(), "salt": F.pmod(F.col("content"), F.coalesce("shards", F.lit(1)))})
    dealt = dealt.select("seed", "salt", "many", "content", "n", "words").repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    found = stored(dealt.mapInArrow(_match, "seed long, content long, mask int, windows array<long>"), "matches")
    windows = found.filter("windows is not null").select("seed", "content", F.posexplode("windows").alias("i", "window"))
    twice = windows.groupBy("seed", "window").agg((F.count(F.lit(1)) > 1).alias("twice")).filter("twice").select("seed", "window")
    across = windows.join(twice, ["seed", "window"]).select("seed", "content", F.expr("shiftleft(1, i)").alias("mask"))
    masks = found.filter("windows is null and mask <> 0").select("seed", "content", "mask").unionByName(
        found.filter("windows is not null and mask <> 0").select("seed", "content", "mask").unionByName(across).groupBy("seed", "content").agg(F.bit_or("mask").alias("mask"))
    )
    places = df.select(row_key(), "text").mapInArrow(_places_in_texts(sent), "row long, start int, seed long, content long")
    return places.join(masks, ["seed", "content"]).groupBy("row").agg(F.collect_set(F.struct("start", "mask")).alias("at"))


def row_key():
    return F.xxhash64("doc_id", "text").alias("row")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: tuple[list, list, list] = ([], [], [])
        for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
            words = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
            gone = np.zeros(len(words) + 1, np.int32)
            for a in at or ():
                starts = a["start"] + np.flatnonzero([a["mask"] >> i & 1 for i in range(WINDOW - SEED + 1)])
                gone[starts] += 1
                gone[starts + WINDOW] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            out[0].append(len(words))
            out[1].append(int(len(words) - keep.sum()))
            out[2].append(b" ".join(words[i] for i in np.flatnonzero(keep)) if out[1][-1] else b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in out[2]], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document.

    A word goes if one of the 35-word windows over it has a word sequence that also starts anywhere else, in the same text or another;
    all occurrences go. Windows are judged on the input. Null and empty texts have no words; repeated rows are copies of
    each other like any others; an empty table gives none; null ids stay, and other columns, of any names, are not carried. Texts are
    compared by 64-bit hashes of seeds and segments, so a very long text is many segments, dealt like others.
    """
    at = repeated_windows(df)
    rows = df.select("doc_id", "text", row_key())
    return rows.join(at, "row", "left").select("doc_id", "text", "at").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def op2_automaton_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the word sequences that repeat, as counts and digests."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS run FROM v),
r AS (SELECT run FROM g GROUP BY run HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g WHERE run IN (SELECT run FROM r)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
k AS (SELECT p.doc_id, count(c.j) AS n_removed, string_agg(p.word, ' ' ORDER BY p.j) FILTER (WHERE c.j IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.j = p.j GROUP BY p.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
