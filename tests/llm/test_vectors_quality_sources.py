"""Vector codes, quality scores and the audit of sources against brute force, with the hard cases in small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspan.llm import quality, queries, source_audit, vector_codes
from larkspan.llm.common import documents

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Vector codes


def plain_codes(rows):
    """rows: (vec_id, embedding, label) with one length of vectors. (vec_id, code, error, label_error) of those that stay, and the digest."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 16
    parts = [[v[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    first = {}
    for (i, v, _), split in sorted(zip(kept, parts, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1])):
        if i is not None and i not in first and len(first) < 64:
            first[i] = split
    books = [[s[p] for s in first.values()] for p in range(16)]

    def assigned():
        out = []
        for split in parts:
            out.append([min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])) for p, part in enumerate(split)])
        return out

    for _ in range(2):
        found = assigned()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [split[p] for split, a in zip(parts, found, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found, of_label = assigned(), Counter()
    for (_, _, k), a in zip(kept, found, strict=True):
        of_label[k] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), of_label[k]) for (i, _, k), a in zip(kept, found, strict=True)], digest


def vectors(seed, n, width=32):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**9), [rng.choice([-1.0, -0.25, 0.0, 0.003, 0.5, rng.uniform(-2, 2)]) for _ in range(width)], rng.choice([None, 1, 2])) for _ in range(n)]
    rows += [(7, None, 1), (8, [float("nan")] * width, 1), (9, [float("inf")] + [0.0] * (width - 1), 2), (10, [None] + [0.0] * (width - 1), 2), (None, [0.125] * width, None), (None, [0.125] * width, 3)]
    return [*rows, rows[0], rows[1], (rows[2][0], [0.1] * width, 4)]


@pytest.mark.parametrize("n", [3, 150])
def test_codes_equal_brute_force(spark, n):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("code", F.lit("clash")).withColumn("_label", F.lit(1))
    books = vector_codes.train(df)
    got = vector_codes.label_errors(vector_codes.encoded(df, books)).collect()
    want, digest = plain_codes(rows)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter(want)
    assert books.sha256() == digest


def test_annulus_is_exact_and_skips_entries():
    rng = np.random.default_rng(4)
    for _ in range(30):
        entries = rng.integers(-3, 4, (64, 4)) * rng.integers(1, 60, (64, 1))
        points = np.concatenate([rng.integers(-200, 200, (300, 4)), entries[:20]])
        index, distance, tried = vector_codes.annular_nearest(points, entries)
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()
        assert tried < d.size
    big = (1 << 27) - 1
    index, distance, _ = vector_codes.annular_nearest(np.array([[big, -big]]), np.array([[-big, big], [big, -big + 1]]))
    assert index.tolist() == [1] and distance.tolist() == [1]


def test_vectors_that_no_codebook_holds(spark):
    rows = [(3, [0.5] * 16, 1), (4, [0.25] * 16, 1), (5, [0.5] * 32, 1), (6, [], None), (7, [1e30] * 16, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.label_errors(vector_codes.encoded(df, vector_codes.train(df))).collect()}
    assert got == {3: ("00" * 16, 0, 0), 4: ("01" * 16, 0, 0), 5: (None, None, 0), 6: (None, None, None), 7: (None, None, None)}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)]):
        df = spark.createDataFrame(rows, VECTORS)
        books = vector_codes.train(df)
        assert books is None and vector_codes.encoded(df, books).count() == 0


# Quality


def test_neighbours_vote_as_a_loop_says():
    rng = np.random.default_rng(1)
    for known, prior in ((40, 0.7), (5, 0.4)):
        vectors = np.rint(rng.normal(size=(known, 8)) * 500).astype(np.float32)
        vectors[3] = vectors[4]
        model = quality.QualityModel(np.ones(1), np.ones((1, 1)), vectors, (rng.random(known) < prior).astype(float), prior)
        asked = np.concatenate([np.rint(rng.normal(size=(20, 8)) * 500), np.zeros((1, 8)), vectors[:5]]).astype(np.float32)
        for v, got in zip(asked, quality.vote(asked, model, 4), strict=True):
            cos = [float(v.astype(float) @ w.astype(float)) / max(1e-300, np.linalg.norm(w.astype(float))) for w in vectors]
            last = sorted(cos)[-4]
            near = [(max(c / max(1e-300, np.linalg.norm(v.astype(float))), 0) ** 4, g) for c, g in zip(cos, model.good, strict=True) if c >= last]
            good, bad = sum(w * g for w, g in near) / prior, sum(w * (1 - g) for w, g in near) / (1 - prior)
            assert got == pytest.approx(good / (good + bad) if good + bad else prior)


def test_counts_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    texts = ["", None, "a", "Two words", "Ünï code\nlines " * 50, "again again again again", "x" * 3000]
    alone = [quality.counted(pa.array([t], pa.string()))[0] for t in texts]
    together = quality.counted(pa.array(texts, pa.string()))
    assert all((a == b).all() for a, b in zip(alone, together, strict=True))
    monkeypatch.setattr(quality, "WINDOW", 37)
    assert (quality.counted(pa.array(texts, pa.string())) == together).all()
    data = b" Two words "
    pairs = Counter(int(x) for g in quality._grams(np.frombuffer(data, np.uint8)) for x in g)
    assert together[3].sum() == sum(pairs.values()) + 3 * (len(data) // 20 + 1)


def test_directions_span_the_rows():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        cols = np.sort(rng.choice(50, 8, replace=False)).astype(np.uint16) + np.uint16(100 * (k % 3))
        rows.append((cols, rng.integers(1, 300, 8).astype(np.uint16)))
    dense = np.concatenate([d for _, d in quality._blocks(rows)]).astype(float)
    found = quality.latent_directions(rows, 6) / quality.DIRECTION_STEPS
    exact = np.linalg.svd(dense, full_matrices=False)[1][:6]
    assert np.allclose(np.linalg.norm(dense @ found, axis=0), exact, rtol=0.02)
    assert np.allclose(found.T @ found, np.eye(6), atol=1e-2)


def test_held_out_labels_are_told(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op12_latent_neighbour_quality"](spark, "/root/testdata/sf0.01").collect()}
    ids = [r[0] for r in duckdb.sql("SELECT doc_id FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert sorted(got) == sorted(ids)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in got.items())
    said = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet' WHERE quality IS NOT NULL").fetchall()
    asked = [(got[d]["score"], q) for d, q in said if got[d]["held_out"]]
    good, bad = [s for s, q in asked if q], [s for s, q in asked if not q]
    assert np.mean([s >= 0.3 for s in good]) >= 0.98 and np.mean([s < 0.3 for s in bad]) >= 0.85


def test_held_out_labels_are_not_learned(spark):
    docs = documents(spark, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality.score(docs, quality.train(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_quality_of_hard_rows(spark):
    rows = [(1, "good words stand here in a line", "en", "a", 1), (2, "BAD!! BAD!! BAD!! BAD!!", "en", "a", 1), (3, None, "en", "a", 1), (3, None, "en", "a", 1), (None, "", None, None, 0), (4, "good words " * 200_000, "en", "b", 1), (6, "BAD!! BAD!!", "", "", 1), (7, "more good words in another line", None, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("good", F.lit(1)).withColumn("score", F.lit(2.0))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (4, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    none = quality.train(docs, labels.filter("false"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    nothing = docs.filter("false")
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0


# Sources


def plain_audit(rows, min_docs=10, top=10):
    words = [(g or "", s or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, g, s, _ in rows]
    out = []
    for lang in {w[0] for w in words}:
        held, counts = Counter(), defaultdict(Counter)
        for g, s, found in words:
            if g == lang:
                held.update(set(found))
                counts[s].update(found)
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = {s: {t: c[t] for t in kept} for s, c in counts.items()}
        everywhere = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(everywhere)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            for part, found in (("pair", [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]), ("term", [(apart(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]])):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return out


def spoken(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abéßñ字") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 20 + 10 * (i % 5)]).upper() + rng.choice(["", "!", "1", "_x", "'s"]) for _ in range(rng.randint(0, 30))), ["en", "", None, "fr"][i % 4], rng.choice(["a", "b", "é", None, "c" * (1 + i % 3)])) for i in range(n)]
    rows += [(1, None, "xx", "only"), (2, "", "yy", "p"), (2, "", "yy", "q"), (3, "word " * 40_000, "en", "long"), (None, "w" * 50_000, "en", "long")]
    rows = [(*r, 0) for r in rows]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("few", [source_audit.FEW, 0])
def test_audit_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(source_audit, "FEW", few)
    monkeypatch.setattr(source_audit, "HELD_TERMS", 50)
    rows = spoken(3, 240)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("term", F.lit(1)).withColumn("value", F.lit(1))
    got = source_audit.source_divergence(docs, min_docs=4).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_audit(rows, 4))
    assert source_audit.source_divergence(docs.filter("false")).count() == 0


def test_ties_go_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "FEW", 0)
    items = [f"{a}{b}" for a in ("a", "aa", "aaaa", "é", "字") for b in ("", "a", "b", "\U0001f600")]
    rows = [("en", s, i, v) for s in ("x", "y") for v in (5, 70_000, 3 << 40) for i in {f"{i}{v % 7}" for i in items}] + [("en", "z", "one", 0)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    for top in (1, 7, 25, 1000):
        want = []
        for s in "xyz":
            found = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[2].encode()))[:top]
            want += [(*r, k) for k, r in enumerate(found, 1)]
        assert sorted(tuple(r) for r in source_audit.first_ranks(df, top).collect()) == sorted(want)


def test_shares_of_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**14, 7), (0, 0, 0), (5, 9, 2)], "n long, of long, v long")
    got = [r[0] for r in df.select(source_audit._share(F.col("n"), F.col("of"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (10**13 + 2) // (10**14 + 14), None, 1 + 10**9 * 7 // 13]


# The mix's schedule


def test_another_step_orders_the_mix_otherwise(spark, monkeypatch):
    from larkspan.llm import mixing

    docs = documents(spark, "/root/testdata/sf0.01")
    rows = {}
    for step in (mixing.GOLDEN, 0.41421356237309515):
        monkeypatch.setattr(mixing, "GOLDEN", step)
        rows[step] = {(r["doc_id"], r["text_hash"]): r for r in mixing.mix(docs).collect()}
    golden, other = rows.values()
    assert golden.keys() == other.keys() and all((r["first_slot"] is None) == (r["taken"] == 0) for r in golden.values())
    moved = sum(golden[k]["first_slot"] != other[k]["first_slot"] for k in golden)
    assert moved > len(golden) / 2
    for found in rows.values():
        words = defaultdict(int)
        for r in found.values():
            words[r["source"]] += r["taken"]
        assert all(abs(words[r["source"]] - r["target"]) <= mixing.BLOCK for r in found.values())


def test_every_stretch_of_the_mix_has_the_weights(spark):
    from larkspan.llm import mixing

    targets = spark.createDataFrame([("a", 400_000, 600_000.0, 0), ("b", 300_000, 240_000.0, 1), ("c", 90_000, 120_000.0, 2)], "source string, source_size long, target double, _nr int")
    rows = mixing._schedule(spark, targets, 960_000.0, 128).collect()
    slots = 7650
    assert len({r["slot"] for r in rows if r["slot"] < slots}) == slots
    for nr, share in ((0, 600 / 960), (1, 240 / 960), (2, 120 / 960)):
        mine = sorted(r["slot"] for r in rows if r["_nr"] == nr)
        assert [r["_turn"] for r in sorted((r for r in rows if r["_nr"] == nr), key=lambda r: r["slot"])] == list(range(len(mine)))
        assert all(abs(sum(a <= s < a + 500 for s in mine) - 500 * share) <= 4 for a in range(0, slots - 500, 250))
