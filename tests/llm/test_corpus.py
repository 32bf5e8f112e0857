"""The corpus operators against brute force on small tables with the hard cases in them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.llm import bpe_trie, fingerprints, line_dedup, media, mixing, ngram_join, pii, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(80), say(50)
    texts = [None, "", " \t\n ", "one", "one", "two words", base, base, base.upper(), base.replace(base.split()[40], "changed"), f"{say(30)} {passage} {say(20)}", f"{passage} {say(40)}", say(9000)]
    texts += ["\n".join([say(12), base, say(5)]), "\n".join([say(12), base, "", base]), "\r\n".join([base, say(3)]), "mail a.b@c.example.org, 10.0.0.255, 10.0.0.256.1.2.3.4, 4111 1111 1111 1111, +1 (555) 010-9999", "x@y", "écrire à é@b.co "]
    words = base.split()
    for i in range(25):
        near = list(words)
        for _ in range(i % 5):
            near[rng.randrange(len(near))] = "edit" + str(i)
        texts.append(" ".join(near))
    texts += [say(rng.randint(1, 120)) for _ in range(30)]
    rows = [(i * 3, t, "en", ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumn("text_", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("entry", F.lit(2))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_jaccard_groups(docs, nothing):
    rows = [(r[0], shingles(r[1])) for r in corpus()]
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, s in rows:
            for b, t in rows:
                if s and t and 100 * len(s & t) >= 75 * len(s | t) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = ngram_join.near_duplicate_groups(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, len(s), label[d]) for d, s in rows)
    assert ngram_join.near_duplicate_groups(nothing).count() == 0


def test_substring_dedup(docs, nothing):
    rows = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for d, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_many_segments_of_one_seed(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 2)
    rng = random.Random(3)
    middle = [f"m{i}" for i in range(30)]
    texts = [" ".join([rng.choice("xyz") for _ in range(6)] + middle + [rng.choice("xyz") for _ in range(6)]) for _ in range(40)]
    seen = Counter(tuple(t.split()[i : i + 35]) for t in texts for i in range(8))
    want = [sum(any(seen[tuple(t.split()[i : i + 35])] > 1 for i in range(max(0, j - 34), min(j, 7) + 1)) for j in range(42)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).orderBy("doc_id").collect()] == want


def test_line_dedup(docs, nothing):
    def tokens(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    rows = list(dict.fromkeys(corpus()))
    lines = [(r[0], i, x, tokens(x)) for r in rows if r[1] is not None for i, x in enumerate(r[1].split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = {(d, i) for k, (d, i, _, s) in enumerate(lines) if s and any(t and 100 * len(s & t) >= 75 * len(s | t) for *_, t in lines[:k])}
    want = {r[0]: None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], i) not in gone) for r in rows}
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(corpus())
    assert all(r["kept"] == want[r["doc_id"]] for r in got)
    assert {c for c in docs.columns if c != "text"} < set(got[0].asDict())
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_bpe_equals_the_library(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_trie.default_path())
    library.no_truncation()
    got = bpe_trie.encode_column(docs, bpe_trie.default_path()).collect()
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    assert bpe_trie.encoded(nothing, bpe_trie.default_path()).count() == 0


def test_media(docs, nothing):
    got = media.media_column(docs).collect()
    texts = {r[0]: (r[1] or "").encode() for r in corpus()}
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert media.decode_png(bytes(r["media"])).tobytes() == payload
    assert media.media_column(nothing).count() == 0


def test_broken_images():
    good = media.encode_png(bytes(range(64)) * 4)
    for bad in (b"", good[:-5], good[:40] + b"x" + good[41:], b"GIF89a" + good[6:]):
        with pytest.raises(media.BadImage):
            media.decode_png(bad)


def test_sharding(docs, nothing):
    got = sharding.shard_records(docs, "doc_id", [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == len(corpus())
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    assert sharding.shard_records(nothing, "doc_id", [1.0]).count() == 0


def test_weights_move_shares(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.shard_records(df, "doc_id", [3.0, 1.0, 0.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and abs(n[0] / 20000 - 0.75) < 0.02


def test_fingerprints(docs, nothing):
    got = fingerprints.fingerprint_edits(docs, 3).collect()
    rows = sorted(corpus(), key=lambda r: (-r[0], r[1] or ""))
    want = []
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        text, n = r[1] or "", len(r[1] or "") // 2
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - n] + (following[1] or "")[:n]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by_form: dict = {}
    for r in fingerprints.fingerprint(docs).collect():
        by_form.setdefault(fingerprints.canonical(dict((x[0], x[1]) for x in corpus())[r["doc_id"]]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_form.values()) and len(set.union(*by_form.values())) == len(by_form)
    assert fingerprints.fingerprint_edits(nothing, 3).count() == 0


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    assert len(got) == len(corpus())
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source in ("a", "b", None, "c"):
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.01 * rows[0]["target"] + mixing.BLOCK
    assert mixing.mix(nothing).count() == 0


def test_small_sources_fill_their_targets(spark):
    sizes = {"s000": [4000] * 10} | {f"s{i:03}": [1 + i * 7 % 299] for i in range(1, 60)} | {"s900": [129], "s901": [10], "s902": [1], "s903": [100, 0, 200]}
    docs = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, each in sizes.items() for n in each)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(got) == len(docs)
    for source in sizes:
        rows = sorted((r for r in got if r["source"] == source), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())
        filled = int(rows[0]["target"])
        assert sum(r["taken"] for r in rows) == filled
        passes, rest = divmod(filled, sum(sizes[source]))
        for r in rows:
            assert r["taken"] == passes * r["size"] + min(r["size"], rest)
            rest -= min(r["size"], rest)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_pii(docs, nothing):
    rng = random.Random(5)
    texts = {r[0]: r[1] or "" for r in corpus()}
    extra = {10_000 + i: "".join(rng.choice("a1.@-+ 4(") for _ in range(rng.randint(0, 60))) for i in range(400)}
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(list(extra.items()), "doc_id long, text string"))
    for r in pii.find_spans(df).collect():
        text = (texts | extra)[r["doc_id"]]
        assert [(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["base"]] == plain_spans(text), text
    assert pii.find_spans(nothing).count() == 0


def test_spelled_out_addresses():
    for at in ("(at)", "[at]", " at ", " (at) ", " [at] "):
        for dot in ("(dot)", "[dot]", " dot ", " (dot) ", " [dot] "):
            address = f"john{at}example{dot}com"
            assert (0, 6, 6 + len(address)) in pii.wider_spans(f"write {address} now"), address


def test_toxicity(spark, nothing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["plain", "calm", "walk", "tree", "stone"] + (["vile", "scum"] if i % 5 == 0 else [])) for _ in range(20)), "en", "a", 0) for i in range(600)]
    df = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert scores[9000] == scores[9001] < toxicity.THRESHOLD
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0


def test_repeated_ids_are_learned_from_once(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:12]
    df = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(50)] + [(ids[0], None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.training_rows(df, labels).collect()) == sorted((f"text {i} 0", i % 2) for i in ids)
    assert toxicity.training_rows(df, labels, 5).count() == 5


def test_jaccard_groups_by_leaders_alone(docs, monkeypatch):
    """No shingle makes its pairs at once: what leaders alone find is the same."""
    found = lambda: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_groups(docs).collect())
    plain = found()
    monkeypatch.setattr(ngram_join, "PAIRS_EACH", -1)
    monkeypatch.setattr(ngram_join, "SOME", 1)
    assert found() == plain
