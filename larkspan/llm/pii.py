"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a trained classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stored

#: Kinds of spans in the order in which spans that start together are listed. The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "name", "secret")
BASE = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPELLED = re.compile(r"([A-Za-z0-9._%+-]{2,64})\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?([A-Za-z0-9-]{2,63})\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?([A-Za-z]{2,24})\b")
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?")
#: What follows a key word and = or :, key formats of well-known services, and long runs of letters and digits.
_ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|passwort|pwd|token|secret|bearer|(?:api|access|auth|private)[_-]?key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?([^\s\"'<>,;]{6,})")
_ASSIGNING = re.compile(r"(?i)(?:passw(?:or)?d|passwort|pwd|token|secret|bearer|key)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?$")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,})(?![A-Za-z0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")
_HEX = re.compile(r"[0-9a-fA-F]+")

#: Gazetteers and cue words (fixed values): ends of domains, given names, words that stand before personal data or before
#: what merely looks like it.
ENDS = frozenset("com org net edu gov io info biz de fr es it uk us eu ch at nl".split())
GIVEN = frozenset("james mary john anna peter maria thomas laura paul julia carlos lucia pierre marie hans eva juan ana michael sarah".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "kontakt", "courriel"),
    "ip": ("ip", "host", "server", "address", "from", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "dial", "telefon", "teléfono"),
    "ssn": ("ssn", "social", "security"),
    "name": ("dear", "contact", "signed", "regards", "by", "hello"),
    "secret": ("password", "passwd", "passwort", "pwd", "token", "secret", "key", "apikey", "bearer", "credential", "contraseña", "clave"),
}
AGAINST = ("version", "v", "id", "isbn", "serial", "order", "no", "nr", "section", "page", "commit", "sha", "md5", "checksum", "hash", "digest")
UNITS = ("kg", "km", "cm", "mm", "m", "px", "mb", "gb", "eur", "usd", "percent", "pages", "times")

#: The labelers, in the order of their votes in a pattern: strict format, checksum or range, gazetteer, cue before, counter-cue
#: before, and what stands behind.
LABELERS = ("format", "check", "gazetteer", "cue", "counter", "behind")
#: What the classifier sees besides votes and kind: the span's length (by doubling), its kind of characters, the character before and the one behind.
SHAPE = ("0123456789", "dxum", " =:q.", " q.")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of e-mail addresses, IPv4 addresses, card numbers and phone numbers, leftmost and apart per kind.

    The same matches as searching the patterns from left to right, found in time that grows with the text's length: an
    address is sought from its @ outwards, and long runs of digits or dots are read once.
    """
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    if any(c in text for c in "0123456789"):
        for m in _DOTTED.finditer(text):
            parts = m.group().split(".")
            pos = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((1, pos, pos + size))
                pos += size + 1
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        for m in _PLUS.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def wider_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base patterns: spelled-out addresses, national phone numbers, social security numbers, titled
    names and secrets (passwords, tokens, keys). Only what the trained classifier takes becomes a span."""
    found: list[tuple[int, int, int]] = []
    if "(dot)" in text or "[dot]" in text or " dot " in text:
        found += [(0, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += secrets(text)
        found += [(3, m.start(), m.end()) for m in _NATIONAL.finditer(text)]
        found += [(4, m.start(), m.end()) for m in _SSN.finditer(text)]
    found += [(5, m.start(), m.end()) for m in _TITLED.finditer(text)]
    return found


def secrets(text: str) -> list[tuple[int, int, int]]:
    """Spans that may be secrets, apart from each other: values of key words, known formats, and runs that mix letters and digits."""
    taken: list[tuple[int, int]] = [m.span(1) for m in _ASSIGNED.finditer(text)]
    for pattern in (_KNOWN, _RUN):
        starts = [a for a, _ in taken]
        more = []
        for m in pattern.finditer(text):
            i = bisect_right(starts, m.end() - 1) - 1
            run = m.group()
            if (i < 0 or taken[i][1] <= m.start()) and any(c.isdigit() for c in run) and not run.isdigit():
                more.append(m.span())
        taken = sorted(taken + more)
    return [(6, a, b) for a, b in taken]


_BEFORE = re.compile(r"[^\W\d_]+")


def votes(text: str, kind: int, start: int, end: int) -> str:
    """A letter for each labeler: + for personal data, - against, 0 for no opinion."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = "".join(c for c in span if c.isdigit())
    words = [w.lower() for w in _BEFORE.findall(before)][-3:]
    after = text[end : end + 16]
    if kind == 0:
        end_part = re.split(r"[.\x20]", span)[-1].lower()
        fmt, chk, gaz = "+" if "@" in span else "0", "+" if re.match(r"[A-Za-z0-9]", span) else "-", "+" if end_part in ENDS else "0"
    elif kind == 1:
        parts = span.split(".")
        fmt = "+" if all(str(int(p)) == p for p in parts) else "-"
        chk, gaz = "+" if 0 < int(parts[0]) < 224 else "-", "-" if span in ("127.0.0.1", "0.0.0.0", "255.255.255.255") else "0"  # noqa: S104
    elif kind == 2:
        fmt, chk = "+" if len(digits) in (15, 16) else "-", "+" if luhn(digits) else "-"
        gaz = "+" if digits[:1] in "3456" else "-"
    elif kind == 3:
        fmt = "+" if span[0] == "+" or re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", span) else "0"
        chk, gaz = "+" if len(set(digits)) > 2 else "-", "+" if span[0] in "+(" else "0"
    elif kind == 4:
        fmt, chk, gaz = "+", "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+", "0"
    elif kind == 6:
        known, hexa = bool(_KNOWN.fullmatch(span)), bool(_HEX.fullmatch(span))
        mixed = bool(digits) and any(c.islower() for c in span) and any(c.isupper() for c in span)
        assigned = bool(_ASSIGNING.search(before))
        fmt = "+" if known or mixed else "0"
        chk = "+" if len(set(span)) >= 8 and digits and len(digits) < len(span) else "-"
        gaz = "+" if known or assigned else "-" if hexa else "0"  # a bare run of hexadecimal digits is mostly a digest
    else:
        names = [w.lower() for w in _BEFORE.findall(span)][1:]
        fmt, chk, gaz = "0", "+" if len(names) > 1 else "0", "+" if names[0] in GIVEN else "-"
    cue = "+" if any(w in CUES[KINDS[kind]] for w in words) else "0"
    counter = "-" if any(w in AGAINST for w in words) else "0"
    quoted = before[-1:] in ("'", '"') and after[:1] == before[-1:]
    following = _BEFORE.match(after.lstrip())
    behind = "-" if following and following.group().lower() in UNITS else "+" if quoted else "0"
    return fmt + chk + gaz + cue + counter + behind


def shape(text: str, start: int, end: int) -> str:
    """A character for each part of SHAPE: d digits only, x hexadecimal, u letters and digits, m other; q a quote, . other."""
    span, left, right = text[start:end], text[start - 1 : start], text[end : end + 1]
    chars = "d" if span.isdigit() else "x" if _HEX.fullmatch(span) else "u" if span.isalnum() else "m"
    side = lambda c, known: " " if not c or c.isspace() else "q" if c in "\"'" else c if c in known else "."
    return str(min(9, (end - start).bit_length())) + chars + side(left, "=:") + side(right, "")


CANDIDATES = "doc_id long, found array<struct<kind:int, start:int, stop:int, base:boolean, pattern:string>>"
_ITEM = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            rows.append([
                {"kind": k, "start": a, "stop": b, "base": is_base, "pattern": f"{KINDS[k]}|{votes(text, k, a, b)}|{shape(text, a, b)}"}
                for group, is_base in ((base, True), (wider_spans(text), False)) for k, a, b in group
            ])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_ITEM))], names=["doc_id", "found"])


def estimate(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """How likely a candidate with each vote pattern is personal data, by expectation-maximisation.

    Dawid and Skene's model with a share per kind and, per labeler, how often its + and - are right of personal data and of
    other things. A 0 is no opinion and tells nothing. It starts from the majority of the votes; counts start with prior
    ones, and a labeler is held to be no worse than chance, so that a + never speaks against nor a - for.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    kind = np.array([KINDS.index(k.split("|")[0]) for k in keys])
    vote = np.array([["-0+".index(c) for c in k.split("|")[1]] for k in keys])
    lead = (vote - 1).sum(1)
    p = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, 0.5))
    for _ in range(rounds):
        logit = np.log((np.bincount(kind, n * p, len(KINDS)) + 1) / (np.bincount(kind, n * (1 - p), len(KINDS)) + 1))[kind]
        for j in range(vote.shape[1]):
            right, wrong = np.bincount(vote[:, j], n * p, 3) + [1, 0, 4], np.bincount(vote[:, j], n * (1 - p), 3) + [4, 0, 1]
            rate = [c / (c[0] + c[2]) for c in (right, wrong)]
            weight = np.array([min(0, np.log(rate[0][0] / rate[1][0])), 0, max(0, np.log(rate[0][2] / rate[1][2]))])
            logit += weight[vote[:, j]]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


_SHAPE_AT = np.cumsum([3 * len(LABELERS) + len(KINDS), *map(len, SHAPE)])


def _features(pattern: str) -> list[int]:
    """Places of what a pattern says: votes, kind, and the span's shape and neighbours."""
    kind, vote, form = pattern.split("|")
    said = [3 * j + "-0+".index(c) for j, c in enumerate(vote)]
    seen = [int(_SHAPE_AT[j]) + SHAPE[j].index(c) for j, c in enumerate(form)]
    return [*said, 3 * len(LABELERS) + KINDS.index(kind), *seen]


def train_spans(patterns: dict[str, int], steps: int = 400) -> dict[str, float]:
    """The final classifier: logistic regression on votes, kind, shape and neighbours, fitted to EM's posteriors with the patterns' counts.

    Returns each pattern's probability. EM sees the votes only; the classifier also sees the span and what stands beside
    it, one by one, so a rare pattern borrows from common ones instead of resting on its own few cases.
    """
    if not patterns:
        return {}
    soft = estimate(patterns)
    keys = sorted(patterns)
    x = np.zeros((len(keys), int(_SHAPE_AT[-1]) + 1))
    for i, k in enumerate(keys):
        x[i, _features(k)] = 1
    x[:, -1] = 1
    n, y = np.array([patterns[k] for k in keys], float), np.array([soft[k] for k in keys])
    # Each pattern counts by the root of its cases: what is common leads, what is rare is still heard.
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (p - y)) + 1e-3 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def find_spans(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (array of kind, start, stop, base, p) of every text: base spans, and what the classifier adds.

    Offsets count code points, the end is exclusive. Base spans always stay; a wider candidate is added where its
    probability reaches `threshold` and it touches no span taken before it. Candidates, not texts, are stored; what goes to the driver is
    one count per pattern of kind, votes and shape, of which there is a fixed number. Null and empty texts have no spans,
    repeated rows stay, an empty table gives none. A text's candidates are sorted once, so long texts take time in proportion.
    """
    base = stored(df.select("doc_id", "text").mapInArrow(_candidates, CANDIDATES), "pii-candidates")
    counted = base.select(F.explode("found").alias("f")).groupBy("f.pattern").count().collect()
    likely = train_spans({r["pattern"]: r["count"] for r in counted})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                kept = [f | {"p": likely[f["pattern"]]} for f in found if f["base"]]
                # Base spans may overlap those of other kinds: joined, they and the added ones are apart and in order.
                joined: list[list[int]] = []
                for a, b in sorted((f["start"], f["stop"]) for f in kept):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                starts, free = [a for a, _ in joined], 0
                for f in sorted((f for f in found if not f["base"]), key=lambda f: (f["start"], f["kind"])):
                    i = bisect_right(starts, f["stop"] - 1) - 1
                    if likely[f["pattern"]] >= threshold and f["start"] >= free and (i < 0 or joined[i][1] <= f["start"]):
                        kept.append(f | {"p": likely[f["pattern"]]})
                        free = f["stop"]
                kept.sort(key=lambda f: (f["start"], f["kind"]))
                rows.append([{"kind": KINDS[f["kind"]], "start": f["start"], "stop": f["stop"], "base": f["base"], "p": f["p"]} for f in kept])
            item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    return base.mapInArrow(decide, "doc_id long, spans array<struct<kind:string, start:int, stop:int, base:boolean, p:double>>")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' personal data: counts and a digest of the base spans, and all spans as text."""
    spans = find_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(kind)))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    secret = F.size(F.filter("spans", lambda s: s["kind"] == F.lit("secret"))).cast("long").alias("n_secret")
    return spans.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), secret, F.size("spans").cast("long").alias("n_spans"))
