"""Byte-level BPE over a trie of distinct words: shared prefixes are encoded once."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

#: How byte-level BPE cuts text into words before merging: contractions, letters, digits, other signs, white space.
#: Fixed values of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text whose new words are put into one trie.
STEP = 1 << 20
#: Distinct words, and their bytes, that a worker keeps encoded; beyond, it starts anew.
KEPT_WORDS, KEPT_BYTES = 200_000, 32_000_000
#: Distinct pairs of tokens whose fit a worker remembers.
KEPT_PAIRS = 120_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    """Encodes words with a byte-level BPE vocabulary by a trie's last-token states.

    The encoding of a word's prefix is that of a shorter prefix and one last token. A token that ends the prefix is the
    last one if BPE makes it of its own bytes and keeps the border between it and the last token before. Exactly one is. So each trie node needs one last token, found from its ancestors, and words
    that share a prefix share its nodes.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        bytes_of = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        ids = {bytes_of[t]: i for t, i in spec["model"]["vocab"].items()}
        self.token = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        # Inside, a token's number says when BPE can make it: a byte is itself, the result of the merge of rank r is 256 + r.
        self.number = {bytes([b]): b for b in range(256)}
        self.ids = [ids[bytes([b])] for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.number[left], self.number[right]
            self.pairs[pair] = 256 + rank
            self.number.setdefault(left + right, 256 + rank)
            self.parts.append(pair)
            self.ids.append(ids[left + right])
        self.sizes = [0] * len(self.ids)
        for data, n in self.number.items():
            self.sizes[n] = len(data)
        self.longest = max(self.sizes)
        # Only tokens that BPE makes of their own bytes can end a prefix.
        self.number = {data: n for data, n in self.number.items() if n < 256 or self.fit(*self.parts[n], n)}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def fit(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Does BPE keep the border between two tokens that stand side by side?

        Taking the two apart again, latest merge first, shows every pair of tokens that has met at the border, and the
        number below which a merge of that pair would have come before the merge just undone. `below` is the number of the merge
        that is allowed to join the two at last.
        """
        pairs, parts = self.pairs, self.parts
        while True:
            if pairs.get((left, right), below) < below:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                below, left = left, parts[left][1]
            else:
                below, right = right + 1, parts[right][0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Words are walked in sorted order, so the trie's path to the current node is a stack."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        number, fits, longest = self.number, self.fits, self.longest
        path: list[int] = []  # the last token of the prefix that ends after each byte of the current word
        earlier = b""
        for k in order:
            word = words[k]
            shared, most = 0, min(len(word), len(earlier))
            if word[:most] == earlier[:most]:
                shared = most
            else:
                while word[shared] == earlier[shared]:
                    shared += 1
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = number.get(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        pair = path[start - 1] << 20 | token
                        fitting = fits.get(pair)
                        if fitting is None:
                            if len(fits) >= KEPT_PAIRS:
                                fits.clear()
                            fitting = fits[pair] = self.fit(path[start - 1], token)
                        if fitting:
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                path.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(self.ids[path[end - 1]])
                end -= self.sizes[path[end - 1]]
            out[k] = ids[::-1]
            earlier = word
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet known, in one walk of their trie."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.known, self.held = {}, 0
            new = list(words)
        for w, ids in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
            self.known[w] = array("I", ids).tobytes()
            self.held += 100 + len(w) + 4 * len(ids)

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; a special token's string, in words it is not part of, is a piece of its own."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.words.findall(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers, in the machine's order (little-endian here)."""
        cut = [self.pieces(t) for t in texts]
        special = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.learn({w for words in cut for w in words} - special.keys())
        known = self.known
        if any(s in text for text in texts for s in special):
            known = known | special
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: their tokens' bytes as UTF-8, with U+FFFD for what is none."""
        return b"".join(map(self.token.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> TrieEncoder:
    """A worker's encoder, kept from task to task."""
    return TrieEncoder(vocabulary)


def _read(spark: SparkSession, path: str) -> str:
    """A vocabulary file's text, from the driver's disk or from a store that Spark reads; its size is checked."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        text = spark.read.text(path, wholetext=True).first()[0]
    if len(text) > 64_000_000:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    return text


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_column(df: DataFrame, path: str, decode: bool = True, digests: bool = False) -> DataFrame:
    """Every text's token ids: doc_id, ids (array of int) and, with `decode`, the text decoded from them; with `digests`
    instead of that text n_tokens and SHA-256 digests of the ids and of the decoded text.

    As the tokenizers library encodes with add_special_tokens=False: strings of special tokens become those tokens. Null
    texts count as empty: no ids. `path` is the vocabulary's file; its content (checked: under 64 MB) is broadcast, so workers need
    no file. Each task inserts its batch's new distinct words into one trie. Long words of any length cost time in
    proportion. Row by row, without a shuffle; repeated rows stay.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(_read(spark, path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value)
        for batch in slices(batches, limit=STEP):
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            flat = pa.array(memoryview(b"".join(ids)).cast("i"), pa.int32()) if any(ids) else pa.array([], pa.int32())
            ends = [0]
            for x in ids:
                ends.append(ends[-1] + len(x) // 4)
            cols = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}
            if digests:
                cols["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
                cols["ids_sha256"] = pa.array([_sha(x) for x in ids], pa.string())
                cols["decoded_sha256"] = pa.array([_sha(coder.decode(x).encode("utf-8", "surrogatepass")) for x in ids], pa.string())
            elif decode:
                cols["decoded"] = pa.array([coder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = ", n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ", decoded string" * decode
    return df.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>" + more)


def encoded(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, and SHA-256 digests of the ids and of the text decoded from them, of every text."""
    return encode_column(df, path, digests=True)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as counts and digests."""
    return encoded(documents(spark, sf_dir), default_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
