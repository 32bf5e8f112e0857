"""Names, ids and addresses of web pages as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which place is meant (fixed values).
STOP_WORDS = ("le", "la", "les", "l", "de", "du", "des", "d", "et", "the", "of", "au", "aux")
#: What a company adds to its name in one register and not in another, and trade names by registered ones (fixed values).
LEGAL_TAILS = ("france", "fr", "sas", "sasu", "sa", "sarl", "eurl", "snc", "cpo", "gmbh", "bv", "ltd", "group", "groupe", "partner network", "network")
TRADE_NAMES = {"alize": "bouygues"}


def _marked_letters() -> tuple[str, str]:
    """The letters of Latin-1, Latin Extended-A and -B and of the Vietnamese block that Unicode takes apart into a letter and marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*r)]
    pairs = [(c, p) for c, p in pairs if p != c and re.match("[a-z]", p)]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _marked_letters()


def first_value(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed; an empty string if all are."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def normalise_name(name: Column) -> Column:
    """Lower case without marks, set apart or on the letter; runs of what is no ASCII letter or digit are one space. Null stays null."""
    plain = F.translate(F.regexp_replace(F.lower(name), "[\u0300-\u036f]", ""), ACCENTED, PLAIN)
    plain = F.replace(F.replace(plain, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def name_tokens(name: Column, ignore: Column | None = None) -> Column:
    """The distinct words of a name without stop words and those of `ignore` (array); of a null name none."""
    words = F.split(F.coalesce(normalise_name(name), F.lit("")), " ")
    left = F.array_except(words, F.array(F.lit(""), *[F.lit(w) for w in STOP_WORDS]))
    return left if ignore is None else F.array_except(left, ignore)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared tokens over all tokens; 0 if either side has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def company_key(name: Column) -> Column:
    """A company's name to compare: normalised, without legal tails and spaces, by its trade name."""
    bare = F.replace(F.regexp_replace(normalise_name(name), f"( ({'|'.join(LEGAL_TAILS)}))+$", ""), F.lit(" "), F.lit(""))
    for registered, known in TRADE_NAMES.items():
        bare = F.when(bare == registered, known).otherwise(bare)
    return bare


def company_similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """1 if one company key is the other or holds it (4 letters at least), else the Dice of the tokens; null without both."""
    holds = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.when((a == b) | holds, 1.0).otherwise(dice(a_tokens, b_tokens)))


def name_score(ours: Column, theirs: Column, ignore: Column, brands: Column, whole: float = 0.8) -> Column:
    """How well an object's name (words, array) fits a record's: null where either has no word of its own or only brands.

    Words of `ignore` (of the commune, the status, the kind) count on neither side. If the object's are all among the
    record's, the score is `whole` at least; else the Dice of both.
    """
    a, b = F.array_except(ours, ignore), F.array_except(theirs, ignore)
    empty = (F.size(a) == 0) | (F.size(b) == 0) | (F.size(F.array_except(b, brands)) == 0)
    return F.when(~empty, F.when(F.size(F.array_except(b, a)) == 0, F.greatest(F.lit(whole), dice(a, b))).otherwise(dice(a, b)))


def id_keys(ids: Column) -> Column:
    """The ids of a list parted by semicolons: without spaces and stars, in upper case, without blanks."""
    keys = F.transform(F.split(F.coalesce(ids, F.lit("")), ";"), lambda x: F.upper(F.regexp_replace(x, r"[\s*]", "")))
    return F.array_distinct(F.array_remove(keys, ""))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes", "oui", "vrai"), F.lit(False))


def host(url: Column) -> Column:
    """The host of an address in lower case, without www. at the front; a scheme is added where there is none."""
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 16)


def allowed_by(patterns: list[str], key: Column) -> Column:
    """Is the key one of the patterns, or under one that ends in a star? No patterns allow all."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        out = out | (F.startswith(key, F.lit(p[:-1])) if p.endswith("*") else key == p)
    return out


def xml_escape(text: Column) -> Column:
    """Text for XML: marks as entities, without the control characters that XML 1.0 forbids."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
