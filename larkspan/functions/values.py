"""Tag values that say the same thing in other words: numbers, ids, streets, phones, web addresses, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hours import same_hours
from .text import id_keys, normalise_name

#: Day numbers as French streets spell them out (fixed values).
UNITS = ("un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf")
TEENS = ("dix", "onze", "douze", "treize", "quatorze", "quinze", "seize")
#: Keys whose values compare as names (fixed values).
NAME_KEYS = ("name", "operator", "network", "brand", "owner", "addr:street", "addr:city")
#: Country codes of French phone numbers, and the codes of overseas prefixes (fixed values).
PHONE_CODES = ("33", "262", "590", "594", "596", "508")
OVERSEAS = {
    "262": ("0262", "0263", "0269", "0692", "0693", "0639"), "590": ("0590", "0690", "0691"), "594": ("0594", "0694"),
    "596": ("0596", "0696", "0697"), "508": ("0508",),
}
#: Where the country is, as boxes of south, west, north and east (fixed values).
COUNTRY_BOXES = (
    (41.0, -5.5, 51.5, 10.0), (14.2, -63.2, 18.2, -60.7), (1.8, -55.0, 6.0, -51.5), (-21.5, 55.0, -20.8, 56.0), (-13.1, 44.9, -12.5, 45.4),
    (46.7, -56.5, 47.2, -56.0), (-23.0, 163.5, -19.5, 168.2), (-28.0, -155.0, -7.0, -134.0), (-14.5, -178.5, -13.0, -176.0),
)
#: Upper bounds in kW of the classes of a connector's power (fixed values).
POWER_CLASSES = (8, 22, 60)


def compact_number(number: Column) -> Column:
    """A house number without spaces and leading zeros: "07" is 7, "12 B" is 12B."""
    return F.regexp_replace(F.regexp_replace(number, r"\s+", ""), r"(^|-)0+(?=[0-9])", "$1")


def house_number(number: Column) -> Column:
    """A house number as two spellings of it compare: "158 BIS" is 158bis."""
    return F.lower(compact_number(number))


def spaced_number(number: Column) -> Column:
    """A house number as mappers write it: "74bis" is "74 bis", "6a" is "6A"."""
    spaced = F.regexp_replace(compact_number(number), r"(?i)([0-9])(bis|ter|quater|quinquies)$", "$1 $2")
    tail = F.regexp_extract(spaced, r"^(.*[0-9] )([A-Za-z]+)$", 1)
    spaced = F.when(F.length(tail) > 0, F.concat(tail, F.lower(F.substring_index(spaced, " ", -1)))).otherwise(spaced)
    # A single letter after a digit, before a hyphen or the end, is a capital.
    parts = F.transform(F.split(spaced, "-"), lambda p: F.when(p.rlike("[0-9][a-z]$"), F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.upper(F.substring(p, F.length(p), F.lit(1))))).otherwise(p))
    return F.array_join(parts, "-")


def list_values(value: Column) -> Column:
    """The values of a list parted by semicolons, without any white space and blanks."""
    return F.array_remove(F.transform(F.split(value, ";"), lambda x: F.regexp_replace(x, r"\s+", "")), "")


def fold(name: Column) -> Column:
    """A name as two spellings of it compare: "&" is "et"; else as normalise_name."""
    return normalise_name(F.replace(name, F.lit("&"), F.lit(" et ")))


def _day_words() -> list[tuple[str, int]]:
    """Spelt-out days and their numbers, the longest first, so that "dix sept" is not read as "dix"."""
    days = {"premier": 1, "1er": 1, "vingt": 20, "vingt et un": 21, "trente": 30, "trente et un": 31}
    days |= {w: n for n, w in enumerate(UNITS, 1) if n > 1} | {w: n for n, w in enumerate(TEENS, 10)}
    days |= {f"dix {w}": n for n, w in enumerate(UNITS[6:], 17)} | {f"vingt {w}": n for n, w in enumerate(UNITS[1:], 22)}
    return sorted(days.items(), key=lambda d: (-len(d[0]), d[0]))


def street_digits(folded: Column) -> Column:
    """A folded street name with its spelt-out days in digits: "rue du onze novembre" is "rue du 11 novembre"."""
    for word, n in _day_words():
        folded = F.regexp_replace(folded, rf"(?<![a-z0-9]){word}(?![a-z0-9])", str(n))
    return folded


def phone_digits(phone: Column) -> Column:
    """A phone number's digits with the national 0: +33 5 61… and 05 61… are one line, as are +262 262… and 0262…"""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    digits = F.regexp_replace(digits, "^(?:00)?(?:33|262|590|594|596)(?=[0-9]{9}$)", "0")
    return F.regexp_replace(digits, "^(?:00)?508(?=[0-9]{6}$)", "0508")


def _pairs(digits: Column) -> Column:
    return F.trim(F.regexp_replace(digits, "([0-9]{2})", "$1 "))


def phone_format(raw: Column) -> Column:
    """A French number as it is written on maps, null where it is none: +33 5 61 23 45 67, 08 06 14 15 00, +262 262 12 34 56."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\(0\)", ""), r"[\s.\-()]", "")
    code = F.regexp_extract(bare, rf"^(?:\+|00)({'|'.join(PHONE_CODES)})[0-9]+$", 1)
    rest = F.regexp_extract(bare, rf"^(?:\+|00)(?:{'|'.join(PHONE_CODES)})([0-9]+)$", 1)
    d = F.when(code == "", bare).otherwise(F.concat(F.lit("0"), F.when(code == "508", "508").otherwise(""), rest))
    own = F.lit(None).cast("string")
    for c, prefixes in OVERSEAS.items():
        own = F.when(F.substring(d, 1, 4).isin(*prefixes), c).otherwise(own)
    tail = F.substring(d, 5, 99)
    written = (
        F.when(own == "508", F.concat(F.lit("+508 "), _pairs(tail)))
        .when(own.isNotNull(), F.concat(F.lit("+"), own, F.lit(" "), F.substring(d, 2, 3), F.lit(" "), _pairs(tail)))
        .when(F.substring(d, 2, 1) == "8", _pairs(d))
        .otherwise(F.concat(F.lit("+33 "), F.substring(d, 2, 1), F.lit(" "), _pairs(F.substring(d, 3, 99))))
    )
    fits = d.rlike("^0[1-9][0-9]{8}$") & ((code == "") | (code == "33") | F.coalesce(code == own, F.lit(False)))
    return F.when(fits, written)


def is_mobile(phone: Column) -> Column:
    return phone_digits(phone).rlike("^0[67]")


def commune_of(address: Column) -> Column:
    """What follows the last postcode of an address line."""
    return F.regexp_extract(address, r".*[0-9]{5}\s*([^0-9].*)$", 1)


def postcode_of(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"\b([0-9]{5})\b", 1), F.lit(""))


def address_query(line: Column, postcode: Column, city: Column) -> Column:
    """What to ask an address base for a line: with postcode and commune, unless the line has the postcode already."""
    known = (F.length(postcode) > 0) & F.contains(line, postcode)
    parts = F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in (line, postcode, city)]))
    return F.when(F.coalesce(known, F.lit(False)), line).otherwise(F.array_join(parts, " "))


def one_edit(a: Column, b: Column) -> Column:
    """Are two words alike but for one letter? Only words of five letters and more are asked."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1))


def _url(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host without www., and path in lower case without slashes behind; nulls of what is no address."""
    text = F.trim(url)
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("http://"), text))
    part = lambda p: F.try_parse_url(full, F.lit(p))
    return F.lower(part("PROTOCOL")), F.regexp_replace(F.lower(part("HOST")), r"^www\.", ""), F.lower(F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", ""))


def website(raw: Column) -> Column:
    """A web address with a scheme and without a fragment; null where the host has no dot."""
    full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.try_parse_url(full, F.lit("HOST"))
    bare = F.regexp_replace(full, "#.*$", "")
    path, query = F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), F.try_parse_url(full, F.lit("QUERY"))
    bare = F.when(path.isin("", "/") & query.isNull(), F.regexp_replace(bare, "/$", "")).otherwise(bare)
    return F.when(F.contains(host, F.lit(".")), bare)


def same_site(a: Column, b: Column) -> Column:
    """Does the site `a` add nothing to the held `b`? A page of it or its root, the same name under another ending, or http for https."""
    (pa, ha, xa), (pb, hb, xb) = _url(a), _url(b)
    bare = lambda h: F.regexp_replace(h, r"\.[^.]+$", "")
    inside = F.startswith(xa, xb) | F.startswith(xb, xa)
    known = F.when(ha != hb, bare(ha) == bare(hb)).otherwise(((pb == "https") & (pa != "https")) | inside)
    return F.when(ha.isNull() | hb.isNull(), F.lower(F.trim(a)) == F.lower(F.trim(b))).otherwise(known)


def same_url(a: Column, b: Column) -> Column:
    """Do two records give one page?"""
    (_, ha, xa), (_, hb, xb) = _url(a), _url(b)
    return F.when(ha.isNull() | hb.isNull(), F.lower(F.trim(a)) == F.lower(F.trim(b))).otherwise((ha == hb) & (xa == xb))


def _numbers(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")


def same_list(a: Column, b: Column) -> Column:
    """Lists by semicolons agree if the proposed one is a single value among the held ones, or both are one set."""
    one, other = (F.array_sort(F.array_distinct(list_values(v))) for v in (a, b))
    return ((F.size(one) == 1) & F.array_contains(other, F.element_at(one, 1))) | (one == other)


def same_ids(a: Column, b: Column) -> Column:
    """Are all ids of the proposed list on the held one, which may name other establishments besides?"""
    return F.size(F.array_except(id_keys(a), id_keys(b))) == 0


def same_value(key: Column, a: Column, b: Column, hooks: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """Does the proposed value `a` of a key say what the held `b` does?

    By key: names and streets folded, opening hours as weeks, outputs as numbers, phones by digits, web addresses by site, house
    numbers, ids by inclusion; `hooks` adds comparisons of a kind's own. Other values compare as lists where one has a
    semicolon, and otherwise as they stand but for spaces at the ends.
    """
    k = F.regexp_replace(key, "^contact:", "")
    rules = F.when(k.isin("addr:street", "street"), street_digits(fold(a)) == street_digits(fold(b))).when(k.isin(*NAME_KEYS), fold(a) == fold(b))
    rules = rules.when(k == "opening_hours", same_hours(a, b)).when(F.endswith(k, F.lit(":output")), _numbers(a) == _numbers(b))
    rules = rules.when(k.isin("phone", "fax", "mobile"), phone_digits(a) == phone_digits(b)).when(k == "website", same_site(a, b))
    rules = rules.when(k.isin("addr:housenumber", "housenumber"), house_number(a) == house_number(b))
    for name, same in (hooks or {}).items():
        rules = rules.when(k == name, same(a, b))
    rules = rules.when(F.startswith(k, F.lit("ref:")), same_ids(a, b))
    rules = rules.when(F.contains(a, F.lit(";")) | F.contains(b, F.lit(";")), same_list(a, b)).otherwise(F.trim(a) == F.trim(b))
    return F.coalesce((a == b) | rules, F.lit(False))


def in_country(lat: Column, lon: Column) -> Column:
    out = F.lit(False)
    for south, west, north, east in COUNTRY_BOXES:
        out = out | (lat.between(south, north) & lon.between(west, east))
    return out


def power_class(value: Column) -> Column:
    """The class 0 to 3 of a power: kW unless the value says W; null of what is no number."""
    pattern = r"(?i)^\s*([0-9]+(?:[.,][0-9]+)?)\s*(kva|kw|w)?(?![a-z])"
    number = F.replace(F.regexp_extract(value, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    kw = F.when(F.lower(F.regexp_extract(value, pattern, 2)) == "w", number / 1000).otherwise(number)
    classes = F.lit(0)
    for top in POWER_CLASSES:
        classes = classes + (kw > top).cast("int")
    return F.when(kw.isNotNull(), classes)


def is_public_address(ip: Column) -> Column:
    """May a crawl be led to this address? Not to private, loopback, link-local, shared or multicast ones, of IPv6 too, nor to such an IPv4 address within one; null of what is none."""
    low = F.lower(F.trim(ip))
    four = F.regexp_extract(low, r"^(?:::ffff:)?([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    parts = F.transform(F.split(four, r"\."), lambda p: p.try_cast("int"))
    a, b = F.get(parts, 0), F.get(parts, 1)
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    six = low.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(F.split(low, ":")) <= 8 + F.startswith(low, F.lit("::")).cast("int") + F.endswith(low, F.lit("::")).cast("int"))
    own = low.rlike("^(0*:)*:?0*[01]?$") | low.rlike("^f[cd][0-9a-f]{2}:") | low.rlike("^fe[89ab][0-9a-f]:") | low.rlike("^ff[0-9a-f]{2}:")
    return F.when(valid, ~inner).when(six, ~own)


def hashtags(text: Column) -> Column:
    """Hashtags parted by semicolons from however they were typed."""
    parts = F.array_remove(F.split(text, r"[\s;,]+"), "")
    return F.array_join(F.transform(parts, lambda h: F.when(F.startswith(h, F.lit("#")), h).otherwise(F.concat(F.lit("#"), h))), ";")


def clip(text: Column, most: int = 255) -> Column:
    """At most `most` characters, the last of a longer text an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def metres_label(metres: Column) -> Column:
    """A distance to show: metres below a kilometre, else kilometres with one decimal."""
    near = F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))
    return F.when(metres < 1000, near).otherwise(F.concat(one_decimal(metres / 1000), F.lit(" km")))


def one_decimal(value: Column) -> Column:
    """A number that is not negative with one decimal, rounded by its exact value as a double.

    format_string rounds the shortest decimals that stand for it, so 3.15, which is a little less than that, would become 3.2. Cut into two halves of its digits,
    twenty times the number is compared with the odd number between two tenths without any rounding.
    """
    tenths, high = F.floor(value * 10), value.cast("float").cast("double")
    tenths = tenths + F.when(high * 20 - (tenths * 2 + 1).cast("double") >= (high - value) * 20, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def element_ref(kind: Column, number: Column) -> Column:
    return F.concat_ws("/", kind, number.cast("string"))
