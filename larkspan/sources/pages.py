"""Text and links of landed web pages, by regular expressions over the markup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host

#: Named entities that are decoded (fixed values).
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
#: Elements without visible text.
HIDDEN = ("script", "style", "noscript", "svg", "template")


def _entities(text: Column) -> Column:
    """Characters for named entities, in any case of letters, and for &#NN; and &#xHH;, each decoded once; other names stay, and what is no character is a space.

    The pieces between entities are an array, so a text is read once.
    """
    marked = F.regexp_replace(text, r"(?i)&(#x?[0-9a-f]+|[a-z]+);", "\u0001$1\u0002")
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def sign(code: Column) -> Column:
        number = F.when(F.startswith(code, F.lit("#x")), F.conv(F.substring(code, F.lit(3), F.length(code)), 16, 10)).otherwise(F.substring(code, F.lit(2), F.length(code))).try_cast("int")
        character = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(F.startswith(code, F.lit("#")), F.coalesce(character, F.lit(" "))).otherwise(F.try_element_at(names, code))

    def piece(p: Column) -> Column:
        written, rest = F.substring_index(p, "\u0002", 1), F.substring(p, F.instr(p, "\u0002") + 1, F.length(p))
        return F.concat(F.coalesce(sign(F.lower(written)), F.concat(F.lit("&"), written, F.lit(";"))), rest)

    decoded = F.array_join(F.transform(F.split(marked, "\u0001"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def json_ld(html: Column) -> Column:
    """The contents of a page's JSON-LD scripts, where sites keep their opening hours."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1), lambda s: F.trim(s))


def html_text(html: Column, most: int | None = None) -> Column:
    """The visible text: no scripts, styles or comments, block tags as line ends, entities decoded; JSON-LD stands behind it.

    With `most`, only so many characters.
    """
    out = html
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article|footer|header|td)\b[^>]*>", "\n")
    out = _entities(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\f\x0b\u00a0]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n\r"))
    ld = json_ld(html)
    out = F.concat(out, F.when(F.size(ld) > 0, F.concat(F.lit("\n\nStructured data: "), F.array_join(ld, "\n"))).otherwise(""))
    return out if most is None else F.substring(out, 1, most)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id and href of the distinct links of each page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), 1)
    return pages.select("page_id", F.explode(F.array_distinct(hrefs)).alias("href"))


def same_host_links(pages: DataFrame, hints: Sequence[str]) -> DataFrame:
    """page_id and href of links to the page's own host whose path has one of the hint words; relative links are its own."""
    links = page_links(pages).join(pages.select("page_id", host(F.col("url")).alias("own")), "page_id")
    relative = ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return links.filter((relative | (host(F.col("href")) == F.col("own"))) & F.lower("href").rlike("|".join(hints))).select("page_id", "href")
