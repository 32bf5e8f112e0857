"""Opening hours as a week: day rules folded into ranges of days, and intervals of minutes that compare and overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
DAY_MIN, WEEK_MIN = 24 * 60, 7 * 24 * 60
_ANY = "|".join(DAYS)
_SPAN = r"[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2}"
#: One day or a range of days, and its spans.
_RULE = rf"^({_ANY})(?:-({_ANY}))? ({_SPAN}(?:,{_SPAN})*)$"
#: Days (lists and ranges of them, or none for all), then spans or that it is closed.
_PART = rf"^(?:((?:{_ANY})(?:-(?:{_ANY}))?(?:,\s*(?:{_ANY})(?:-(?:{_ANY}))?)*):?\s+)?(?:({_SPAN}(?:,\s*{_SPAN})*)|(off|closed))$"
#: What a register may write: day names and times, and no words.
_REGISTER = rf"^(24/7|(?:{_ANY}|PH)(?![a-z])[A-Za-z0-9:,;\-+ /]*)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is read: expressions of expressions would grow with each reading."""
    return F.get(F.transform(F.array(value), use), 0)


def _week(of_day: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(6)), of_day)


def _day(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(d) for d in DAYS]), name) - 1).cast("int")


def _joined(spans: Column, kind: str) -> Column:
    """Structs of from and to in order, those that touch or overlap as one; one that ends before it begins stays as it is."""

    def step(done: Column, span: Column) -> Column:
        def after(last: Column) -> Column:
            meets = (last["from"] <= last["to"]) & (span["from"] <= span["to"]) & (span["from"] <= last["to"])
            wider = F.struct(last["from"].alias("from"), F.greatest(last["to"], span["to"]).alias("to"))
            return F.when(F.coalesce(meets, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

        return bound(F.try_element_at(done, F.lit(-1)), after)

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<struct<from:{kind},to:{kind}>>"), step)


def join_spans(spans: Column) -> Column:
    """A day's spans (texts, 08:00-12:00) as one text in order, those that touch or overlap as one; one past midnight stays as it is."""
    ends = F.transform(spans, lambda s: F.struct(F.substring(s, 1, 5).alias("from"), F.substring(s, 7, 5).alias("to")))
    return F.array_join(F.transform(_joined(ends, "string"), lambda s: F.concat_ws("-", s["from"], s["to"])), ",")


def _clash(had: Column, added: Column) -> Column:
    """Do spans of one day that are said a second time overlap the first ones without being the same?"""
    close = lambda s: F.when(F.substring(s, 7, 5) < F.substring(s, 1, 5), F.lit("24:00")).otherwise(F.substring(s, 7, 5))
    over = lambda a, b: (F.substring(a, 1, 5) < close(b)) & (F.substring(b, 1, 5) < close(a))
    return F.exists(added, lambda a: F.exists(had, lambda h: over(a, h))) & (join_spans(had) != join_spans(added))


def _said(rules: Column) -> Column:
    """What rules (from, to, spans) say of each day, joined; null of a day that none names."""
    named = lambda d: F.array_distinct(F.flatten(F.transform(F.filter(rules, lambda r: (r["from"] <= d) & (d <= r["to"])), lambda r: r["spans"])))
    return _week(lambda d: F.nullif(join_spans(named(d)), F.lit("")))


def _ranges(said: Column) -> Column:
    """Days that say the same as ranges of days; 24/7 if all are open all day."""
    same = lambda d, e: F.coalesce(F.get(said, d) == F.get(said, e), F.lit(False))
    name = lambda d: F.get(F.array(*[F.lit(x) for x in DAYS]), d)
    starts = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: F.get(said, d).isNotNull() & ~same(d, d - 1))
    last = lambda d: F.get(F.filter(F.sequence(d, F.lit(6)), lambda e: ~same(e + 1, d)), 0)
    text = lambda d: bound(last(d), lambda e: F.concat(name(d), F.when(e > d, F.concat(F.lit("-"), name(e))).otherwise(""), F.lit(" "), F.get(said, d)))
    whole = F.forall(said, lambda d: F.coalesce(d == "00:00-24:00", F.lit(False)))
    return F.when(whole, F.lit("24/7")).otherwise(F.array_join(F.transform(starts, text), "; "))


def fold_days(text: Column, merge: bool = False) -> Column:
    """Days spelled out one by one as ranges of days with the same spans; 24/7 if all are open all day.

    What is not made of plain day rules comes back as it was, and so do rules that name a day twice across a semicolon, where
    the later one replaces the earlier. With `merge` a day named again adds its spans, as registers mean it; if they clash, the text is empty.
    """
    part = lambda p, g: F.regexp_extract(p, _RULE, g)
    rule = lambda p: F.struct(_day(part(p, 1)).alias("from"), _day(F.coalesce(F.nullif(part(p, 2), F.lit("")), part(p, 1))).alias("to"), F.split(part(p, 3), ",").alias("spans"))

    def folded(parts: Column) -> Column:
        plain = F.forall(parts, lambda p: p.rlike(_RULE))
        return F.when(plain, bound(F.transform(parts, rule), by_rules)).otherwise(text)

    def by_rules(rules: Column) -> Column:
        of_day = lambda d: F.filter(rules, lambda r: (r["from"] <= d) & (d <= r["to"]))
        out = bound(_said(rules), _ranges)
        if merge:
            none = F.struct(F.array().cast("array<string>").alias("had"), F.lit(False).alias("clash"))
            add = lambda a, r: F.struct(F.array_union(a["had"], r["spans"]).alias("had"), (a["clash"] | ((F.size(a["had"]) > 0) & _clash(a["had"], r["spans"]))).alias("clash"))
            out = F.when(F.exists(F.sequence(F.lit(0), F.lit(6)), lambda d: F.aggregate(of_day(d), none, add, lambda a: a["clash"])), "").otherwise(out)
        else:
            twice = F.exists(F.sequence(F.lit(0), F.lit(6)), lambda d: F.size(of_day(d)) > 1)
            out = F.when(twice & F.contains(text, F.lit(";")), text).otherwise(out)
        return F.when(F.forall(rules, lambda r: r["from"] <= r["to"]), out).otherwise(text)

    return bound(F.split(F.trim(text), rf"\s*[;,]\s*(?=(?:{_ANY})\b)"), folded)


_INTERVALS = "array<struct<from:int,to:int>>"


def _spans_of(said: Column) -> Column:
    """The spans of a part in minutes from its day's beginning, one past midnight beyond its end; none where it is closed."""
    at = lambda s, n: F.substring(s, n, 2).cast("int") * 60 + F.substring(s, n + 3, 2).cast("int")
    span = lambda s: bound(F.struct(at(s, 1).alias("from"), at(s, 7).alias("to")), lambda x: F.struct(x["from"], F.when(x["to"] <= x["from"], x["to"] + DAY_MIN).otherwise(x["to"]).alias("to")))
    return F.when(said == "", F.array().cast(_INTERVALS)).otherwise(F.transform(F.split(said, r",\s*"), span))


def week_intervals(text: Column) -> Column:
    """The minutes of a week (from 0, Monday 00:00) that a text of day rules is open for, as structs of from and to in order, none touching.

    A rule after a semicolon replaces what was said of its days, one after a comma adds to it; a rule without days is for all, "off" closes.
    What runs past midnight goes on the next day, Sunday's on Monday. Null of what cannot be read so, as are holidays, months and words.
    """
    bare = F.trim(text)
    piece = lambda p, n: F.regexp_extract(p, _PART, n)
    days = lambda p: F.transform(F.filter(F.split(piece(p, 1), r",\s*"), lambda d: d != ""), lambda d: F.struct(_day(F.substring(d, 1, 2)).alias("a"), _day(F.substring(F.regexp_replace(d, "[: ]", ""), -2, 2)).alias("b")))
    rule = lambda p, i: F.struct(((i == 0) | (piece(p, 3) != "")).alias("fresh"), days(p).alias("days"), _spans_of(piece(p, 2)).alias("spans"))
    parts = lambda g: F.split(g, rf"(?<=[0-9])\s*,\s*(?=(?:{_ANY})\b)")
    groups = F.filter(F.split(bare, r"\s*;\s*"), lambda g: g != "")
    covers = lambda r, d: (F.size(r["days"]) == 0) | F.exists(r["days"], lambda x: F.when(x["a"] <= x["b"], (x["a"] <= d) & (d <= x["b"])).otherwise((x["a"] <= d) | (d <= x["b"])))

    def read(rules: Column) -> Column:
        on = lambda d: F.aggregate(F.filter(rules, lambda r: covers(r, d)), F.array().cast(_INTERVALS), lambda had, r: F.when(r["fresh"], r["spans"]).otherwise(F.concat(had, r["spans"])))
        week = F.flatten(_week(lambda d: F.transform(on(d), lambda s: F.struct((s["from"] + d * DAY_MIN).alias("from"), (s["to"] + d * DAY_MIN).alias("to")))))
        # What goes beyond Sunday's end is cut there and stands at Monday's beginning.
        ends = lambda s: F.when(s["to"] > WEEK_MIN, F.array(F.struct(s["from"], F.lit(WEEK_MIN).alias("to")), F.struct(F.lit(0).alias("from"), (s["to"] - WEEK_MIN).alias("to")))).otherwise(F.array(s))
        return _joined(F.flatten(F.transform(week, ends)), "int")

    timely = F.forall(F.regexp_extract_all(bare, F.lit("[0-9]{2}:[0-9]{2}"), 0), lambda t: (F.substring(t, 4, 2) < "60") & (t <= "48:00"))
    begins = F.forall(F.regexp_extract_all(bare, F.lit(_SPAN), 0), lambda s: F.substring(s, 1, 2) < "24")
    readable = timely & begins & (F.size(groups) > 0) & F.forall(groups, lambda g: F.forall(parts(g), lambda p: p.rlike(_PART)))
    rules = F.flatten(F.transform(groups, lambda g: F.transform(parts(g), rule)))
    return F.when(bare == "24/7", F.array(F.struct(F.lit(0).alias("from"), F.lit(WEEK_MIN).alias("to")))).when(readable, bound(rules, read))


def minutes_open(week: Column) -> Column:
    return F.aggregate(week, F.lit(0), lambda a, s: a + s["to"] - s["from"])


def open_at(week: Column, minute: Column) -> Column:
    """Is a week open at a minute of it?"""
    return F.exists(week, lambda s: (s["from"] <= minute) & (minute < s["to"]))


def overlap(a: Column, b: Column) -> Column:
    """Are two weeks open at one time?"""
    return F.exists(a, lambda s: F.exists(b, lambda t: (s["from"] < t["to"]) & (t["from"] < s["to"])))


def same_hours(a: Column, b: Column) -> Column:
    """Are two texts the same hours: written alike but for ways of saying all day, or the same week, minute by minute? The last minutes of a day are its end."""
    full = lambda t: F.regexp_replace(F.trim(t), r"23:5[0-9]\b", "24:00")
    short = lambda t: F.when(F.trim(t).rlike(r"^(Mo-Su )?00:00-(24:00|23:5[0-9]|00:00)$"), "24/7").otherwise(F.trim(t))
    return (short(a) == short(b)) | F.coalesce(week_intervals(full(a)) == week_intervals(full(b)), F.lit(False))


def valid_hours(text: Column) -> Column:
    """Folded hours that can be read as a week, also with rules for public holidays beside it; null of others."""
    holidays = rf"(^|\s*[;,]\s*)PH (off|closed|{_SPAN}(,{_SPAN})*)(?=\s*[;,]|$)"
    return bound(fold_days(text), lambda folded: F.when(week_intervals(F.regexp_replace(F.regexp_replace(folded, holidays, ""), r"^\s*;\s*", "")).isNotNull(), folded))


def register_hours(raw: Column) -> Column:
    """A register's hours in the map's way of writing: 23:57 and later is the end of the day, days are folded and a day named again keeps both spans."""
    v = F.regexp_replace(F.regexp_replace(F.trim(raw), r"23:5[7-9]\b", "24:00"), "00:00-00:00", "00:00-24:00")
    days = v
    for long, short in (("mon(?:day)?", "Mo"), ("tue(?:s(?:day)?)?", "Tu"), ("wed(?:nesday)?", "We"), ("thu(?:r(?:s(?:day)?)?)?", "Th"), ("fri(?:day)?", "Fr"), ("sat(?:urday)?", "Sa"), ("sun(?:day)?", "Su")):
        days = F.regexp_replace(days, rf"(?i)\b{long}\b", short)
    return F.when(F.lower(v) == "24/7", "24/7").when(v.rlike(_REGISTER), valid_hours(fold_days(days, merge=True)))
