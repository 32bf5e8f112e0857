"""Opening hours and stations: what no table of the queries holds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspan.functions import hours
from larkspan.operators import declare, stations
from larkspan.sources import pages

DAYS = hours.DAYS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def plain_week(text):
    """The open minutes of a week as a set, or None."""
    if text == "24/7":
        return set(range(7 * 1440))
    days = {d: [] for d in range(7)}
    for group in [g for g in re.split(r"\s*;\s*", text.strip()) if g]:
        for i, part in enumerate(re.split(r"(?<=[0-9])\s*,\s*(?=(?:Mo|Tu|We|Th|Fr|Sa|Su)\b)", group)):
            m = re.fullmatch(r"(?:([A-Za-z,\- ]+):? )?(off|closed|[0-9:,\- ]+)", part)
            if not m:
                return None
            named = set()
            for r in re.split(r",\s*", m[1]) if m[1] else ["Mo-Su"]:
                ends = [DAYS.index(x) for x in r.split("-") if x in DAYS]
                if not ends or len(ends) != len(r.split("-")):
                    return None
                d = ends[0]
                named.add(d)
                while d != ends[-1]:
                    d = (d + 1) % 7
                    named.add(d)
            spans = []
            for s in [] if m[2] in ("off", "closed") else re.split(r",\s*", m[2]):
                t = re.fullmatch(r"(\d\d):([0-5]\d)-(\d\d):([0-5]\d)", s)
                if not t or int(t[1]) > 23 or int(t[3]) * 60 + int(t[4]) > 48 * 60:
                    return None
                a, b = int(t[1]) * 60 + int(t[2]), int(t[3]) * 60 + int(t[4])
                spans.append((a, b + 1440 if b <= a else b))
            for d in named:
                days[d] = spans if i == 0 or not spans else days[d] + spans
    return {(d * 1440 + x) % (7 * 1440) for d, spans in days.items() for a, b in spans for x in range(a, b)}


def test_weeks_equal_sets_of_minutes(spark):
    rng = random.Random(5)
    span = lambda: f"{rng.randint(0, 24):02d}:{rng.choice(['00', '30', '59', '60'] if rng.random() < 0.1 else ['00', '30'])}-{rng.randint(0, 26):02d}:{rng.choice(['00', '15'])}"
    day = lambda: rng.choice(DAYS) + (f"-{rng.choice(DAYS)}" if rng.random() < 0.5 else "")
    rule = lambda: (", ".join(day() for _ in range(rng.randint(1, 2))) + " " if rng.random() < 0.9 else "") + (rng.choice(["off", "closed", "sunrise-sunset"]) if rng.random() < 0.15 else ",".join(span() for _ in range(rng.randint(1, 3))))
    texts = ["".join(x for k in range(rng.randint(1, 4)) for x in ([rng.choice(["; ", ", ", ";"])] if k else []) + [rule()]) for _ in range(400)] + ["24/7", "", " ", "PH off", "Mo", "Mo-Su 00:00-24:00", "Su 23:00-26:00;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    got = df.select("t", hours.week_intervals(F.col("t")).alias("w"), hours.minutes_open(hours.week_intervals(F.col("t"))).alias("n")).collect()
    read = 0
    for r in got:
        want = plain_week(r["t"]) if r["t"].strip() else None
        found = None if r["w"] is None else {x for s in r["w"] for x in range(s["from"], s["to"])}
        assert found == want, r["t"]
        if want is not None:
            read += 1
            assert r["n"] == len(want) and all(a["to"] < b["from"] for a, b in zip(r["w"], r["w"][1:], strict=False))
    assert 100 < read < len(texts)


def test_folded_days(spark):
    said = [
        ("Mo 09:30-19:45, Tu 09:30-19:45, We 09:30-19:45", "Mo-We 09:30-19:45"), ("Mo 08:00-12:00,14:00-18:00, We 08:00-12:00, We 14:00-18:00", "Mo 08:00-12:00,14:00-18:00; We 08:00-12:00,14:00-18:00"), ("Mo-Fr 08:00-12:00; Tu 09:00-10:00", "Mo-Fr 08:00-12:00; Tu 09:00-10:00"),
        ("Mo-Su 00:00-24:00", "24/7"), ("Fr-Mo 08:00-10:00", "Fr-Mo 08:00-10:00"), ("Mo 08:00-12:00, Mo 12:00-18:00", "Mo 08:00-18:00"), ("Sa 22:00-02:00, Su 22:00-02:00", "Sa-Su 22:00-02:00"), ("by appointment", "by appointment"), (None, None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(said)], "i int, t string")
    assert [r["f"] for r in df.select("i", hours.fold_days(F.col("t")).alias("f")).orderBy("i").collect()] == [b for _, b in said]
    raw = [
        ("Mo-Sa 07:30-12:00;Mo-Sa 13:30-17:30", "Mo-Sa 07:30-12:00,13:30-17:30"), ("Mo-Su 00:00-23:59", "24/7"), ("Mo-Su 00:00-00:00", "24/7"), ("Mo-Sa 08:00-12:00;Mo 09:00-13:00", None), ("Mo-Sa 08:00-12:00;Mo 08:00-12:00", "Mo-Sa 08:00-12:00"),
        ("Mon 08:00-10:00, Tuesday 08:00-10:00", None), ("Mo-Fri 08:00-10:00", "Mo-Fr 08:00-10:00"), ("Monday to Friday", None), ("24/7", "24/7"), ("Mo-Fr 08:00-18:00; PH off", "Mo-Fr 08:00-18:00; PH off"), ("open", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(raw)], "i int, t string")
    assert [r["f"] for r in df.select("i", hours.register_hours(F.col("t")).alias("f")).orderBy("i").collect()] == [b for _, b in raw]
    same = [("Mo-Su 00:00-23:58", "24/7", True), ("Mo-Fr 08:00-12:00,12:00-18:00", "Mo-Fr 08:00-18:00", True), ("Mo 22:00-02:00", "Mo 22:00-24:00; Tu 00:00-02:00", True), ("Mo-Fr 08:00-18:00", "Mo-Sa 08:00-18:00; Sa off", True), ("Mo 08:00-18:00", "Mo 08:00-18:01", False), ("dawn", "dawn ", True), ("dawn", "dusk", False), (None, "24/7", None)]
    lit = lambda x: F.lit(x).cast("string")
    assert [bool(g) for g in one(spark, *[F.coalesce(hours.same_hours(lit(a), lit(b)), F.lit(False)) for a, b, _ in same])] == [bool(x) for *_, x in same]


def test_entities_are_decoded_once(spark):
    got = one(spark, pages.html_text(F.lit("a &#38;lt;b &AMP; c &amp;lt; &Nope; &#0; &#x110000; &#xD800;x &nbsp;y &quot;")))
    assert got[0] == 'a &lt;b & c &lt; &Nope; x y "'


STATION = "site long, row long, station string, file string, point string, day string, publisher string, modified string, name string, lat double, lon double, count string"


def kept(spark, rows):
    return sorted(r["row"] for r in stations.current_stations(spark.createDataFrame(rows, STATION).repartition(3)).collect())


def test_superseded_stations(spark):
    row = lambda n, station, file, point, day, name="", count=None, lat=None, publisher="own": (1, n, station, file, point, day, publisher, "", name, lat, None if lat is None else 1.0, count)
    # A pool takes in stations of one point each; all are listed by newer ones, one of them under another prefix.
    assert kept(spark, [row(1, "S1", "a", "FRAAAE1", "2020"), row(2, "S2", "a", "FRAAAE1234567", "2020"), row(3, "P", "a", "FRAAAE1", "2021"), row(4, "P", "a", "FRBBBE1234567", "2021")]) == [3, 4]
    # Another file's newer one declares some points again under the same name; the point that it leaves out is gone, also from an older third station.
    rows = [row(1, "S", "a", "X1", "2020", "Quay"), row(2, "S", "a", "X2", "2020", "Quay"), row(3, "T", "b", "X1", "2022", "Quay"), row(4, "U", "c", "X2", "2019", "Else"), row(5, "U", "c", "X9", "2019", "Else")]
    assert kept(spark, rows) == [3, 5]
    # Under another name and count they are two, whose points count once each; of one file they always are.
    assert kept(spark, [row(1, "S", "a", "X1", "2020", "Quay"), row(2, "S", "a", "X2", "2020", "Quay"), row(3, "T", "b", "X1", "2022", "Port")]) == [1, 2, 3]
    assert kept(spark, [row(1, "S", "a", "X1", "2020", "Quay"), row(2, "S", "a", "X2", "2020", "Quay"), row(3, "T", "a", "X1", "2022", "Quay")]) == [1, 2, 3]
    # No point in common: name, count and spot together say that it is the same.
    assert kept(spark, [row(1, "S", "a", "X1", "2020", "Quay", "1", 43.0), row(2, "T", "b", "Y1", "2022", "quay", "1 x", 43.00001)]) == [2]
    assert kept(spark, [row(1, "S", "a", "X1", "2020", "Quay", "1", 43.0), row(2, "T", "b", "Y1", "2022", "Quay", "1", 43.0001)]) == [1, 2]
    # One row that stands for two points goes when others list two.
    assert kept(spark, [row(1, "S", "a", "S", "2020", "", "2"), row(2, "T", "b", "Y1", "2022"), row(3, "V", "c", "Y2", "2022")]) == [2, 3]
    assert kept(spark, [row(1, "S", "a", "S", "2020", "", "3"), row(2, "T", "b", "Y1", "2022"), row(3, "V", "c", "Y2", "2022")]) == [1, 2, 3]
    # Of one day the operator's own file is newer than a copy; ties keep both; points that are none all stay, but in the newest file only.
    assert kept(spark, [row(1, "S", "a", "X1", "2020", publisher="Qualicharge"), row(2, "S", "b", "X1", "2020")]) == [2]
    assert kept(spark, [row(1, "S", "a", "Non concerné", "2020"), row(2, "S", "a", "non concerne", "2020"), row(3, "S", "b", None, "2019"), row(4, None, "b", None, "2019"), row(5, None, None, None, None)]) == [1, 2, 4]
    got = stations.current_stations(spark.createDataFrame([row(1, "A", "f", "A", "2020", "", "2"), row(2, "B", "f", "B", "2020", "", "2"), row(3, "C", "g", "C", "2021", "", "2")], STATION)).collect()
    assert sorted((r["row"], r["n"], r["one_row"]) for r in got) == [(1, 1, False), (2, 1, False), (3, 2, True)]
    assert kept(spark, []) == []


SOCKET = "site long, row long, station string, point string, n int, one_row boolean, count string, name string, power double, type2 boolean, ccs boolean, chademo boolean, ef boolean, other boolean, cable boolean, recovered boolean"


def test_sockets_of_a_site(spark):
    row = lambda site, n, point, power, flags, cable=None, count=None, name="Quay", n_said=None, single=False, station="S": (site, n, station, point, n_said, single, count, name, power, *[f in flags for f in ("type2", "ccs", "chademo", "ef", "other")], cable, False)
    rows = [
        row(1, 1, "X11", 22.08, ("type2",), False, "2"), row(1, 2, "X12", 7.4, ("type2",), False, "2"),
        row(2, 1, "X21", 150.0, ("ccs", "chademo")), row(2, 2, "X22", 150.0, ("type2",), True), row(2, 3, "X31", 24.0, ("type2",)),
        row(3, 1, "X1", 50.0, ("type2",), count="4"), row(3, 2, "X2", 50.0, ("type2",), count="4"),
        row(4, 1, "S", 22.0, ("type2",), count="6", n_said=6, single=True),
        row(5, 1, None, 3.0, ()), row(5, 2, None, 3.0, ("ef",)),
        row(6, 1, "X1", 62.5, ("type2", "ef"), name="Borne DC"),
        row(7, 1, "X1", float("nan"), ("type2", "ccs", "chademo", "ef", "other")), row(8, 1, "X1", None, ("chademo",)),
    ]
    df = spark.createDataFrame(rows, SOCKET)
    got = {r["site"]: r for r in stations.read_sockets(df, df.select("site", *stations.FLAGS, "cable")).collect()}
    assert (got[1]["capacity"], got[1]["capacity_conf"], got[1]["sockets"]) == (2, 0.85, {"socket:type2": "2", "socket:type2:output": "22 kW"}) and "socket:schuko" in got[1]["absent"] and "socket:chademo" in got[1]["absent"]
    # The cabinet's alternating outlet is no bay, and its power none of the cable's.
    assert got[2]["capacity"] == 2 and got[2]["sockets"] == {"socket:type2": "1", "socket:type2:output": "24 kW", "socket:type2_cable": "1", "socket:type2_combo": "1", "socket:type2_combo:output": "150 kW", "socket:chademo": "1"}
    assert got[2]["gaps"] == ["socket:type2", "socket:type2:output"] and got[2]["confs"]["socket:type2_combo:output"] == 0.7
    assert got[3]["capacity"] is None and got[3]["sockets"] == {} and got[3]["notes"] == ["The registry declares 4 charge points and lists 2, so capacity and sockets are left out"] and got[3]["absent"] == []
    assert got[4]["capacity"] == 6 and got[4]["sockets"] == {} and "single row" in got[4]["notes"][0]
    assert got[5]["capacity"] == 2 and got[5]["notes"] == ["1 of its 2 charge points name no connector, so sockets are left out"]
    assert "named for DC" in got[6]["notes"][0] and got[7]["notes"][0].startswith("The registry ticks every") and got[8]["sockets"] == {"socket:chademo": "1"}
    assert list(one(spark, *[stations.kilowatts(F.lit(x)) for x in (22.08, 7.4, 3.7, 6.95, 43.0)])) == ["22 kW", "7.4 kW", "3.7 kW", "7 kW", "43 kW"]
    assert stations.read_sockets(df.filter("false"), df.select("site", *stations.FLAGS, "cable")).count() == 0


def test_declarations_without_a_point_stand_alone(spark):
    rows = spark.createDataFrame([(1, "Non concerné", "d1"), (2, "NON CONCERNE", "d2"), (3, "FR*AAA*E1", "d3"), (4, None, "d4"), (5, " ", "d5")], "row long, id string, declaration string")
    got = declare.declarations_of(rows, rows.select("declaration", "id"))
    assert sorted((r["row"], r["declaration"]) for r in got.collect()) == [(1, "d1"), (2, "d2"), (3, "d3"), (4, "d4"), (5, "d5")]


def test_the_floor_is_held_against_what_was_said(spark):
    said = spark.createDataFrame([(1, 0, "name", "Bread", 0.496, "Bread", "Bread"), (1, 1, "brand", "Bread", 0.5, "Bread", "Bread"), (1, 2, "opening_hours", "at noon", 0.9, "Bread", "Bread"), (1, 3, "opening_hours", "Mo 08:00-10:00, Tu 08:00-10:00", 0.9, "Bread", "Bread")], "page long, position int, k string, v string, conf double, quote string, text string")
    assert [(r["k"], r["v"], r["conf"]) for r in declare.vetted_tags(said, [], 0.5).orderBy("position").collect()] == [("brand", "Bread", 0.5), ("opening_hours", "Mo-Tu 08:00-10:00", 0.9)]
