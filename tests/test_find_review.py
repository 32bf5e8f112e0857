"""Matching, settling, picks, sites and addresses: nulls, ties, repeated rows and empty tables, and what no table of the queries holds."""

import re

from pyspark.sql import functions as F

from larkspan.functions import fit, streets
from larkspan.operators import addresses, around, find, link, picks, sites

RECORD = "key long, lat double, lon double, name string, who array<string>, place_words array<string>, kind string, ids array<string>, soft_ids array<string>, evse array<string>, listed map<string,string>, gaps array<string>, absent array<string>"
ELEMENT = "key long, lat double, lon double, name string, who array<string>, place_words array<string>, kind string, ids array<string>, soft_ids array<string>, evse array<string>, tags map<string,string>, shell boolean, gone boolean"
M = 1 / 111_195  # a metre of latitude


def rec(key, north, name=None, who=(), ids=(), soft=(), evse=(), listed=None, gaps=(), absent=(), kind="a", place=()):
    return (key, None if north is None else 43 + north * M, 1.0, name, list(who), list(place), kind, list(ids), list(soft), list(evse), listed or {}, list(gaps), list(absent))


def obj(key, north, name=None, who=(), ids=(), soft=(), evse=(), tags=None, shell=False, gone=False, kind="a"):
    return (key, 43 + north * M, 1.0, name, list(who), [], kind, list(ids), list(soft), list(evse), tags or {}, shell, gone)


def found(spark, records, elements, words=()):
    r, e = spark.createDataFrame(records, RECORD), spark.createDataFrame(elements, ELEMENT)
    return {x["key"]: (x["element"], x["by_id"]) for x in find.find_matches(r, e, words).collect()}


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_objects_are_found_by_all_steps(spark):
    records = [
        rec(1, 0, ids=["A"]), rec(2, 0, ids=["B"]), rec(3, 0, ids=["S"]), rec(4, 0, ids=["S"]), rec(5, 100_000, ids=["C"], name="Blue House"), rec(6, 200_000, "Town Blue House", place=["town"]), rec(7, 300_000, "Borne", who=["Alpha"]),
        rec(8, 400_000, who=["Alpha"], soft=["X1"], evse=["FRALPE1"], listed={"capacity": "4"}), rec(9, 500_000, listed={"socket:type2": "2"}, who=["Alpha"]), rec(10, 600_000, "Same"), rec(11, None, ids=["N"]), rec(12, 700_000, None), rec(13, 800_000, listed={"socket:type2": "1"}),
    ]
    elements = [
        obj(101, 9000, ids=["A"]), obj(102, 5000, ids=["A"], shell=True), obj(103, 20, ids=["B"], gone=True), obj(104, 30, ids=["B", "Z"]), obj(105, 0, ids=["S"]),
        obj(106, 100_000, ids=["C"], shell=True), obj(107, 100_040, "Blue House"), obj(108, 100_020, kind="b"), obj(109, 200_120, "Blue House"), obj(110, 200_010, "Red House", who=["Beta"]), obj(111, 300_040, who=["ALPHA sas"]),
        obj(112, 400_020, soft=["Y1"], evse=["FRALPP9"], tags={"capacity": "4"}), obj(113, 500_010, who=["Alpha"], tags={"socket:chademo": "1"}), obj(114, 600_030, "Same"), obj(115, 599_970, "Same"), obj(116, 4_000_000, ids=["N"]),
        obj(117, 700_014), obj(118, 700_012), obj(119, 800_005, tags={"bicycle": "yes", "motorcar": "no"}), obj(120, 800_010, tags={"socket:schuko": "2"}), obj(121, 800_012, tags={"socket:type2": "1"}),
    ]
    got = found(spark, records, elements, words=["borne"])
    assert got[1] == (101, True) and got[2] == (104, True) and got[3] == got[4] == (105, False) and got[5] == (107, True)
    assert got[6] == (109, False) and got[7] == (111, False) and got[8] == (112, False) and 9 not in got and got[10] == (114, False) and got[11] == (116, True) and got[12] == (118, False) and got[13] == (121, False)
    assert found(spark, [], elements) == {} and found(spark, records[:4], []) == {}


def test_fit_of_stations(spark):
    def of(listed, tags, gaps=(), absent=()):
        m = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv]) if x else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        a = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
        return fit.station_fit(m(listed), a(gaps), a(absent), m(tags)), fit.exact_fit(m(listed), a(gaps), m(tags)), fit.for_two_wheels(m(listed), m(tags))

    cases = [
        ({"capacity": "4", "socket:type2": "2", "socket:type2:output": "22 kW"}, {"capacity": "4", "socket:type2": "2", "socket:type2:output": "22.0"}, (), (), (3, 0, False), True), ({"capacity": "4"}, {"capacity": "5"}, (), (), (0, 1, False), False), ({"capacity": "4"}, {}, (), (), None, False),
        ({"socket:type2": "2"}, {"socket:type2": "yes"}, (), (), None, False), ({"socket:type2": "2"}, {"socket:type2_cable": "2"}, (), (), None, False), ({"socket:type2": "2"}, {"socket:chademo": "1"}, (), ("socket:chademo",), (0, 3, True), False),
        ({"socket:type2": "2"}, {"socket:type2": "3"}, ("socket:type2",), (), None, False), ({"socket:type2": "2"}, {"socket:type2": "2", "capacity": "2"}, (), (), (1, 0, False), False), ({"socket:unknown": "2"}, {"socket:unknown": "3"}, (), (), None, False),
    ]
    got = one(spark, *[c for case in cases for c in of(*case[:4])[:2]])
    for i, case in enumerate(cases):
        f, exact = got[2 * i], got[2 * i + 1]
        assert (None if f is None else (f["agree"], f["against"], f["types"])) == case[4] and exact == case[5], case
    wheels = one(spark, *[of(a, b)[2] for a, b in (({"socket:type2": "1"}, {"bicycle": "yes"}), ({"socket:type2": "1"}, {"bicycle": "yes", "socket:type2": "1"}), ({"socket:typee": "1"}, {"bicycle": "yes"}), ({"socket:type2": "1"}, {"socket:schuko": "2"}), ({"socket:type2": "1", "motorcycle": "yes"}, {"scooter": "yes"}))])
    assert list(wheels) == [True, False, False, True, False]


def test_points_settle(spark):
    records = spark.createDataFrame([rec(1, 0, "Alpha House"), rec(2, 5000, "Beta House"), rec(3, 9000, "Gamma House"), rec(4, 12_000, "Delta House"), rec(5, 15_000, "Eta House")], RECORD)
    elements = spark.createDataFrame([obj(11, 20, "Alpha House"), obj(12, 5060, "Beta House"), obj(13, 9010, "Gamma House"), obj(14, 12_500, "Delta House")], ELEMENT)
    at = lambda key, north, far, wrong=None, same=False: (key, 43 + north * M, 1.0, far, wrong, same)
    addresses_ = spark.createDataFrame([at(1, 200, 100.0), at(2, 5100, 50.0), at(3, 9500, 100.0, 300.0, True), at(4, 12_500, None)], "key long, to_lat double, to_lon double, far_m double, wrong_m double, same_postcode boolean")
    got = {r["key"]: (None if r["moved_m"] is None else round(r["moved_m"]), r["element"]) for r in find.settle_points(records, elements, addresses_).collect()}
    # An object stands by the point; the same object lies nearer the address; the point is wrong; one that never moves matches at its address.
    assert got == {1: (None, 11), 2: (100, 12), 3: (500, None), 4: (None, 14), 5: (None, None)}


def test_picks_are_refused_by_name(spark):
    proposals = spark.createDataFrame([(1, 0, "p0", "a", "add", "x", None, None, None, None, True), (1, 1, "p1", "b", "del", "old", None, None, None, False, True), (2, 0, "q0", "a", "add", "x", None, None, None, True, True)], "key long, position int, id string, k string, op string, v string, was string, pair string, grp string, invalid boolean, evidenced boolean")
    unchanged = spark.createDataFrame([(1, "c", "held")], "key long, k string, v string")

    def says(*rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "key long, seq int, kind string, arg string")
        ops, refused = picks.decide(df, proposals, unchanged)
        return [tuple(r)[2:] for r in ops.orderBy("nth").collect()] or refused.first()["reason"]

    assert says(("tag", "0"), ("tag", " 0 "), ("set", "b=new"), ("del", "c")) == [("p0", "add", "a", "x", None), ("p1", "mod", "b", "new", "old"), (None, "del", "c", "held", None)]
    assert says(("tag", "9")) == "no proposal stands there" and says(("set", "=x")) == "a tag needs a key" and says(("set", "k= ")) == "k needs a value" and says(("set", "k")) == "a tag needs a key"
    assert says(("set", "k=" + "x" * 256)).endswith("255 characters") and says(("set", "c=held")) == "c is already held" and says(("del", "zzz"), ("tag", "9")) == "no proposal stands there"
    assert says(("set", "d=1"), ("set", "d=2")) == "d is written twice" and says((None, None)) == "nothing is picked"
    assert picks.decide(spark.createDataFrame([], "key long, seq int, kind string, arg string"), proposals, unchanged)[0].count() == 0


def test_sites_join_where_ids_reach(spark):
    row = lambda key, n, north, point=None, operator=None, name=None, address=None, count=None: (key, n, None if north is None else 43 + north * M, 1.0, point, operator, name, address, count)
    rows = [
        row("a", 1, 0, "FRAAAE1"), row("b", 2, 390, "FR*AAA*P1"), row("c", 3, 780, "FRAAAE1"), row("d", 4, 5000, "FRAAAE1"), row("e", 5, 10_000, "FRAAAE1234567"), row("f", 6, 10_090, "FRBBBE1234567"), row("g", 7, 10_300, "FRCCCE1234567", "Else"),
        row("h", 8, 20_000, "X1", "Op", "Stop", count="3"), row("i", 9, 20_010, "X2", "Op SAS", "stop", count="2"), row("j", 10, 20_020, "X3", "Op", "STOP", count="1"), row("k", 11, 20_030, "X4", "Other", "Stop"), row("l", 12, None, "X4"),
        *[row(f"m{i}", 20 + i, 30_000, "Y1") for i in range(40)],
    ]
    df = spark.createDataFrame(rows, "key string, row long, lat double, lon double, point string, operator string, name string, address string, count string")
    got = {r["key"]: r["site"] for r in sites.bounded_sites(sites.site_links(df)).collect()}
    assert [got[k] for k in "abcdefg"] == ["a", "a", "a", "d", "e", "e", "g"]
    # Two stations of one name stay two, but a lone point of it joins both.
    assert [got[k] for k in "hijk"] == ["h", "h", "h", "k"] and "l" not in got and {got[f"m{i}"] for i in range(40)} == {"m0"}
    assert sites.bounded_edges(sites.site_links(df)).filter("a like 'm%'").count() == 39
    assert sites.bounded_sites(sites.site_links(df.filter("false"))).count() == 0


def test_what_lies_around_with_nulls(spark):
    base = "key long, lat double, lon double, name string, operator string, kind int, ids array<string>, soft_ids array<string>, access string, gone boolean, address string, contacts array<string>, company string"
    r = spark.createDataFrame([(1, 43.0, 1.0, "Blue House", None, 1, ["A"], ["S"], "yes", False, None, ["05"], None), (3, 43.0, 1.0, None, None, 1, [], [], None, False, None, [], None)], base)
    e = spark.createDataFrame([(10, 43.0, 1.0, "Blue House", "Op", 1, ["A"], [], None, False, None, [], None), (11, 43.0001, 1.0, None, None, 1, [], [], None, False, None, [], None), (12, 43.0001, 1.0, "Red", None, 1, [], [], None, False, None, [], None), (13, 43.0001, 1.0, None, None, 1, [], [], "private", False, None, [], None), (14, 43.0001, 1.0, None, None, 1, ["B"], [], None, False, "x", ["04", "05"], None), (15, 44.0, 1.0, None, None, 2, [], ["S"], None, False, None, [], None), (16, 44.0, 1.0, None, None, 2, [], ["S"], None, True, None, [], None)], base)
    matched = spark.createDataFrame([(1, 10), (3, 12)], "key long, element long")
    assert sorted((x["other"], x["by_id"]) for x in around.site_parts(matched, r, e).filter("key = 1").collect()) == [(11, False), (15, True)]
    assert [(x["key"], x["element"], x["reason"]) for x in around.siblings(r, e, matched).collect()] == [(1, 14, "contact")]
    assert [(x["key"], x["element"]) for x in around.unlisted(r, e).collect()] == [(1, 14)]
    assert around.site_parts(matched.filter("false"), r, e).count() == 0 and around.siblings(r.filter("false"), e, matched).count() == 0
    t = spark.createDataFrame([(1, 43.0, 1.0, "A", None, ["X"], None, None, None), (2, 43.0003, 1.0, "A", None, ["Y"], None, "o", None), (4, 43.0003, 1.0, "A", None, [], " ", "o", ""), (5, 50.0, 1.0, None, None, [], None, None, "")], "key long, lat double, lon double, name string, operator string, hard array<string>, line string, organisation string, address string")
    assert sorted((x["key"], x["reason"], x["n"], x["other"]) for x in link.twin_reasons(t).collect()) == [(1, "near", 1, 4), (2, "near", 1, 4), (2, "organisation", 1, 4), (4, "near", 2, 1), (4, "organisation", 1, 2)]


def plain_same_word(a, b):
    edits = abs(len(a) - len(b)) <= 1 and any(a[: i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) or b[:i] + b[i + 1 :] == a for i in range(max(len(a), len(b)) + 1))
    short = lambda x, y: len(x) * 2 <= len(y) and x[:1] == y[:1] and re.search(".*".join(x), y) is not None
    return a == b or (min(len(a), len(b)) >= 5 and edits) or short(a, b) or short(b, a)


def test_words_and_lines_of_addresses(spark):
    words = ["rue", "route", "docteur", "dr", "tuilier", "tuillier", "pont", "port", "gambetta", "gambeta", "amgbetta", "gal", "general", "x", "lions", "lion"]
    got = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", streets.same_word(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["s"] == plain_same_word(r["a"], r["b"]) for r in got)
    lines = [("49 Bd Lucien Sampaix", "49 Boulevard Lucien Sampaix"), ("12 bis av. du Gal Leclerc", "12 bis avenue du Général Leclerc"), ("RUE ST-MICHEL", "RUE SAINT-MICHEL"), ("3 r de la Paix", "3 rue de la Paix"), ("R Ste Anne", "Rue Sainte Anne"), ("place Bd", "place Bd"), ("rue Stage", "rue Stage"), (None, None)]
    assert list(one(spark, *[streets.expand_street(F.lit(a).cast("string")) for a, _ in lines])) == [b for _, b in lines]
    assert list(one(spark, *[streets.asked_number(F.lit(x)) for x in ("12 bis rue X", "6A rue", "rue 6", "36 ponts")])) == ["12bis", "6a", None, "36"]
    base = spark.createDataFrame([(1, "Rue Rebatel", "25", "69003", "Lyon", None, 1.0, 1.0), (2, "Avenue Félix Faure", "5", "69003", "Lyon", None, 2.0, 1.0), (3, "Rue Rebatel", None, "69003", "Lyon", None, 3.0, 1.0), (4, "Rue Ampère (Oullins)", "2", "69600", "Oullins-Pierre-Bénite", "Oullins", 4.0, 1.0)], "id long, street string, housenumber string, postcode string, city string, old_city string, lat double, lon double")
    asked = spark.createDataFrame([(1, "25 rue Rebatel 69003 Lyon"), (2, "rue Rebatel 69003 Lyon"), (3, "5 rue Félix Faure 69003 Lyon"), (4, "2 rue Ampere 69600 Oullins-Pierre-Bénite"), (5, None), (6, " "), (7, "25 rue Rebatel 69001 Lyon"), (8, "1 rue des Potiers 31000 Toulouse"), (9, "25 rue Rebatel 69003 Lyon")], "key long, line string")
    found_ = {r["key"]: (r["kind"], r["lat"], r["street"]) for r in addresses.placed(addresses.lookup(asked, base), base).collect()}
    assert found_[1] == ("address", 1.0, "Rue Rebatel") == found_[7] == found_[9] and found_[2] == ("street", 3.0, "Rue Rebatel")
    assert found_[3] == (None, None, "Avenue Félix Faure") and found_[4][:2] == ("address", 4.0) and not {5, 6, 8} & found_.keys()
    assert addresses.lookup(asked.filter("false"), base).count() == 0 and addresses.lookup(asked, base.filter("false")).count() == 0


def test_a_version_is_named_only_when_it_is_right(spark, tmp_path):
    import pytest

    from larkspan.operators import commits

    folder = str(tmp_path / "store")
    candidate, tag = "key long, area long, hash string, seen int, element long, base int", "key long, position int, op string, k string, v string"
    rows = spark.createDataFrame([(1, 1, "a", 1, 10, 1), (2, 1, "b", 1, None, None), (3, 2, "c", 1, 12, 1)], candidate)
    tags = spark.createDataFrame([(1, 0, "add", "x", "1"), (1, 1, "add", "y", "2"), (3, 0, "add", "x", "3")], tag)
    decided = spark.createDataFrame([(3,)], "key long")
    assert commits.present(spark, folder) is None
    assert commits.commit(rows, tags, decided, folder) == 0
    new = spark.createDataFrame([(1, 1, "a2", 2, 10, 2), (3, 2, "other", 2, 12, 2), (2, 2, "b", 2, None, None), (2, 3, "b", 2, None, None), (9, 3, None, 2, None, None)], candidate)
    new_tags = spark.createDataFrame([(1, 1, 0, "mod", "x", "9"), (3, 2, 0, "mod", "x", "9"), (2, 2, 0, "add", "z", "0"), (2, 3, 0, "add", "z", "1")], "key long, area long, position int, op string, k string, v string")
    after = commits.save_run(*commits.read(spark, folder), new, new_tags, decided, spark.createDataFrame([(2, 2)], "key long, area long"))
    assert sorted((r["key"], r["area"], r["state"]) for r in after[0].collect()) == [(1, 1, "changed"), (2, 2, "moved"), (3, 2, "kept"), (9, 3, "added")]
    assert sorted(tuple(r) for r in after[1].collect()) == [(1, 0, "mod", "x", "9"), (2, 0, "add", "z", "0"), (3, 0, "add", "x", "3")]
    assert commits.commit(*after, decided, folder) == 1 and commits.present(spark, folder) == 1
    for bad_rows, bad_tags, what in ((after[0].filter("key <> 1"), after[1], "tags without"), (after[0].unionByName(after[0]), after[1], "a key twice"), (after[0], after[1].unionByName(after[1].filter("key = 1")), "a position twice"), (after[0], after[1].filter("key <> 3"), "a decided candidate"), (after[0].withColumn("hash", F.lit("z")), after[1], "a decided candidate")):
        with pytest.raises(ValueError, match=what):
            commits.commit(bad_rows, bad_tags, decided, folder)
        assert commits.present(spark, folder) == 1 and commits.read(spark, folder)[0].count() == 4
    assert commits.commit(*commits.read(spark, folder), decided, folder) == 2
    held = commits.save_run(*commits.read(spark, folder), new.filter("key = 2").withColumn("area", F.lit(7).cast("long")), new_tags, decided, spark.createDataFrame([(2, 2)], "key long, area long"))
    assert {r["key"]: r["state"] for r in held[0].collect()} == {1: "old", 2: "held", 3: "old", 9: "old"}
    none = commits.save_run(*(df.limit(0) for df in commits.read(spark, folder)), new.limit(0), new_tags.limit(0), decided, new.select("key", "area").limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_uploads_stop_at_what_has_changed(spark):
    from larkspan.operators import commits

    staged = spark.createDataFrame([(1, 10, 2, "a", "1"), (2, 10, 2, "b", None), (3, 11, 1, "a", "1"), (4, 12, 1, "a", "1"), (5, 13, 3, "a", "same"), (6, 14, 3, "a", "x"), (7, 14, 3, "a", "y"), (8, 15, 1, "a", None)], "key long, element long, base int, k string, v string")
    elements = spark.createDataFrame([(10, 2, {"b": "old", "c": "c"}), (11, 2, {}), (13, 3, {"a": "same"}), (14, 3, {}), (15, 1, {"a": "x"})], "element long, version int, tags map<string,string>")
    plan, blocked = commits.upload_plan(staged, elements, 1)
    assert [(r["element"], r["after"], r["keys"], r["batch"]) for r in plan.orderBy("batch").collect()] == [(10, {"a": "1", "c": "c"}, [1, 2], 0), (15, {}, [8], 1)]
    assert sorted((r["key"], r["reason"]) for r in blocked.collect()) == [(3, "changed since"), (4, "gone"), (6, "disputed"), (7, "disputed")]


def test_answers_of_an_element_query(spark):
    import pytest

    from larkspan.sources import elements

    bodies = ['{"elements":[{"type":"node","id":1,"lat":0,"lon":2},{"type":"way","id":2,"bounds":{"minlat":1,"minlon":1,"maxlat":3,"maxlon":5},"tags":{"shop":"a","name":"x"},"version":4},{"type":"way","id":3},{"type":"area","id":4,"lat":1,"lon":1}]}', '{"elements":[]}', "{}", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = elements.parse_elements(df)
    assert sorted((r["id"], r["version"], r["lat"], r["lon"], r["tags"]) for r in got.collect()) == [(1, 1, 0.0, 2.0, {}), (2, 4, 2.0, 3.0, {"shop": "a", "name": "x"})]
    assert [tuple(r) for r in elements.count_places(got, ["shop"], F.lit("here")).collect()] == [("here", 2, 1)]
    for bad in ('{"remark":"runtime error: timed out","elements":[]}', "<html>"):
        with pytest.raises(Exception, match="element query failed"):
            elements.parse_elements(spark.createDataFrame([(bad,)], "body string")).collect()
    many = spark.range(1000).select(F.col("id"), F.create_map(F.lit("shop"), F.lit("same")).alias("tags"))
    assert [(r["n"], r["ids"]) for r in elements.value_audit(many, ["shop"]).collect()] == [(1000, [0, 1, 2])]


def test_what_an_operator_is_reached_by(spark):
    from larkspan.functions import registers, values

    said = [("tel:05.61.23.45.67", "+33 5 61 23 45 67"), ("374090105", "+33 3 74 09 01 05"), ("33975891501", "+33 9 75 89 15 01"), ("06 12 34 56 78", None), ("00 00 00 00 00", None), ("+33 1 23 45 67 89", None), ("01 00 00 00 00", None), ("01 00 00 00 01", "+33 1 00 00 00 01"), ("x", None), (None, None)]
    assert list(one(spark, *[registers.operator_phone(F.lit(a).cast("string")) for a, _ in said])) == [b for _, b in said]
    tags = F.create_map(*[F.lit(x) for x in ("contact:housenumber", "12", "addr:street", "Rue É", "phone", "+33 5 61 23 45 67", "contact:email", "A@b.org", "siret", "123 456")])
    got = one(spark, registers.address_key(tags), registers.contact_keys(tags), registers.company_number(tags), registers.address_key(F.create_map(F.lit("addr:street"), F.lit("x"))))
    assert list(got) == ["12 rue e", ["561234567", "a@b.org"], "123456", None]
    hosts = [("8.8.8.8", True), ("10.0.0.1", False), ("::1", False), ("::", False), ("fd00::1", False), ("fe80::1", False), ("ff02::1", False), ("2001:4860:4860::8888", True), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("256.1.1.1", None), ("host", None), (None, None)]
    assert list(one(spark, *[values.is_public_address(F.lit(a).cast("string")) for a, _ in hosts])) == [b for _, b in hosts]
