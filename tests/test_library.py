"""Every query of the library against its SQL, and the pieces that no query shows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspan.functions import geo, tags, text, values
from larkspan.operators import evidence, link, store
from larkspan.plans import desk_queries, register_queries, station_queries, tag_queries
from larkspan.plans import queries as library
from larkspan.plans.rules import EXAMPLE, ORDERS, Program, Rule
from larkspan.sources import crawl, pages, registry
from larkspan.streaming import attempts

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


MODULES = (library, tag_queries, desk_queries, register_queries, station_queries)
QUERIES = {name: f for m in MODULES for name, f in m.queries().items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    got = QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_an_empty_read_vanishes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "key long, hash string").withColumn("seen", F.lit("2024-01-01").cast("timestamp"))
    none = spark.createDataFrame([], "key long")
    assert {r["state"] for r in store.merge_snapshot(old, old.limit(0), none).collect()} == {"kept"}
    part = {r["key"]: r["state"] for r in store.merge_snapshot(old, old.filter("key = 1"), none).collect()}
    assert part == {1: "same", 2: "vanished"}


def test_reading_a_register(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name;lat\n1; Bread ;43.5\n2;;x\n", encoding="utf-8")
    df = registry.read_csv(spark, str(tmp_path / "a.csv"))
    got = registry.rename_columns(df, {"key": ["no", "id"], "name": ["name"], "gone": ["nowhere"]}).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("1", "Bread", ""), ("2", "", "")]
    assert registry.late_columns(df.drop("_bad"), ["id", "other"]) == (["name", "lat"], ["other"])


def test_a_mapping_is_checked(spark):
    assert EXAMPLE.check(spark.createDataFrame([(1,)], "l_orderkey long"))
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet")
    assert EXAMPLE.check(lines) == []
    assert ORDERS.check(lines) == ["value unused is not read"]
    rules = lambda *r: [Rule(k, v) for k, v in r]
    wrong = Program(inputs={"a": ["l_orderkey"], "b": ["l_partkey"], "c": ["nowhere"]}, key="a", values={"v": "b || missing"}, skip="a", rules=rules(("x", "nofunction(a)"), ("y", "array(a)"), ("z", "1 +")))
    said = wrong.check(lines)
    assert said[0] == "no column for input c" and [s.split(":")[0].split(" is ")[0] for s in said[1:]] == ["value v", "skip", "tag x", "tag y", "tag z"] and said[2] == "skip is string" and said[4] == "tag y is array<string>"
    unread = Program(inputs={"a": ["l_orderkey"], "b": ["l_partkey"], "c": ["l_suppkey"], "d": ["l_tax"]}, key="a", values={"used": "concat(b, 'x')", "idle": "concat(c, 'c')", "through": "upper(used)"}, rules=rules(("x", "through")))
    assert unread.check(lines) == ["input c is not read", "input d is not read", "value idle is not read"]
    assert "value that no rule reads" not in ORDERS.evaluate(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert ORDERS.evaluate(lines.limit(0)).count() == 0


QUOTES = ["six words stand right here now", "LUNCH from Noon", "bread", "rea", "ö", "ead ro", "fresh bread roll", "ro", "c++ (a.b) \\E [x]", "open every day\n from seven in the morning", "  ", "never stands anywhere in it", "day from seven in the morning until late at night"]
TEXTS = [
    "Say 😀 that six words stand right here now, then.", "xix words stand right here now", "lunch  from\tnoon, Bread roll", "Fresh bread rolls: c++ (a.b) \\E [x]", "We öpen; open every\u00a0day from\nseven  in the MORNING until late at night",
    "six words stand  right here now; six words stand right here now " + "x " * 100, "", None, "y " * 100 + "fresh bread roll" + " z" * 100,
]


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = evidence.quote_hits(docs, spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, quote string")).collect()
    want = {}
    for d, text in enumerate(TEXTS):
        for i, quote in enumerate(QUOTES):
            words = quote.split()
            tries = [re.escape(quote), r"\s+".join(map(re.escape, words)), "(?i)" + r"\s+".join(map(re.escape, words))]
            m = next((m for t in tries if words and (m := re.search(t, text or ""))), None)
            if m:
                flat = lambda x: re.sub(r"\s+", " ", x)
                want[d, i] = (m.start() + 1, flat(text[: m.start()]).lstrip()[-60:], flat(m[0]), flat(text[m.end() :]).rstrip()[:60])
    assert len(want) > 15
    assert {(r["doc_id"], r["item_id"]): (r["at"], r["before"], r["found"], r["after"]) for r in got} == want
    assert len(got) == len(want)


def test_short_passages_are_evidence(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["doc_id"], r["item_id"]): (r["at"], r["before"]) for r in library.quote_evidence(spark, str(tmp_path)).collect()}
    assert got[0, 0] == (12, "Say 😀 that ") and got[2, 1] == (1, "")


def test_page_text_is_whole(spark):
    df = spark.createDataFrame([("<p>" + "word " * 5000 + "end</p>",)], "html string")
    got = df.select(pages.html_text(F.col("html")).alias("whole"), pages.html_text(F.col("html"), 9).alias("cut")).first()
    assert got["whole"].split() == ["word"] * 5000 + ["end"] and len(got["cut"]) == 9


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_values_in_other_words(spark):
    lit = F.lit
    same = [
        ("name", "Café de la Gare", "CAFE DE LA GARE", True), ("name", "A & B", "A et B", True), ("operator", "ABC", "abc", True), ("ref", "007", "7", False), ("note", "ABC", "abc", False),
        ("addr:street", "Rue du Onze Novembre 1918", "Rue du 11 Novembre 1918", True), ("addr:street", "Rue du Dix-Sept Juin", "rue du 17 juin", True), ("addr:street", "Rue d'un Ami", "rue d 1 ami", False),
        ("phone", "+33 5 61 23 45 67", "05 61 23 45 67", True), ("phone", "+262 262 12 34 56", "0262 12 34 56", True), ("contact:phone", "+33 5 61 23 45 67", "05 61 23 45 68", False),
        ("website", "https://www.x.fr/", "http://x.fr", True), ("website", "http://x.fr", "https://x.fr/", True), ("website", "https://x.com", "https://x.fr", True), ("website", "https://x.fr/a", "https://x.fr/b", False),
        ("addr:housenumber", "158 BIS", "158bis", True), ("opening_hours", "Mo-Su 00:00-24:00", "24/7", True), ("socket:type2:output", "22 kW", "22.0", True),
        ("ref:x", "A1", "b2; a1", True), ("ref:x", "A1;C3", "a1", False), ("cuisine", "a;b", "b; a", True), ("cuisine", "a", "a;b", True), ("cuisine", "a;b", "a", False), ("shop", " deli", "deli ", True),
    ]
    got = one(spark, *[values.same_value(lit(k), lit(a), lit(b)) for k, a, b, _ in same])
    assert [(*x[:3], bool(g)) for x, g in zip(same, got, strict=True)] == same
    written = [("05.61.23.45.67", "+33 5 61 23 45 67"), ("+33 (0)6 12 34 56 78", "+33 6 12 34 56 78"), ("08 06 14 15 00", "08 06 14 15 00"), ("0262 12 34 56", "+262 262 12 34 56"), ("+508 41 23 45", "+508 41 23 45"), ("+590 0262 1", None), ("123", None), (None, None)]
    assert list(one(spark, *[values.phone_format(lit(a).cast("string")) for a, _ in written])) == [b for _, b in written]
    numbers = [("74bis", "74 bis"), ("6a", "6A"), ("07", "7"), ("12 B", "12B"), ("6a-8b", "6A-8B")]
    assert list(one(spark, *[values.spaced_number(lit(a)) for a, _ in numbers])) == [b for _, b in numbers]
    assert list(one(spark, values.power_class(lit("7400 W")), values.power_class(lit("7,4 kW")), values.power_class(lit("61")), values.power_class(lit("x")))) == [0, 0, 3, None]
    assert list(one(spark, values.one_edit(lit("gambetta"), lit("gambeta")), values.one_edit(lit("rue"), lit("roe")))) == [True, False]
    assert list(one(spark, text.normalise_name(lit("Škoda e\u0301 Œuvre ő")), text.company_key(lit("Power Dot France SAS")))) == ["skoda e oeuvre o", "powerdot"]


def test_positions(spark):
    lit = F.lit
    got = one(spark, geo.position(lit("0"), lit("0.0")), geo.position(lit("91"), lit("1")), geo.pair_position(lit("48.85, 2.35")), geo.geojson_position(lit('{"type":"Point","coordinates":[2.35,48.85]}')), geo.decimals(lit("48.850")))
    assert got[0] is None and got[1] is None and tuple(got[2]) == (48.85, 2.35) == tuple(got[3]) and got[4] == 2
    assert geo.scope_box((0.0, 0.0, 1.0, 1.0)) == (-0.002, -0.003, 1.002, 1.003)


def test_selectors():
    found = tags.parse_matching("shop=bakery|deli website=*; free text")
    assert found == [tags.Selector("shop", ("bakery", "deli")), tags.Selector("website")]
    assert tags.merge_selectors(found, [tags.Selector("shop", ("deli", "bakery"))]) == [tags.Selector("shop", ("deli", "bakery")), tags.Selector("website")]


def test_long_chains_are_one_site(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = spark.range(300).selectExpr("id AS key", "explode(array(id, id + 1)) AS id2").selectExpr("key", "cast(id2 AS string) AS id")
    assert {r["site"] for r in link.merge_sites(chain).collect()} == {0}


def test_pages_as_text(spark):
    page = '<p>A&#233;&#x20AC; &lt;b&gt;</p><svg><text>no</text></svg><script type="application/ld+json"> {"a":1} </script><td>x</td>y<!-- z -->'
    got = one(spark, pages.html_text(F.lit(page)), pages.html_text(F.lit(page), 3))
    assert got[0] == 'A\u00e9\u20ac <b>\nx\ny\n\nStructured data: {"a":1}' and got[1] == "A\u00e9\u20ac"


def test_what_a_crawl_may_read(spark):
    assert crawl.parse_budget("400 pages / run · 1 request / 2.5 s per host") == (400, 2500) and crawl.parse_budget("") == (100, 4000)
    assert crawl.parse_seeds("https://a.org/x, website=*") == (["https://a.org/x"], [tags.Selector("website")])
    with pytest.raises(ValueError, match="seed rule"):
        crawl.parse_seeds("nothing")
    file = "User-agent: a\nUser-agent: Reader/3\nDisallow: /p # no\nAllow: /p/q$\n\nUser-agent: *\nDisallow: /\nbad line\nUser-agent: reader\nDisallow: /*.pdf"
    files = {"a": file, "b": "", "c": None, "d": "Disallow: /\r\nUser-agent: *\r\nAllow: /x\r\nDisallow: /x\r\nDisallow: /y?z=(1)\r\nDisallow:", "e": "User-agent: reader\nCrawl-delay: 3\nUser-agent: *\nDisallow: /"}
    robots = spark.createDataFrame(list(files.items()), "host string, robots string")
    paths = ["/", "/p", "/p/q", "/p/qq", "/x.pdf", "/x", "/y?z=(1)", "/y?z=1", None]
    pages_ = spark.createDataFrame([(h, p) for h in (*files, "f") for p in paths], "host string, path string")

    def barred(agent):
        read = {(r["host"], r["path"]) for r in crawl.allowed_pages(pages_, robots, agent).collect()}
        return {h: [p for p in paths if (h, p) not in read] for h in (*files, "f")}

    assert barred("Reader/1.0") == {"a": ["/p", "/p/qq", "/x.pdf"], "b": [], "c": [], "d": ["/y?z=(1)"], "e": [], "f": []}
    assert barred("Else") == {"a": paths, "b": [], "c": [], "d": ["/y?z=(1)"], "e": paths, "f": []}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:14:59"), (1, "2024-01-01 00:30:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00"), (3, "2024-01-01 00:15:00"), (3, "2024-01-01 00:29:59")], "user_id long, at string").selectExpr("user_id", "cast(at AS timestamp) AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = attempts.attempt_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["user_id"], r["n"]) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    assert sorted((r["user_id"], r["n"]) for r in attempts.attempt_islands(rows.withColumn("event_id", F.lit(1))).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]

    land = lambda data: spark.createDataFrame(data, "key long, hash string, seen long").coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    decided = spark.createDataFrame([(2,)], "key long")
    for n, data in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (2, "d", 2), (3, "e", 2)])):
        land(data)
        landed = spark.readStream.schema("key long, hash string, seen long").parquet(str(tmp_path / "landed"))
        attempts.snapshot_stream(landed, decided, str(tmp_path / "snapshot"), str(tmp_path / "marks")).awaitTermination()
        last = spark.read.parquet(str(tmp_path / f"snapshot/version={n}"))
    assert sorted(tuple(r) for r in last.select("key", "hash", "seen").collect()) == [(1, "c", 2), (2, "b", 1), (3, "e", 2)]
