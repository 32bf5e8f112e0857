"""Values, positions and tags over the given tables, each with the SQL that it must agree with.

Customers and parts stand for records and objects; what tags or raw values they carry is a rule over their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tags, values
from ..steps import checkpointed, spread
from ..operators import plan

MAIN = ("amenity", "shop", "office")
TODAY = "2024-07-01"
FILTER = "shop=bakery|deli amenity=fuel, website=* nonsense"
KIN = {("shop", "bakery"): ("bakery", "pastry")}
DEPRECATED = (({"shop": "deli"}, {"shop": "delicatessen"}), ({"old_ref": "*"}, {"ref": "$1"}), ({"office": "firm"}, None))
DAYS = (
    "Premier", "Deux", "Trois", "Quatre", "Cinq", "Six", "Sept", "Huit", "Neuf", "Dix", "Onze", "Douze", "Treize", "Quatorze", "Quinze", "Seize", "Dix-Sept", "Dix-Huit", "Dix-Neuf",
    "Vingt", "Vingt et Un", "Vingt-Deux", "Vingt-Trois", "Vingt-Quatre", "Vingt-Cinq", "Vingt-Six", "Vingt-Sept", "Vingt-Huit", "Vingt-Neuf", "Trente", "Trente et Un",
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and raw spellings of numbers, phones, lines and powers, by the customer's key."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")), "id")
    n = F.lpad((F.col("id") * 7919 % 100000000).cast("string"), 8, "0")
    pick = lambda *cases: F.element_at(F.array(*cases), (F.col("id") % len(cases) + 1).cast("int"))
    dotted = F.concat_ws(".", *[F.substring(n, i, 2) for i in (1, 3, 5, 7)])
    return c.select(
        "id", n.alias("n"),
        pick(F.concat(F.lit("0"), F.col("id").cast("string"), F.lit(" bis")), F.concat(F.col("id").cast("string"), F.lit("a")), F.concat(F.lit("00"), F.col("id").cast("string"), F.lit(" B")), F.concat(F.col("id").cast("string"), F.lit("TER"))).alias("number"),
        pick(F.concat(F.lit("05."), dotted), F.concat(F.lit("+33 (0)6 "), n), F.concat(F.lit("0033 8"), n), F.concat(F.lit("+262 6 92 "), F.substring(n, 1, 6)), F.concat(F.lit("+508 "), F.substring(n, 1, 6)), F.concat(F.lit("15 "), n)).alias("phone"),
        F.concat(F.lit("12 rue Haute "), F.lpad((F.col("id") % 90000 + 10000).cast("string"), 5, "0"), F.lit(" Ville "), F.col("id").cast("string")).alias("line"),
        pick(F.concat(F.col("id").cast("string"), F.lit(" W")), F.concat((F.col("id") % 90).cast("string"), F.lit(",5 kW")), (F.col("id") % 90).cast("string"), F.lit("fast")).alias("power"),
    )


_CUSTOMERS = """c AS (SELECT c_custkey AS id, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS n FROM customer),
w AS (SELECT id, n,
  CASE id % 4 WHEN 0 THEN '0' || id || ' bis' WHEN 1 THEN id || 'a' WHEN 2 THEN '00' || id || ' B' ELSE id || 'TER' END AS number,
  CASE id % 6 WHEN 0 THEN '05.' || n[1:2] || '.' || n[3:4] || '.' || n[5:6] || '.' || n[7:8] WHEN 1 THEN '+33 (0)6 ' || n WHEN 2 THEN '0033 8' || n WHEN 3 THEN '+262 6 92 ' || n[1:6] WHEN 4 THEN '+508 ' || n[1:6] ELSE '15 ' || n END AS phone,
  '12 rue Haute ' || (id % 90000 + 10000) || ' Ville ' || id AS line,
  CASE id % 4 WHEN 0 THEN id || ' W' WHEN 1 THEN (id % 90) || ',5 kW' WHEN 2 THEN (id % 90)::VARCHAR ELSE 'fast' END AS power FROM c)"""


def number_forms(spark, sf_dir):
    """House numbers as they compare and as they are written, powers by class, distances and references to show."""
    c = _customers(spark, sf_dir)
    d = F.col("id") * F.lit(0.7)
    return c.select(
        "id", values.compact_number(F.col("number")).alias("compact"), values.house_number(F.col("number")).alias("folded"), values.spaced_number(F.col("number")).alias("spaced"),
        values.power_class(F.col("power")).alias("power_class"), values.metres_label(d).alias("away"), values.element_ref(F.lit("node"), F.col("id")).alias("ref"),
        values.clip(F.repeat(F.lit("ab"), (F.col("id") % 200).cast("int")), 255).alias("clipped"), values.hashtags(F.concat(F.lit("#a b"), F.col("id").cast("string"), F.lit("; ,c"))).alias("hashtags"),
    )


def phone_forms(spark, sf_dir):
    """Phone numbers as they are written, as they compare, and whether they are mobile ones."""
    c = _customers(spark, sf_dir)
    return c.select("id", values.phone_format(F.col("phone")).alias("written"), values.phone_digits(F.col("phone")).alias("digits"), values.is_mobile(F.col("phone")).alias("mobile"))


def address_forms(spark, sf_dir):
    """Postcodes and communes of address lines, what to ask an address base, streets with their days in digits."""
    c = _customers(spark, sf_dir)
    code, city = values.postcode_of(F.col("line")), values.commune_of(F.col("line"))
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("id") % 31 + 1).cast("int"))
    street = F.concat(F.lit("Rue du "), day, F.lit(" Novembre & Fils"))
    asked = F.when(F.col("id") % 2 == 0, "12 rue Haute").otherwise(F.col("line"))
    return c.select("id", code.alias("postcode"), city.alias("commune"), values.address_query(asked, code, city).alias("asked"), values.street_digits(values.fold(street)).alias("street"))


def same_values(spark, sf_dir):
    """Which spellings of a value agree, by the kind of key."""
    c = _customers(spark, sf_dir).withColumn("t", F.col("id").cast("string"))
    t, pick = F.col("t"), F.element_at
    kinds = F.array(*[
        F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")) for k, a, b in (
            ("operator", F.concat(F.lit("Café & Fils "), t), F.concat(F.lit("cafe ET fils "), t)), ("phone", F.col("phone"), values.phone_digits(F.col("phone"))),
            ("ref:x", F.concat(F.lit("FR*"), t), F.concat(F.lit("zz; fr"), t)), ("ref:x", F.concat(F.lit("FR*"), t, F.lit(";q")), F.concat(F.lit("fr"), t)),
            ("cuisine", t, F.concat(F.lit("a; "), t)), ("cuisine", F.concat(t, F.lit(";a")), F.concat(F.lit("a ;"), t)), ("cuisine", F.concat(t, F.lit(";a")), t),
            ("socket:type2:output", F.concat(t, F.lit(".0 kW")), t), ("addr:housenumber", F.concat(F.lit("0"), t, F.lit(" BIS")), F.concat(t, F.lit("bis"))), ("ref", F.concat(F.lit("0"), t), t),
            ("note", F.concat(F.lit("A"), t), F.concat(F.lit("a"), t)), ("contact:website", F.concat(F.lit("http://www.x.org/"), t), F.concat(F.lit("https://x.org/"), t, F.lit("/more"))),
            ("website", F.concat(F.lit("x"), t, F.lit(".com")), F.concat(F.lit("https://x"), t, F.lit(".fr/"))), ("website", F.concat(F.lit("https://x.org/a"), t), F.lit("http://x.org/b")),
            ("opening_hours", F.lit("Mo-Su 00:00-23:59"), F.lit("24/7")), ("addr:street", F.lit("Rue du Onze Novembre"), F.concat(F.lit("rue du "), (F.col("id") % 12).cast("string"), F.lit(" novembre"))),
        )
    ])
    rows = c.select("id", F.posexplode(kinds).alias("case", "x")).select("id", "case", "x.*")
    # A column of its own, so that values are compared once and not for each of the two sums.
    rows = rows.withColumn("same", values.same_value(F.col("k"), F.col("a"), F.col("b")))
    return rows.groupBy("case", "k").agg(F.count_if("same").alias("agree"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("same"), F.col("id")).otherwise(0)).alias("ids"))


def page_sites(spark, sf_dir):
    """Pages against the root and a page of their own site and the site under another ending."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    root, other = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.regexp_replace("url", r"\.[a-z]+/", ".example/")
    return p.select("page_id", values.same_site(F.col("url"), root).alias("root"), values.same_site(root, F.col("url")).alias("page"), values.same_url(F.col("url"), root).alias("one_page"), values.same_site(F.col("url"), other).alias("other_ending"), values.website(F.concat(root, F.lit("/#top"))).alias("website"))


def positions(spark, sf_dir):
    """Positions from pairs, texts and GeoJSON points; decimals, the country's boxes, the distance to a box's nearest edge."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    lat, lon = F.format_string("%.2f", (F.col("id") * 37 % 20000) / 100 - 100), F.format_string("%.1f", (F.col("id") * 91 % 4000) / 10 - 200)
    zero = F.col("id") % 97 == 0
    lat, lon = F.when(zero, "0").otherwise(lat), F.when(zero, "0.0").otherwise(lon)
    pair = F.concat(lat, F.lit(" , "), lon)
    point = F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}"))
    at = geo.position(lat, lon)
    rows = c.select("id", at.alias("at"), geo.pair_position(pair).alias("pair"), geo.geojson_position(point).alias("json"), F.least(geo.decimals(lat), geo.decimals(lon)).alias("places"))
    box = tuple(F.lit(x) for x in (41.0, -5.5, 51.5, 10.0))
    return rows.select(
        "id", "at.lat", "at.lon", (F.col("pair").isNotNull() & F.col("pair").eqNullSafe(F.col("at"))).alias("from_text"), (F.col("json").isNotNull() & F.col("json").eqNullSafe(F.col("at"))).alias("from_json"), "places",
        values.in_country(F.col("at.lat"), F.col("at.lon")).alias("inside"), F.round(geo.distance_to(F.col("at.lat"), F.col("at.lon"), *box) / 1000, 0).alias("km_to_box"),
    )


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and tags of the parts, as rows k, v by rules over the key."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), "p_name", "p_brand"), "key")
    key = F.col("key")
    rule = lambda k, when, v: F.when(when, F.struct(F.lit(k).alias("k"), v.alias("v")))
    shop = F.element_at(F.array(*[F.lit(x) for x in ("bakery", "pastry", "deli", "kiosk")]), (key % 4 + 1).cast("int"))
    rows = F.array_compact(F.array(
        rule("name", key % 5 != 0, F.col("p_name")), rule("was:name", key % 15 == 0, F.col("p_name")), rule("operator", key % 3 == 0, F.col("p_brand")), rule("shop", key % 2 == 0, shop), rule("amenity", key % 7 == 0, F.lit("fuel")),
        rule("disused:shop", key % 9 == 1, F.lit("kiosk")), rule("building", key % 11 == 0, F.lit("retail")), rule("landuse", key % 23 == 0, F.lit("construction")), rule("opening_date", key % 29 == 0, F.when(key % 2 == 0, "2025-01-01").otherwise("2023-01-01")),
        rule("website", key % 13 == 0, F.concat(F.lit("https://x.org/"), key.cast("string"))), rule("phone", key % 6 == 0, F.lit("+33 5 61 23 45 67")), rule("contact:email", key % 8 == 1, F.lit("a@x.org")), rule("check_date", key % 10 == 3, F.when(key % 20 == 3, "2024-05").otherwise("2022-05-01")),
        rule("survey:date", key % 20 == 3, F.lit("2024-04-30")), rule("addr:city", key % 4 == 1, F.lit("Ville")), rule("contact:street", key % 12 == 5, F.lit("Rue Haute")), rule("ref:x", key % 3 == 1, F.concat(F.lit("A"), key.cast("string"), F.lit("; b"), (key % 5).cast("string"))),
        rule("old_ref", key % 31 == 0, key.cast("string")), rule("socket:unknown", key % 14 == 0, F.lit("2")), rule("opening_hours", key % 16 == 0, F.lit("24/7")),
    ))
    return p.select("key", F.explode(rows).alias("t")).select("key", "t.k", "t.v")


_OBJECTS = """p AS (SELECT p_partkey AS key, p_name, p_brand FROM part),
t AS (
  SELECT key, 'name' AS k, p_name AS v FROM p WHERE key % 5 <> 0 UNION ALL SELECT key, 'was:name', p_name FROM p WHERE key % 15 = 0 UNION ALL SELECT key, 'operator', p_brand FROM p WHERE key % 3 = 0
  UNION ALL SELECT key, 'shop', ['bakery', 'pastry', 'deli', 'kiosk'][key % 4 + 1] FROM p WHERE key % 2 = 0 UNION ALL SELECT key, 'amenity', 'fuel' FROM p WHERE key % 7 = 0
  UNION ALL SELECT key, 'disused:shop', 'kiosk' FROM p WHERE key % 9 = 1 UNION ALL SELECT key, 'building', 'retail' FROM p WHERE key % 11 = 0 UNION ALL SELECT key, 'landuse', 'construction' FROM p WHERE key % 23 = 0
  UNION ALL SELECT key, 'opening_date', CASE WHEN key % 2 = 0 THEN '2025-01-01' ELSE '2023-01-01' END FROM p WHERE key % 29 = 0 UNION ALL SELECT key, 'website', 'https://x.org/' || key FROM p WHERE key % 13 = 0
  UNION ALL SELECT key, 'phone', '+33 5 61 23 45 67' FROM p WHERE key % 6 = 0 UNION ALL SELECT key, 'contact:email', 'a@x.org' FROM p WHERE key % 8 = 1
  UNION ALL SELECT key, 'check_date', CASE WHEN key % 20 = 3 THEN '2024-05' ELSE '2022-05-01' END FROM p WHERE key % 10 = 3 UNION ALL SELECT key, 'survey:date', '2024-04-30' FROM p WHERE key % 20 = 3
  UNION ALL SELECT key, 'addr:city', 'Ville' FROM p WHERE key % 4 = 1 UNION ALL SELECT key, 'contact:street', 'Rue Haute' FROM p WHERE key % 12 = 5 UNION ALL SELECT key, 'ref:x', 'A' || key || '; b' || (key % 5) FROM p WHERE key % 3 = 1
  UNION ALL SELECT key, 'old_ref', key::VARCHAR FROM p WHERE key % 31 = 0 UNION ALL SELECT key, 'socket:unknown', '2' FROM p WHERE key % 14 = 0 UNION ALL SELECT key, 'opening_hours', '24/7' FROM p WHERE key % 16 = 0)"""


def _tagged(spark, sf_dir):
    return plan.tag_map(_objects(spark, sf_dir))


def tag_selectors(spark, sf_dir):
    """Objects that a filter, a kind or a bare building means."""
    m = F.col("tags")
    asked = tags.parse_matching(FILTER)
    derived = tags.selectors_from_tags([("shop", "bakery"), ("note", "x")], MAIN, KIN)
    but = tags.Selector("shop", None, "amenity", ("fuel",))
    return _tagged(spark, sf_dir).select(
        "key", tags.selects_any(asked, m).alias("asked"), tags.selects_any(derived, m).alias("derived"), tags.selects(but, m).alias("not_fuel"),
        tags.same_kind("shop", KIN[("shop", "bakery")], m).alias("kin"), tags.shell(m, "building", ("retail",), MAIN).alias("shell"),
    )


def became_other(spark, sf_dir):
    """Why objects are no longer the place of a shop's record."""
    why = tags.not_the_place(F.col("tags"), MAIN, F.lit(TODAY).cast("date"), F.lit("shop"))
    return _tagged(spark, sf_dir).select("key", why.alias("why")).filter("why is not null")


def ids_rule_out(spark, sf_dir):
    """Objects whose ids rule them out for a record, and those that carry others' ids besides its own."""
    theirs = tags.ids_on(F.col("tags"), ("ref:x", "ref:y"))
    ours = F.array(F.concat(F.lit("B"), (F.col("key") % 7).cast("string")))
    return _tagged(spark, sf_dir).select("key", F.array_join(theirs, ";").alias("ids"), tags.rules_out(ours, theirs).alias("out"), tags.held_with_others(ours, theirs).alias("others"))


def reviewer_context(spark, sf_dir):
    """What reviewers see of an object: unchanged tags that matter, its latest survey, deprecated tags."""
    m, touched = F.col("tags"), F.array(F.lit("operator"), F.lit("disused:shop"))
    kept = tags.unchanged_tags(m, touched)
    return _tagged(spark, sf_dir).select(
        "key", F.size(kept).alias("n_unchanged"), F.array_join(tags.context_tags(kept, ("name", "shop", "amenity", "website")), ", ").alias("context"), tags.recent_survey(m, F.lit(TODAY).cast("date")).alias("survey"),
        F.array_join(tags.deprecated_lines(F.array(F.lit("shop"), F.lit("old_ref")), m, DEPRECATED), "\n").alias("deprecated"),
    )


def _proposed(spark, sf_dir):
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), "p_name"), "key")
    row = lambda k, v, add_only=False, grp=None: F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(add_only).alias("add_only"), F.lit(grp).cast("string").alias("grp"))
    rows = F.array(
        row("name", F.upper("p_name")), row("shop", F.lit("bakery")), row("phone", F.lit("05 61 23 45 67")), row("website", F.lit("https://y.org")), row("email", F.lit("b@x.org")), row("opening_hours", F.lit("24/7")), row("operator", F.lit("New"), True),
        row("socket:type2", F.lit("4")), row("addr:street", F.lit("rue haute"), False, "addr"), row("addr:city", F.when(F.col("key") % 8 == 1, "Autre").otherwise("Ville"), False, "addr"),
    )
    return p.select("key", F.explode(rows).alias("r")).select("key", "r.*")


def update_plan(spark, sf_dir):
    """What the records would write on the objects: additions, changes, deletions and moves."""
    return plan.update_ops(_proposed(spark, sf_dir), _tagged(spark, sf_dir), MAIN, ("ref:x",)).select("key", "k", "op", "v", "was", "pair")


def plan_effects(spark, sf_dir):
    """How many tags the objects have after the plan, whether it changes them, and what is left of it against the result."""
    objects = checkpointed(_tagged(spark, sf_dir))
    ops = plan.update_ops(_proposed(spark, sf_dir), objects, MAIN, ("ref:x",))
    done = checkpointed(plan.applied(ops, objects))
    left = plan.rebase(ops, done.select("key", F.col("after").alias("tags"))).groupBy("key").agg(F.count(F.lit(1)).alias("left"))
    return done.join(left, "key", "left").select("key", F.size("tags").alias("before"), F.size("after").alias("after"), "changes", F.coalesce("left", F.lit(0).cast("long")).alias("left"))


def closure_plan(spark, sf_dir):
    """Operations of closed places and of new ones."""
    objects = _tagged(spark, sf_dir)
    closed = objects.filter("key % 10 < 4").select("key", F.when(F.col("key") % 10 == 0, "amenity").alias("own"))
    new = plan.new_ops(_proposed(spark, sf_dir).filter("key % 50 = 7"))
    return plan.closure_ops(closed, objects, MAIN).unionByName(new).select("key", "k", "op", "v", "was")


def contradicted(spark, sf_dir):
    """Operations that another record on the same object contradicts, with their group or other half."""
    ops = plan.update_ops(_proposed(spark, sf_dir), _tagged(spark, sf_dir), MAIN).withColumn("element", F.col("key") % 40).withColumnRenamed("key", "record")
    ops = checkpointed(ops.withColumn("grp", F.when(F.startswith("k", F.lit("addr:")), "addr")))
    others = ops.filter("op <> 'del'").select("record", "element", "k", "v")
    return plan.disputed_with_groups(ops.select("record", "element", "k", "op", "v", "grp", "pair"), others).select("record", "k", "op")


def left_out(spark, sf_dir):
    """Which operations a plan leaves out, and why."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("key") % 300).cast("int"))
    op = lambda k, v, grp=None: F.struct(F.lit(k).alias("k"), F.lit("add").alias("op"), v.alias("v"), F.lit(grp).cast("string").alias("grp"))
    ops = p.select("key", F.explode(F.array(op("name", F.lit("a")), op("shop", F.lit("b")), op("phone", F.lit("1")), op("addr:city", F.lit("c"), "addr"), op("start_date", day.cast("string")), op("ref:x", F.lit("d")), op("ref:org", F.lit("e")), op("building", F.lit("f")), op("capacity", F.lit("2")), op("socket:type2:output", F.lit("22 kW")))).alias("o")).select("key", "o.*")
    n = F.col("key")
    facts = p.select(
        "key", (n % 4 == 0).alias("far"), (n % 8 == 0).alias("placeless"), (n % 5 == 0).alias("gone"), (n % 6 == 0).alias("shared"), (n % 7 == 0).alias("grounds"), F.lit("shop").alias("main"),
        F.when(n % 3 != 0, F.lit("2020-01-01").cast("date")).alias("mapped_on"), F.when(n % 2 == 1, 100).alias("within"), F.when(n % 9 == 0, F.array(F.lit("ref:x"), F.lit("phone"))).alias("disputed"),
        F.when(n % 10 == 3, "all").when(n % 10 < 3, "own").alias("counts"),
    )
    return plan.suppressed(ops, facts, ["ref:org"], "building").select("key", "k", "reason").filter("reason is not null")


def overwritten(spark, sf_dir):
    """A line for each value that the plan would overwrite."""
    objects = _tagged(spark, sf_dir)
    ops = plan.update_ops(_proposed(spark, sf_dir).filter("k in ('shop', 'email')"), objects, MAIN)
    return plan.mod_warnings(ops, objects.select("key", tags.recent_survey(F.col("tags"), F.lit(TODAY).cast("date")).alias("survey"))).select("key", "k", "warning")


def queries():
    names = (
        number_forms, phone_forms, address_forms, same_values, page_sites, positions, tag_selectors, became_other, ids_rule_out, reviewer_context, update_plan, plan_effects, closure_plan, contradicted, left_out, overwritten,
    )
    return {f.__name__: f for f in names}


_DIGITS = "regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^(00)?(33|262|590|594|596)([0-9]{9})$', '0\\3')"
_DIGITS = f"regexp_replace({_DIGITS}, '^(00)?508([0-9]{{6}})$', '0508\\2')"
_TAG = lambda k: f"max(v) FILTER (WHERE k = '{k}')"
_WIDE = "o AS (SELECT key, count(*) AS n, " + ", ".join(f"{_TAG(k)} AS {k.replace(':', '_')}" for k in (
    "name", "was:name", "operator", "shop", "amenity", "disused:shop", "building", "landuse", "opening_date", "website", "phone", "contact:email", "check_date", "survey:date", "addr:city", "contact:street", "ref:x", "old_ref", "socket:unknown", "opening_hours",
)) + " FROM t GROUP BY key)"
_WHY = """CASE WHEN shop IS NULL AND amenity IS NULL AND disused_shop IS NOT NULL THEN 'it is mapped as disused:shop=' || disused_shop WHEN was_name IS NOT NULL AND name IS NULL THEN 'its name was removed (was:name=' || was_name || ')'
WHEN landuse = 'construction' OR opening_date > '2024-07-01' THEN 'it is under construction' || coalesce(' (opening_date=' || opening_date || ')', '') WHEN shop IS NULL AND amenity IS NOT NULL THEN 'it is now amenity=' || amenity END"""
#: The plan's operations, key by key; all parts are asked, so those without any tag too.
_PLAN = f"""{_OBJECTS}, {_WIDE},
a AS (SELECT p.key, upper(p.p_name) AS new_name, CASE WHEN p.key % 8 = 1 THEN 'Autre' ELSE 'Ville' END AS new_city, o.* EXCLUDE (key) FROM p LEFT JOIN o ON p.key = o.key),
ops AS (
  SELECT key, 'name' AS k, CASE WHEN name IS NULL THEN 'add' ELSE 'mod' END AS op, new_name AS v, name AS was, NULL AS pair FROM a WHERE name IS NULL OR trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) <> trim(regexp_replace(lower(new_name), '[^a-z0-9]+', ' ', 'g'))
  UNION ALL SELECT key, 'shop', CASE WHEN shop IS NULL THEN 'add' ELSE 'mod' END, 'bakery', shop, NULL FROM a WHERE disused_shop IS NULL AND (shop IS NULL OR shop <> 'bakery')
  UNION ALL SELECT key, CASE WHEN contact_email IS NOT NULL THEN 'contact:phone' ELSE 'phone' END, 'add', '05 61 23 45 67', NULL, NULL FROM a WHERE phone IS NULL
  UNION ALL SELECT key, CASE WHEN website IS NULL AND contact_email IS NOT NULL THEN 'contact:website' ELSE 'website' END, CASE WHEN website IS NULL THEN 'add' ELSE 'mod' END, 'https://y.org', website, NULL FROM a
  UNION ALL SELECT key, CASE WHEN contact_email IS NOT NULL THEN 'contact:email' ELSE 'email' END, CASE WHEN contact_email IS NOT NULL THEN 'mod' ELSE 'add' END, 'b@x.org', contact_email, NULL FROM a
  UNION ALL SELECT key, 'opening_hours', 'add', '24/7', NULL, NULL FROM a WHERE opening_hours IS NULL UNION ALL SELECT key, 'operator', 'add', 'New', NULL, NULL FROM a WHERE operator IS NULL
  UNION ALL SELECT key, 'socket:type2', 'add', '4', NULL, NULL FROM a UNION ALL SELECT key, 'socket:unknown', 'del', socket_unknown, NULL, NULL FROM a WHERE socket_unknown IS NOT NULL
  UNION ALL SELECT key, 'addr:street', 'add', 'rue haute', NULL, NULL FROM a WHERE contact_street IS NULL AND (addr_city IS NULL OR addr_city = new_city)
  UNION ALL SELECT key, 'addr:city', 'add', new_city, NULL, NULL FROM a WHERE addr_city IS NULL
  UNION ALL SELECT key, 'addr:street', 'add', contact_street, NULL, 'contact:street' FROM a WHERE contact_street IS NOT NULL AND (addr_city IS NULL OR addr_city = new_city)
  UNION ALL SELECT key, 'contact:street', 'del', contact_street, NULL, 'addr:street' FROM a WHERE contact_street IS NOT NULL AND (addr_city IS NULL OR addr_city = new_city))"""

SQL = {
    "number_forms": rf"""WITH {_CUSTOMERS}, k AS (SELECT *, regexp_replace(regexp_replace(number, '\s+', '', 'g'), '^0+([0-9])', '\1') AS compact FROM w),
x AS (SELECT *, CASE id % 4 WHEN 0 THEN id || ' bis' WHEN 1 THEN id || 'A' WHEN 2 THEN id || 'B' ELSE id || ' ter' END AS spaced, CASE id % 4 WHEN 0 THEN id / 1000.0 WHEN 1 THEN id % 90 + 0.5 WHEN 2 THEN id % 90 END AS kw FROM k)
SELECT id, compact, lower(compact) AS folded, spaced, ((kw > 8)::INT + (kw > 22)::INT + (kw > 60)::INT)::INT AS power_class, CASE WHEN id * 0.7::DOUBLE < 1000 THEN floor(id * 0.7::DOUBLE + 0.5)::BIGINT || ' m' ELSE round(printf('%.25f', id * 0.7::DOUBLE / 1000)::DECIMAL(38, 25), 1)::DECIMAL(18, 1)::VARCHAR || ' km' END AS away, 'node/' || id AS ref,
CASE WHEN id % 200 > 127 THEN repeat('ab', 127) || '…' ELSE repeat('ab', (id % 200)::INT) END AS clipped, '#a;#b' || id || ';#c' AS hashtags FROM x""",
    "phone_forms": rf"""WITH {_CUSTOMERS}, d AS (SELECT *, {_DIGITS} AS digits, CASE id % 6 WHEN 0 THEN '05' ELSE '06' END || n[1:2] AS head FROM w),
o AS (SELECT *, CASE WHEN head IN ('0639', '0692', '0693') THEN '262' WHEN head IN ('0590', '0690', '0691') THEN '590' WHEN head IN ('0594', '0694') THEN '594' WHEN head IN ('0596', '0696', '0697') THEN '596' END AS code, ' ' || n[3:4] || ' ' || n[5:6] || ' ' || n[7:8] AS rest FROM d)
SELECT id, CASE WHEN id % 6 = 0 AND head = '0508' THEN '+508' || rest WHEN id % 6 IN (0, 1) AND code IS NOT NULL THEN '+' || code || ' ' || head[2:4] || rest WHEN id % 6 IN (0, 1) THEN '+33 ' || head[2:2] || ' ' || n[1:2] || rest
WHEN id % 6 = 2 THEN '08 ' || n[1:2] || ' ' || n[3:4] || ' ' || n[5:6] || ' ' || n[7:8] WHEN id % 6 = 3 THEN '+262 692 ' || n[1:2] || ' ' || n[3:4] || ' ' || n[5:6] WHEN id % 6 = 4 THEN '+508 ' || n[1:2] || ' ' || n[3:4] || ' ' || n[5:6] END AS written,
digits, digits[1:2] IN ('06', '07') AS mobile FROM o""",
    "address_forms": f"""WITH {_CUSTOMERS} SELECT id, (id % 90000 + 10000)::VARCHAR AS postcode, 'Ville ' || id AS commune, CASE WHEN id % 2 = 0 THEN '12 rue Haute ' || (id % 90000 + 10000) || ' Ville ' || id ELSE line END AS asked,
'rue du ' || (id % 31 + 1) || ' novembre et fils' AS street FROM w""",
    "same_values": """WITH c AS (SELECT c_custkey AS id FROM customer), k AS (SELECT unnest(range(16))::INT AS "case", unnest(['operator', 'phone', 'ref:x', 'ref:x', 'cuisine', 'cuisine', 'cuisine', 'socket:type2:output', 'addr:housenumber', 'ref', 'note', 'contact:website', 'website', 'website', 'opening_hours', 'addr:street']) AS k)
SELECT "case", k, sum(y::INT)::BIGINT AS agree, count(*) AS n, sum(CASE WHEN y THEN id ELSE 0 END)::BIGINT AS ids FROM (SELECT c.id, k.*, "case" IN (0, 1, 2, 4, 5, 7, 8, 11, 12, 14) OR ("case" = 15 AND c.id % 12 = 11) AS y FROM c, k) GROUP BY 1, 2""",
    "page_sites": r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/]+)(.*)$', ['scheme', 'host', 'path']) AS x FROM pages)
SELECT page_id, true AS root, true AS page, rtrim(regexp_replace(x.path, '[?#].*$', ''), '/') = '' AS one_page, true AS other_ending, x.scheme || '://' || x.host AS website FROM u""",
    "positions": """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE c_custkey * 37 % 20000 / 100.0::DOUBLE - 100 END AS lat, CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE c_custkey * 91 % 4000 / 10.0::DOUBLE - 200 END AS lon FROM customer),
f AS (SELECT id, printf('%.2f', lat) AS ta, printf('%.1f', lon) AS to_, abs(round(lat, 2)) <= 90 AND abs(round(lon, 1)) <= 180 AND id % 97 <> 0 AND (round(lat, 2) <> 0 OR round(lon, 1) <> 0) AS ok FROM c),
g AS (SELECT id, CASE WHEN ok THEN ta::DOUBLE END AS lat, CASE WHEN ok THEN to_::DOUBLE END AS lon, CASE WHEN id % 97 = 0 THEN 0 ELSE least(len(rtrim(split_part(ta, '.', 2), '0')), len(rtrim(split_part(to_, '.', 2), '0'))) END AS places FROM f),
h AS (SELECT *, least(greatest(lat, 41), 51.5) AS ya, least(greatest(lon, -5.5), 10) AS xa FROM g)
SELECT id, lat, lon, lat IS NOT NULL AS from_text, lat IS NOT NULL AS from_json, places::INT AS places, (lat BETWEEN 41 AND 51.5 AND lon BETWEEN -5.5 AND 10) OR (lat BETWEEN 14.2 AND 18.2 AND lon BETWEEN -63.2 AND -60.7) OR (lat BETWEEN 1.8 AND 6 AND lon BETWEEN -55 AND -51.5) OR (lat BETWEEN -21.5 AND -20.8 AND lon BETWEEN 55 AND 56)
OR (lat BETWEEN -13.1 AND -12.5 AND lon BETWEEN 44.9 AND 45.4) OR (lat BETWEEN 46.7 AND 47.2 AND lon BETWEEN -56.5 AND -56) OR (lat BETWEEN -23 AND -19.5 AND lon BETWEEN 163.5 AND 168.2) OR (lat BETWEEN -28 AND -7 AND lon BETWEEN -155 AND -134) OR (lat BETWEEN -14.5 AND -13 AND lon BETWEEN -178.5 AND -176) AS inside,
round(2 * 6371 * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(ya - lat) / 2), 2) + cos(radians(lat)) * cos(radians(ya)) * pow(sin(radians(xa - lon) / 2), 2)))), 0) AS km_to_box FROM h""",
    "tag_selectors": f"""WITH {_OBJECTS}, {_WIDE} SELECT key, coalesce(shop IN ('bakery', 'deli'), false) OR amenity IS NOT NULL OR website IS NOT NULL AS asked, coalesce(shop IN ('bakery', 'pastry'), false) AS derived, shop IS NOT NULL AND amenity IS NULL AS not_fuel,
coalesce(shop IN ('bakery', 'pastry'), false) AS kin, building IS NOT NULL AND shop IS NULL AND amenity IS NULL AS shell FROM o""",
    "became_other": f"WITH {_OBJECTS}, {_WIDE}, y AS (SELECT key, {_WHY} AS why FROM o) SELECT key, why FROM y WHERE why IS NOT NULL",
    "ids_rule_out": f"""WITH {_OBJECTS}, {_WIDE} SELECT key, CASE WHEN ref_x IS NULL THEN '' ELSE 'A' || key || ';B' || (key % 5) END AS ids, ref_x IS NOT NULL AND key % 5 <> key % 7 AND 'A' || key <> 'B' || (key % 7) AS out, ref_x IS NOT NULL AS others FROM o""",
    "reviewer_context": f"""WITH {_OBJECTS}, {_WIDE}, s AS (SELECT key, list('' || k || '=' || v ORDER BY CASE k WHEN 'name' THEN 0 WHEN 'shop' THEN 1 WHEN 'amenity' THEN 2 WHEN 'website' THEN 3 ELSE 4 END, k)
  FILTER (WHERE k IN ('name', 'amenity', 'website', 'addr:city', 'contact:street') OR (k = 'shop' AND true)) AS c, count(*) FILTER (WHERE k NOT IN ('operator', 'disused:shop', 'shop')) AS kept FROM t WHERE NOT (k = 'shop') GROUP BY key)
SELECT o.key, coalesce(s.kept, 0)::INT AS n_unchanged, coalesce(array_to_string(s.c[1:6], ', '), '') AS context, CASE WHEN survey_date IS NOT NULL THEN '05-2024' END AS survey,
array_to_string(list_filter([CASE WHEN shop = 'deli' THEN 'shop=deli is deprecated: write shop=delicatessen instead' END, CASE WHEN old_ref IS NOT NULL THEN 'old_ref=' || old_ref || ' is deprecated: write ref=' || old_ref || ' instead' END], lambda x: x IS NOT NULL), chr(10)) AS deprecated FROM o LEFT JOIN s ON o.key = s.key""",
    "update_plan": f"WITH {_PLAN} SELECT key, k, op, v, was, pair FROM ops",
    "plan_effects": f"""WITH {_PLAN}, e AS (SELECT key, count(*) FILTER (WHERE op = 'add') AS added, count(*) FILTER (WHERE op = 'del') AS gone FROM ops GROUP BY key)
SELECT o.key, o.n::INT AS before, (o.n + e.added - e.gone)::INT AS after, true AS changes, 0::BIGINT AS left FROM o JOIN e ON o.key = e.key""",
    "left_out": """WITH p AS (SELECT p_partkey AS key, p_partkey % 300 AS days FROM part), o AS (SELECT key, days, unnest(['name', 'shop', 'phone', 'addr:city', 'start_date', 'ref:x', 'ref:org', 'building', 'capacity', 'socket:type2:output']) AS k FROM p),
r AS (SELECT key, k, CASE WHEN k = 'capacity' AND key % 10 < 4 OR k = 'socket:type2:output' AND key % 10 = 3 THEN 'counts' WHEN key % 8 = 0 AND k <> 'ref:x' THEN 'far' WHEN key % 4 = 0 AND k IN ('phone', 'addr:city', 'start_date', 'ref:org') THEN 'far' WHEN key % 7 = 0 AND k IN ('name', 'building') THEN 'grounds' WHEN key % 5 = 0 AND k IN ('shop', 'start_date') THEN 'no longer the place'
WHEN key % 6 = 0 AND k = 'start_date' THEN 'shared' WHEN k = 'start_date' AND key % 2 = 1 AND (key % 3 = 0 OR days > 100) THEN 'mapped before' WHEN key % 9 = 0 AND k IN ('ref:x', 'phone') THEN 'disputed' END AS reason FROM o) SELECT key, k, reason FROM r WHERE reason IS NOT NULL""",
    "overwritten": f"""WITH {_PLAN} SELECT ops.key, k, 'OSM has ' || k || '=' || was || ' where the source says ' || v || CASE WHEN o.survey_date IS NOT NULL THEN ', and a mapper checked this object on 05-2024' ELSE '; a mapper may have set it on purpose' END AS warning
FROM ops LEFT JOIN o ON o.key = ops.key WHERE op = 'mod' AND k IN ('shop', 'contact:email')""",
    "closure_plan": f"""WITH {_OBJECTS}, {_WIDE}, m AS (SELECT *, CASE WHEN key % 10 = 0 THEN 'amenity' WHEN amenity IS NOT NULL THEN 'amenity' WHEN shop IS NOT NULL THEN 'shop' END AS main FROM o WHERE key % 10 < 4),
z AS (SELECT *, CASE main WHEN 'amenity' THEN amenity WHEN 'shop' THEN shop END AS value FROM m)
SELECT key, 'disused:' || main AS k, 'mod' AS op, value AS v, main || '=' || value AS was FROM z WHERE value IS NOT NULL UNION ALL SELECT key, 'opening_hours', 'del', opening_hours, NULL FROM z WHERE value IS NOT NULL AND opening_hours IS NOT NULL UNION ALL SELECT key, 'phone', 'del', phone, NULL FROM z WHERE value IS NOT NULL AND phone IS NOT NULL
UNION ALL SELECT p_partkey, unnest(['name', 'shop', 'phone', 'website', 'email', 'opening_hours', 'operator', 'socket:type2', 'addr:street', 'addr:city']), 'add', unnest([upper(p_name), 'bakery', '05 61 23 45 67', 'https://y.org', 'b@x.org', '24/7', 'New', '4', 'rue haute', CASE WHEN p_partkey % 8 = 1 THEN 'Autre' ELSE 'Ville' END]), NULL FROM part WHERE p_partkey % 50 = 7""",
    "contradicted": f"""WITH {_PLAN}, w AS (SELECT key AS record, key % 40 AS element, k, op, v, pair, CASE WHEN k LIKE 'addr:%' THEN 'addr' END AS grp, CASE WHEN k IN ('name', 'operator', 'addr:street', 'addr:city') THEN trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) ELSE v END AS f FROM ops),
d AS (SELECT x.record, x.k, x.grp FROM w x WHERE x.op <> 'del' AND EXISTS (SELECT 1 FROM w y WHERE y.op <> 'del' AND y.element = x.element AND y.record <> x.record AND y.k = x.k AND y.f <> x.f))
SELECT record, k, op FROM w WHERE (op <> 'del' AND (record, k) IN (SELECT record, k FROM d)) OR (grp IS NOT NULL AND (record, grp) IN (SELECT record, grp FROM d WHERE grp IS NOT NULL)) OR (pair IS NOT NULL AND (record, pair) IN (SELECT record, k FROM d))""",
}
