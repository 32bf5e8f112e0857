"""Registers' ids, companies, mailboxes and declarations over the given tables, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hours
from ..functions import registers as reg
from ..operators import declare
from ..steps import spread, tasks, worked_once


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n, *cases):
    return F.element_at(F.array(*cases), (n % len(cases) + 1).cast("int"))


def point_ids(spark, sf_dir):
    """Ids of charging points as they compare, pools' ids as they are written, and keys by which stations agree."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    t = F.lpad(F.col("id").cast("string"), 7, "0")
    raw = _pick(F.col("id"), F.concat(F.lit("fr*abc*e"), t, F.lit("p1")), F.concat(F.lit("FRABCP"), t), F.concat(F.lit("FR*ABC*PSITE"), t, F.lit(" *2")), F.concat(F.lit("own "), t))
    keys = reg.evse_keys(raw)
    other = F.array(F.concat(F.lit("FRXYZ"), t), F.concat(F.lit("~SITE"), t, F.lit("2")), F.concat(F.lit("FRABC"), t, F.lit("9")))
    return c.select("id", reg.evse_id(raw).alias("point"), reg.evse_tail(reg.evse_id(raw)).alias("tail"), reg.pool_id(raw).alias("pool"), F.array_join(keys, ",").alias("keys"), reg.related_keys(keys, other).alias("related"))


def register_sites(spark, sf_dir):
    """Companies without trade words, and the keys of stations that have no id."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    t = F.col("id").cast("string")
    name = _pick(F.col("id"), F.concat(F.lit("ZEENCO"), t, F.lit(" e-mobility SAS")), F.lit("France Services"), F.concat(F.lit("Éole "), t))
    lat, lon = F.concat(F.lit("4"), (F.col("id") % 10).cast("string"), F.lit(".5")), F.when(F.col("id") % 4 == 0, "x").otherwise("2.25")
    ident = F.when(F.col("id") % 2 == 0, "Non concerné").otherwise(F.concat(F.lit(" S"), t))
    return c.select("id", reg.register_company(name).alias("company"), reg.station_key(ident, lat, lon, name).alias("station"))


def private_mailboxes(spark, sf_dir):
    """Mailboxes that read as somebody's own."""
    c = spread(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")
    cases = ("jeanne.martin@ac-lyon.fr", "direction.nord@ac-lyon.fr", "secretariat@gmail.com", "fatemi60@gmail.com", "neyret@wanadoo.fr", "maubert@ecole.fr", "campus.toulouse@x.org", "lyceepro@x.org", "not a mailbox", "j.neyret@ecole.org", "martin@martin.fr")
    rows = c.select("id", F.posexplode(F.array(*[F.lit(m) for m in cases])).alias("case", "mail"))
    held = reg.withheld_mailbox(F.col("mail"), F.concat(F.lit("Ecole "), F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, "Rue Neyret").otherwise("Rue Haute"))
    return rows.groupBy("case").agg(F.count_if(held).alias("withheld"), F.count(F.lit(1)).alias("n"))


def point_declarations(spark, sf_dir):
    """How many declarations each row's point has, and the newest of them."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.concat(F.lit("FR*AAA*E"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"))
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    one = l.groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").cast("string").alias("day"))
    declared = one.select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("declaration"), "day", F.when(F.col("l_suppkey") % 3 == 0, "Qualicharge").otherwise("own").alias("publisher"),
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "FRAAA").otherwise("FRBBB"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("id"),
    )
    both = declare.declarations_of(rows, declared).join(declared, "declaration")
    newest = F.max(F.struct(declare.newest_first(F.substring("day", 1, 7), F.col("publisher"), F.col("day")).alias("o"), "declaration")).alias("m")
    return both.groupBy("row").agg(F.count(F.lit(1)).alias("n"), newest).select("row", "n", F.col("m.declaration").alias("newest"))


def dataset_files(spark, sf_dir):
    """The main file of each dataset: nations' suppliers as resources."""
    s = _read(spark, sf_dir, "supplier")
    rows = s.select(
        F.col("s_nationkey").alias("dataset"), F.when(F.col("s_suppkey") % 11 != 0, F.concat(F.lit("u"), F.col("s_suppkey").cast("string"))).alias("url"), _pick(F.col("s_suppkey"), F.lit("CSV"), F.lit("csv"), F.lit("json")).alias("format"),
        F.when(F.col("s_suppkey") % 7 == 0, "documentation").alias("type"), _pick(F.col("s_suppkey"), F.lit("Consolidé"), F.lit("export"), F.lit("IRVE dynamique"), F.lit(None).cast("string"), F.lit("consolidation")).alias("title"), (F.col("s_suppkey") * 37 % 100).cast("string").alias("modified"),
    )
    return declare.main_files(rows).select("dataset", "url")


def vetted(spark, sf_dir):
    """Tags that a model read from pages, after the tests: orders' comments stand for pages by rule."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).repartition(tasks(spark), "page")
    t = F.col("page").cast("string")
    text = F.concat(F.lit("Bakery  Number "), t, F.lit(", call 05 61 23 45 67\nor mail a@b.org; www.bread"), t, F.lit(".org Open"))
    tag = lambda i, k, v, conf, q: F.struct(F.lit(i).alias("position"), F.lit(k).alias("k"), v.alias("v"), F.lit(conf).alias("conf"), q.alias("quote"))
    tags = F.array(
        tag(0, "name", F.concat(F.lit("bakery number "), t), 1.0, F.concat(F.lit("BAKERY Number "), t)), tag(1, "phone", F.lit("+33 5 61 23 45 67"), 0.8, F.lit("call 05 61 23 45 67")), tag(2, "phone", F.lit("05 00 00 00 00"), 0.8, F.lit("call 05 61 23 45 67")),
        tag(3, "website", F.concat(F.lit("https://www.bread"), t, F.lit(".org/")), 0.7, F.concat(F.lit("www.bread"), t, F.lit(".org"))), tag(4, "website", F.lit("b.org"), 0.7, F.lit("mail a@b.org")), tag(5, "Bad Key", F.lit("x"), 0.9, F.lit("Open")),
        tag(6, "opening", F.lit("yes"), 0.3, F.lit("Open")), tag(7, "opening", F.lit("maybe"), 0.6, F.lit("nowhere")), tag(8, "opening", F.when(F.col("page") % 2 == 0, "").otherwise("no"), 0.6, F.lit("open")), tag(9, "email", F.lit("a@b.org"), 0.6, F.lit("mail a@b.org;")), tag(10, "secret", F.lit("x"), 0.9, F.lit("Open")),
        tag(11, "opened", F.lit("late"), 0.496, F.lit("Open")), tag(12, "opening_hours", F.lit("at noon"), 0.9, F.lit("Open")), tag(13, "opening_hours", F.concat(F.lit("Mo 08:00-1"), (F.col("page") % 3).cast("string"), F.lit(":00, Tu 08:00-11:00")), 0.555, F.lit("Open")),
    )
    said = o.select("page", text.alias("text"), F.explode(tags).alias("s")).select("page", "text", "s.*")
    return declare.vetted_tags(said, ["name", "phone", "website", "open*", "email"], 0.5)


def _week_texts(spark, sf_dir):
    """Hours of customers by rule: days one by one, the same as a range, a day said twice, nights, what is no week."""
    n = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    opens, close = two(6 + n % 5), two(15 + n % 9)
    span = F.concat(opens, F.lit(":00-"), close, F.lit(":30"))
    days = F.transform(F.sequence(F.lit(1), F.lit(3) + (n % 5).cast("int")), lambda i: F.concat(F.element_at(F.array(*[F.lit(d) for d in hours.DAYS]), i), F.lit(" "), span))
    one_by_one = F.array_join(days, ", ")
    ranged = F.concat(F.lit("Mo-"), F.element_at(F.array(*[F.lit(d) for d in hours.DAYS]), F.lit(3) + (n % 5).cast("int")), F.lit(" "), span)
    night = F.concat(F.lit("Sa-Mo 22:00-0"), (n % 4).cast("string"), F.lit(":00; Su off"))
    twice = F.concat(F.lit("Mo-Sa "), opens, F.lit(":00-12:00;Mo-Sa 13:00-"), close, F.lit(":30"))
    return _read(spark, sf_dir, "customer").select(n.alias("id"), one_by_one.alias("listed"), ranged.alias("ranged"), night.alias("night"), twice.alias("twice"), F.concat(F.lit("Mo "), span, F.lit("; sunset")).alias("other"))


def opening_weeks(spark, sf_dir):
    """Opening hours folded, compared minute by minute, counted, and held against a moment; what is no week is none."""
    c = F.col
    read = {"week": hours.week_intervals(c("ranged")), "nights": hours.week_intervals(c("night")), "folded": hours.fold_days(c("listed")), "merged": hours.register_hours(c("twice")), "kept": hours.fold_days(c("twice")), "same": hours.same_hours(c("listed"), c("ranged")), "alike": hours.same_hours(c("ranged"), c("night")), "other_read": hours.valid_hours(c("other"))}
    t = worked_once(_week_texts(spark, sf_dir), ["listed", "ranged", "night", "twice", "other"], read)
    return t.select(
        "id", "folded", "merged", "kept", "same", "alike", hours.minutes_open(c("week")).alias("minutes"), hours.minutes_open(c("nights")).alias("night_minutes"),
        hours.open_at(c("nights"), (6 * hours.DAY_MIN + c("id") % 240).cast("int")).alias("at_night"), hours.overlap(c("week"), c("nights")).alias("meet"), c("other_read").alias("other"),
    )


def queries():
    names = (point_ids, register_sites, private_mailboxes, point_declarations, dataset_files, vetted, opening_weeks)
    return {f.__name__: f for f in names}


SQL = {
    "point_ids": """WITH c AS (SELECT c_custkey AS id, lpad(c_custkey::VARCHAR, 7, '0') AS t FROM customer)
SELECT id, CASE id % 4 WHEN 0 THEN 'FRABC' || t || '1' WHEN 1 THEN 'FRABC' || t WHEN 2 THEN 'FRABCSITE' || t || '2' ELSE 'OWN' || t END AS point, CASE id % 4 WHEN 0 THEN t || '1' WHEN 1 THEN t WHEN 2 THEN t || '2' ELSE t END AS tail,
CASE id % 4 WHEN 1 THEN 'FR*ABC*P' || t WHEN 2 THEN 'FR*ABC*PSITE' || t || '*2' END AS pool, CASE id % 4 WHEN 0 THEN 'FRABC' || t || 'P1,~' || t || 'P1,FRABC' || t WHEN 1 THEN 'FRABC' || t WHEN 2 THEN 'FRABCSITE' || t || '2,~SITE' || t || '2' ELSE 'OWN' || t END AS keys, id % 4 <> 3 AS related FROM c""",
    "register_sites": """WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'zeenco' || c_custkey WHEN 1 THEN 'france services' ELSE 'eole ' || c_custkey END AS company FROM customer)
SELECT id, company, CASE WHEN id % 2 = 1 THEN 'S' || id WHEN id % 4 <> 0 THEN 'Non concerné 4' || (id % 10) || '.500000,2.250000|' || company END AS station FROM c""",
    "private_mailboxes": """WITH k AS (SELECT unnest(range(11))::INT AS "case"), c AS (SELECT c_custkey AS id FROM customer)
SELECT "case", count(*) FILTER (WHERE "case" IN (0, 3, 5) OR ("case" IN (4, 9) AND id % 2 = 1)) AS withheld, count(*) AS n FROM k, c GROUP BY 1""",
    "point_declarations": """WITH d AS (SELECT l_partkey AS row, l_partkey || '-' || l_suppkey AS declaration, max(l_shipdate)::VARCHAR AS day, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT p_partkey AS row, count(*) AS n, max(struct_pack(a := day[1:7], b := CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END, c := day, d := declaration)).d AS newest FROM part JOIN d ON d.row = p_partkey GROUP BY 1""",
    "dataset_files": """WITH r AS (SELECT s_nationkey AS dataset, 'u' || s_suppkey AS url, s_suppkey AS s FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 3 <> 2 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 2)
SELECT dataset, url FROM r QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY (s % 5 IN (0, 4))::INT DESC, (s * 37 % 100)::VARCHAR DESC, url) = 1""",
    "vetted": """WITH o AS (SELECT o_orderkey AS page FROM orders) SELECT page, 0 AS position, 'name' AS k, 'bakery number ' || page AS v, 0.9::DOUBLE AS conf FROM o UNION ALL SELECT page, 1, 'phone', '+33 5 61 23 45 67', 0.8 FROM o UNION ALL SELECT page, 3, 'website', 'https://www.bread' || page || '.org/', 0.7 FROM o
UNION ALL SELECT page, 8, 'opening', 'no', 0.6 FROM o WHERE page % 2 = 1 UNION ALL SELECT page, 9, 'email', 'a@b.org', 0.6 FROM o
UNION ALL SELECT page, 13, 'opening_hours', CASE WHEN page % 3 = 1 THEN 'Mo-Tu 08:00-11:00' ELSE 'Mo 08:00-1' || (page % 3) || ':00; Tu 08:00-11:00' END, 0.56 FROM o""",
    "opening_weeks": """WITH c AS (SELECT c_custkey AS id, lpad((6 + c_custkey % 5)::VARCHAR, 2, '0') AS o, lpad((15 + c_custkey % 9)::VARCHAR, 2, '0') AS e, 3 + c_custkey % 5 AS n, 60 * (15 + c_custkey % 9) + 30 - 60 * (6 + c_custkey % 5) AS m, 60 * (c_custkey % 4) AS late FROM customer)
SELECT id, 'Mo-' || ['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su'][n] || ' ' || o || ':00-' || e || ':30' AS folded, 'Mo-Sa ' || o || ':00-12:00,13:00-' || e || ':30' AS merged, 'Mo-Sa ' || o || ':00-12:00;Mo-Sa 13:00-' || e || ':30' AS kept, true AS same, false AS alike,
  (n * m)::INT AS minutes, (2 * (120 + late))::INT AS night_minutes, (id % 240) < late AS at_night, e >= '22' AS meet, NULL::VARCHAR AS other FROM c""",
}
