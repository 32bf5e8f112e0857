"""The library's operators over the given tables, each with the SQL that it must agree with.

Records are the parts with odd keys, elements those with even keys, placed by a rule (see PLACED); candidates are orders,
tags line items, runs and sign-in attempts events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import distance, in_circle
from ..functions.text import allowed_by, dice, host, id_keys, name_score, name_tokens, normalise_name
from ..operators import around, diff, evidence, link, review, rollup, store
from ..sources import pages, registry
from ..steps import shared_folder
from ..streaming import attempts
from . import rules

CENTRE, RADIUS = (43.51, 1.31), 700.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    lat, lon = (7919, 104729) if odd else (6151, 86243)
    part, half = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == int(odd)), F.floor(F.col("p_partkey") / 2)
    return part.select(
        F.col("p_partkey").alias("key"), (F.lit(43.5) + (F.col("p_partkey") * lat % 2000) / F.lit(100000.0)).alias("lat"), (F.lit(1.3) + (F.col("p_partkey") * lon % 2000) / F.lit(100000.0)).alias("lon"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("operator"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.when(half % 3 == 0, F.concat(F.lit("fr*abc *p"), half.cast("string"))).when(half % 3 == 1, F.concat(F.lit("FR*abcQ"), F.floor(half / 20).cast("string"))).alias("refs"),
    )


_PLACED = """part2 AS (SELECT p_partkey AS key, 43.5::DOUBLE + (p_partkey * (CASE WHEN p_partkey % 2 = 1 THEN 7919 ELSE 6151 END) % 2000) / 100000.0::DOUBLE AS lat,
  1.3::DOUBLE + (p_partkey * (CASE WHEN p_partkey % 2 = 1 THEN 104729 ELSE 86243 END) % 2000) / 100000.0::DOUBLE AS lon, p_name AS name, p_brand AS operator, p_type AS type, p_size AS size,
  CASE (p_partkey // 2) % 3 WHEN 0 THEN 'FRABCP' || (p_partkey // 2) WHEN 1 THEN 'FRABCQ' || (p_partkey // 2 // 20) END AS ref,
  list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'le', 'la', 'les', 'l', 'de', 'du', 'des', 'd', 'et', 'the', 'of', 'au', 'aux'))) AS toks,
  regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS comp,
  list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS ctoks FROM part),
r AS (SELECT * FROM part2 WHERE key % 2 = 1), e AS (SELECT * FROM part2 WHERE key % 2 = 0)"""


def _metres(a: str, b: str) -> str:
    return f"2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def _dice(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})))"


_WHO = f"CASE WHEN p.comp = q.comp OR (least(len(p.comp), len(q.comp)) >= 4 AND (contains(p.comp, q.comp) OR contains(q.comp, p.comp))) THEN 1.0::DOUBLE ELSE {_dice('p.ctoks', 'q.ctoks')} END"
_SPATIAL = f"""near AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d, {_dice('p.toks', 'q.toks')} AS named, {_WHO} AS who FROM r p JOIN e q ON abs(p.lat - q.lat) < 0.002),
fit AS (SELECT *, named - d / 1000 - CASE WHEN who < 0.5 THEN 0.3::DOUBLE ELSE 0 END AS score FROM near WHERE d <= CASE WHEN named >= 0.6 THEN 150 ELSE 50 END AND named >= 0.5),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, element) = 1)"""
_REFS = f"""hits AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d FROM r p JOIN e q ON p.ref = q.ref
  WHERE p.ref NOT IN (SELECT ref FROM r WHERE ref IS NOT NULL GROUP BY ref HAVING count(*) > 1)),
byref AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, element) = 1)"""


def area_cut_haversine(spark, sf_dir):
    """Records in a circle, with their distance from its centre."""
    rows = placed(spark, sf_dir, True).filter(in_circle(F.col("lat"), F.col("lon"), CENTRE, RADIUS))
    return rows.select("key", F.round(distance(F.col("lat"), F.col("lon"), F.lit(CENTRE[0]), F.lit(CENTRE[1])), 1).alias("metres"))


def registry_group_rows(spark, sf_dir):
    """Line items as records by order, their rows in order."""
    rows = registry.group_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "n", F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("parts"))


def allow_prefix_floor(spark, sf_dir):
    """Tags that the allow list and the floor of confidence let through."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_returnflag", "l_linestatus").alias("k"), (F.lit(1) - F.col("l_discount")).alias("conf"))
    rows = rows.filter(allowed_by(["A:*", "N:O"], F.col("k")) & (F.col("conf") >= 0.935))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_records"))


def ref_equi_match(spark, sf_dir):
    """Records matched by ids that no other record has."""
    return link.ref_matches(placed(spark, sf_dir, True), placed(spark, sf_dir, False)).select("key", "element", F.round("d", 1).alias("metres"))


def spatial_nearest_match(spark, sf_dir):
    """Records matched by distance and names."""
    found = link.spatial_matches(placed(spark, sf_dir, True), placed(spark, sf_dir, False))
    return found.select("key", "element", F.round("d", 1).alias("metres"), F.round("score", 4).alias("score"))


def yield_to_best_fit(spark, sf_dir):
    """All matches after records on one object have yielded to ids and to the best fit."""
    found = link.settle(link.matches(placed(spark, sf_dir, True), placed(spark, sf_dir, False)))
    return found.select("key", "element", "by_id", F.round("d", 1).alias("metres"))


def knn_labels(spark, sf_dir):
    """The three nearest labels of each record."""
    return link.nearby_labels(placed(spark, sf_dir, True), placed(spark, sf_dir, False)).select("key", "position", "element", "label", F.round("d", 1).alias("metres"))


def twin_pairs(spark, sf_dir):
    """Records that look like one place, both ways."""
    return link.twins_one_by_one(placed(spark, sf_dir, True)).select("key", "other", "reason")


def site_components(spark, sf_dir):
    """Parts that share a brand and size, or a type and size in small sizes, through others too."""
    part = table(spark, sf_dir, "part")
    brand = part.select(F.col("p_partkey").alias("key"), F.concat_ws("|", "p_brand", "p_size").alias("id"))
    kind = part.filter("p_size <= 3").select(F.col("p_partkey").alias("key"), F.concat_ws("|", "p_type", "p_size").alias("id"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return link.merge_sites(brand.unionByName(kind))


def _tags(rows: DataFrame, key: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in ("name", "operator", "type", "size")])
    return rows.select(F.col(key).alias("key"), F.explode(pairs).alias("t")).select("key", "t.*")


def map_diff_ops(spark, sf_dir):
    """What the records would write on the elements with the next even key."""
    ours = _tags(placed(spark, sf_dir, True).withColumn("at", F.col("key") + 1), "at").withColumn("add_only", F.col("k") == "size")
    held = _tags(placed(spark, sf_dir, False), "key").filter((F.col("k") != "type") | (F.col("key") % 3 != 0))
    return diff.update_ops(ours, held)


def address_all_or_nothing(spark, sf_dir):
    """Address parts of records on elements that hold some of them."""
    ours = _tags(placed(spark, sf_dir, True).withColumn("at", F.col("key") + 1), "at").filter("k in ('name', 'type')")
    held = _tags(placed(spark, sf_dir, False), "key").filter((F.col("k") == "name") & (F.col("key") % 4 == 0))
    return diff.address_ops(ours, held)


def disputed_keys(spark, sf_dir):
    """Parts on which line items disagree about a key."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element"), F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("v"))
    return diff.disputed(rows)


def record_blocks(spark, sf_dir):
    """Which columns of an order's line items are one value."""
    return diff.record_blocks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_suppkey"), "l_orderkey", ["l_returnflag", "l_linestatus", "l_suppkey"])


def _candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("type"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("conf"), "o_custkey", "o_orderdate")


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority in ('1-URGENT', '2-HIGH')")
    return o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "1-URGENT", "accepted").otherwise("rejected").alias("kind"), F.col("o_orderdate").alias("decided_at"))


def queue_page(spark, sf_dir):
    """The second page of a queue: undecided candidates of one type, surest first."""
    page = review.queue_page(_candidates(spark, sf_dir), _decisions(spark, sf_dir), 2, [F.desc("conf"), F.asc("key")], kind="O", low=0.2)
    return page.select("key", "rank", F.round("conf", 4).alias("conf"))


def area_tallies(spark, sf_dir):
    """Tallies of candidates and decisions by nation."""
    c = _candidates(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return review.tallies(c, _decisions(spark, sf_dir), "c_nationkey", F.lit("1998-01-01").cast("timestamp"))


def source_yields(spark, sf_dir):
    """Tags per source (nation) and how many of them no evidence (a discount) stands behind."""
    tags = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    out = tags.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_tags"), F.count_if(F.col("l_discount") == 0).alias("unevidenced"), F.count_distinct("l_orderkey").alias("n_records"))
    return out.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")


def staged_batches(spark, sf_dir):
    """Staged orders by customer, in batches of fifty objects of a nation."""
    c = _candidates(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return review.batches(c.select("c_nationkey", F.col("o_custkey").alias("element"), F.col("key").alias("position")), "c_nationkey")


def runs_hold(spark, sf_dir):
    """Each source's last run, and whether it is on hold after three failures."""
    e = table(spark, sf_dir, "events")
    return review.run_state(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("started"), F.when(F.col("value") < 60, "failed").otherwise("ok").alias("result")))


def lockout_sessions(spark, sf_dir):
    """Sign-in attempts in islands parted by a quarter of an hour."""
    out = attempts.attempt_islands(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"))
    return out.select("user_id", "island", "n", "locked", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def snapshot_merge(spark, sf_dir):
    """Two snapshots of orders merged: kept, same, changed, added and vanished candidates."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("seen"))
    old, new = o.filter("key % 5 <> 0"), o.filter("key % 7 <> 0").withColumn("hash", F.when(F.col("key") % 3 == 0, "changed").otherwise(F.col("hash")))
    return store.merge_snapshot(old, new, _decisions(spark, sf_dir)).groupBy("state", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


def sweep_vanished(spark, sf_dir):
    """Candidates left after the sweep of what a run has not seen."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("hash"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("seen"))
    return store.sweep_vanished(o, _decisions(spark, sf_dir), F.lit("1997-06-01").cast("timestamp")).select("key")


def conflict_refresh(spark, sf_dir):
    """Undecided candidates whose object has a later version."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") + 1).alias("element"), F.lit(3).alias("version"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(5)).alias("base_version"))
    elements = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("element"), (F.col("c_custkey") % 7).cast("int").alias("version"))
    return store.conflicts(c, elements, _decisions(spark, sf_dir))


def newest_declaration(spark, sf_dir):
    """The newest line item of each part, with a price from the newest that states one."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("stated"))
    out = rollup.newest(rows, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], ["stated"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "stated")


def socket_rollup(spark, sf_dir):
    """Line items of an order rolled up: counts by kind, the greatest size, one value or none, joined ids, a first date."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "N").alias("n_n"), F.max("l_quantity").alias("most"), rollup.only_value(F.col("l_linestatus")).alias("status"),
        F.every(F.col("l_discount") > 0).alias("all_reduced"), rollup.joined_ids(F.col("l_suppkey").cast("string"), 20).alias("suppliers"),
        F.min(F.when(~((F.month("l_shipdate") == 1) & (F.dayofmonth("l_shipdate") == 1)), F.to_date("l_shipdate"))).cast("string").alias("first_date"),
    )


def name_similarity_dice(spark, sf_dir):
    """Names of parts next to each other by key, normalised and compared."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name")), "p_partkey")
    return both.select("p_partkey", normalise_name(F.col("p_name")).alias("name"), F.round(dice(name_tokens(F.col("p_name")), name_tokens(F.col("next_name"))), 6).alias("likeness"))


def page_hosts(spark, sf_dir):
    """Pages and links by host."""
    return table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


def page_links(spark, sf_dir):
    """Distinct links of every page."""
    return pages.page_links(table(spark, sf_dir, "pages"))


def html_text(spark, sf_dir):
    """Visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", pages.html_text(F.col("html")).alias("text"))


def quote_evidence(spark, sf_dir):
    """Passages that stand in documents: which, where, and up to 20 characters before them (`evidence.quote_hits` gives both sides)."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = evidence.quote_hits(table(spark, sf_dir, "documents"), quotes)
    return hits.select("doc_id", "item_id", "at", F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - 20).cast("int"), F.least(F.lit(20), F.col("at") - 1).cast("int")).alias("before"))


def stale_flags(spark, sf_dir):
    """Days since each order by a given day, and whether they are sixty or more."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))
    return o.withColumn("stale", F.col("days") >= 60)


def change_xml(spark, sf_dir):
    """Upload blocks of the elements' tags."""
    return review.change_xml(_tags(placed(spark, sf_dir, False), "key").groupBy(F.col("key").alias("element")).agg(F.collect_list(F.struct("k", "v")).alias("tags")))


def rules_eval(spark, sf_dir):
    """Line items through a mapping of declared inputs, values, a skip rule and tag rules."""
    return rules.EXAMPLE.evaluate(table(spark, sf_dir, "lineitem"))


def record_rules(spark, sf_dir):
    """Orders as records of several rows through a mapping that reads them all."""
    return rules.ORDERS.evaluate(table(spark, sf_dir, "lineitem"))


def _sided(spark, sf_dir, odd):
    return placed(spark, sf_dir, odd).select("key", "lat", "lon", "name", "operator", (F.col("size") % 5).alias("kind"), id_keys(F.col("refs")).alias("ids"))


def likely_duplicates(spark, sf_dir):
    """The nearest element of a record's kind that may be the same place."""
    return around.duplicates(_sided(spark, sf_dir, True), _sided(spark, sf_dir, False)).select("key", "element", F.round("d", 1).alias("metres"))


def far_namesakes(spark, sf_dir):
    """The nearest record of the same brand and size farther off, by the name made of both."""
    rows = _sided(spark, sf_dir, True).withColumn("name", F.concat_ws(" ", "operator", F.col("kind").cast("string")))
    others = _sided(spark, sf_dir, False).withColumn("name", F.concat_ws("-", F.upper("operator"), F.col("kind").cast("string")))
    return around.namesakes(rows, others).select("key", "element", F.round("d", 1).alias("metres"))


def _close(spark, sf_dir, odd):
    """Records or elements of `_sided` eight times closer, with ids of two kinds, access, addresses and contacts by rule."""
    k = F.col("key")
    rows = _sided(spark, sf_dir, odd).withColumns({"lat": 43.5 + (F.col("lat") - 43.5) / 8, "lon": 1.3 + (F.col("lon") - 1.3) / 8})
    soft = F.when(k % 5 < 2, F.array(F.concat(F.lit("S"), F.floor(k / 6).cast("string")))).otherwise(F.array().cast("array<string>"))
    more = {"soft_ids": soft, "access": F.when(k % 7 < 2, "private").when(k % 7 < 5, "yes"), "gone": k % 14 == 0, "address": F.when(k % 3 != 0, F.concat(F.lit("A"), (k % 60).cast("string"))), "contacts": F.array(F.concat(F.lit("P"), (k % 90).cast("string"))), "company": F.when(k % 2 == 1, k % 70).otherwise(k % 35)}
    return rows.withColumns(more if odd else more | {"name": F.when(k % 3 != 0, F.col("name"))})


def _matched(spark, sf_dir):
    return _sided(spark, sf_dir, False).filter("key % 4 = 0").select((F.col("key") - 1).alias("key"), F.col("key").alias("element"))


def one_site_parts(spark, sf_dir):
    """The other objects that a matched record's site is mapped as."""
    return around.site_parts(_matched(spark, sf_dir), _close(spark, sf_dir, True), _close(spark, sf_dir, False)).select("key", "other", F.round("d", 1).alias("metres"), "by_id")


def unlisted_kin(spark, sf_dir):
    """Elements of a record's kind close by whose ids the source does not have; some of the source's records have other ids by now."""
    return around.unlisted(_close(spark, sf_dir, True).withColumn("ids", F.when(F.col("key") % 8 < 5, F.col("ids")).otherwise(F.transform("ids", lambda i: F.concat(i, F.lit("X"))))), _close(spark, sf_dir, False))


def sister_places(spark, sf_dir):
    """The nearest element with other ids at the record's address, with its contacts or of its company."""
    return around.siblings(_close(spark, sf_dir, True), _close(spark, sf_dir, False), _matched(spark, sf_dir)).select("key", "element", F.round("d", 1).alias("metres"), "reason")


def twin_reasons(spark, sf_dir):
    """Why records may be one place with others, how many, and the least of these."""
    k = F.col("key")
    rows = placed(spark, sf_dir, True).withColumns({"hard": id_keys(F.col("refs")), "line": F.concat(F.lit("Rue "), (k % 40).cast("string")), "name": F.concat_ws(" ", F.lit("Éole"), (k % 3).cast("string")), "organisation": F.when(k % 3 == 0, (k % 50).cast("string")), "address": F.when(k % 4 == 1, F.concat_ws(";", k % 9, k % 11))})
    return link.twin_reasons(rows)


def matched_elsewhere(spark, sf_dir):
    """Elements that several records matched by id, with the first of them."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).distinct()
    return around.matched_by(found).filter("n > 1").select("element", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


def nearest_of_rows(spark, sf_dir):
    """The line items of an order whose quantity is within ten of the least, null where it is odd; a sample of them by flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("row"), F.when(F.col("l_quantity").cast("int") % 2 == 0, F.col("l_quantity").cast("double")).alias("gap"))
    return around.nearest_rows(rows, 10.0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"))


def sampled_orders(spark, sf_dir):
    """Twenty orders of each status, the same in every run."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return around.sample_per_group(rows, "status", "key", 20)


def name_scores(spark, sf_dir):
    """How well the names of parts next to each other fit, status words and brands apart."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", F.when(F.col("p_partkey") % 3 == 0, "public")).alias("name"), "p_brand")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("name")).alias("other")), "p_partkey")
    status = F.array(*[F.lit(w) for w in ("prive", "privee", "public", "publique")])
    return both.select("p_partkey", F.round(name_score(name_tokens(F.col("name")), name_tokens(F.col("other")), status, name_tokens(F.col("p_brand"))), 6).alias("score"))


def queries():
    names = (
        area_cut_haversine, registry_group_rows, allow_prefix_floor, ref_equi_match, spatial_nearest_match, yield_to_best_fit, knn_labels, twin_pairs, site_components, map_diff_ops,
        address_all_or_nothing, disputed_keys, record_blocks, queue_page, area_tallies, source_yields, staged_batches, runs_hold, lockout_sessions, snapshot_merge, sweep_vanished,
        conflict_refresh, newest_declaration, socket_rollup, name_similarity_dice, page_hosts, page_links, html_text, quote_evidence, stale_flags, change_xml, rules_eval, record_rules,
        likely_duplicates, far_namesakes, one_site_parts, unlisted_kin, sister_places, twin_reasons, matched_elsewhere, nearest_of_rows, sampled_orders, name_scores,
    )
    return {f.__name__: f for f in names}


_DECIDED = "dec AS (SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'accepted' ELSE 'rejected' END AS kind, o_orderdate AS decided_at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"
_TAGS = "tags AS (SELECT key, unnest(['name', 'operator', 'type', 'size']) AS k, unnest([name, operator, type, size::VARCHAR]) AS v FROM part2)"

#: Records and elements as `_close` places them, and who matched whom.
_CLOSE = """cp AS (SELECT key, 43.5::DOUBLE + (lat - 43.5) / 8 AS lat, 1.3::DOUBLE + (lon - 1.3) / 8 AS lon, toks, comp, ctoks, ref, size % 5 AS kind, CASE WHEN key % 5 < 2 THEN 'S' || (key // 6) END AS soft, CASE WHEN key % 7 < 2 THEN 'private' WHEN key % 7 < 5 THEN 'yes' END AS access, key % 14 = 0 AS gone,
  CASE WHEN key % 3 <> 0 THEN 'A' || (key % 60) END AS address, 'P' || (key % 90) AS contact, CASE WHEN key % 2 = 1 THEN key % 70 ELSE key % 35 END AS company FROM part2),
cr AS (SELECT * FROM cp WHERE key % 2 = 1), ce AS (SELECT * REPLACE (CASE WHEN key % 3 <> 0 THEN toks ELSE [] END AS toks) FROM cp WHERE key % 2 = 0)"""
_MATCHED = "m AS (SELECT key - 1 AS key, key AS element FROM part2 WHERE key % 4 = 0)"

#: White space as `evidence` collapses it.
_SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"

SQL = {
    "area_cut_haversine": f"WITH {_PLACED}, c AS (SELECT 43.51::DOUBLE AS lat, 1.31::DOUBLE AS lon), d AS (SELECT r.key, {_metres('r', 'c')} AS d FROM r, c) SELECT key, round(d, 1) AS metres FROM d WHERE d <= 700",
    "registry_group_rows": "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey",
    "allow_prefix_floor": "SELECT l_returnflag || ':' || l_linestatus AS k, count(*) AS n, count(DISTINCT l_orderkey) AS n_records FROM lineitem WHERE (l_returnflag = 'A' OR l_returnflag || l_linestatus = 'NO') AND 1 - l_discount >= 0.935 GROUP BY 1",
    "ref_equi_match": f"WITH {_PLACED}, {_REFS} SELECT key, element, round(d, 1) AS metres FROM byref",
    "spatial_nearest_match": f"WITH {_PLACED}, {_SPATIAL} SELECT key, element, round(d, 1) AS metres, round(score, 4) AS score FROM best",
    "yield_to_best_fit": f"""WITH {_PLACED}, {_REFS}, {_SPATIAL},
m AS (SELECT key, element, d, NULL::DOUBLE AS score, true AS by_id FROM byref UNION ALL SELECT key, element, d, score, false FROM best WHERE key NOT IN (SELECT key FROM byref)),
a AS (SELECT *, max(by_id::INT) OVER (PARTITION BY element) AS held, max(score) OVER (PARTITION BY element) AS top FROM m)
SELECT key, element, by_id, round(d, 1) AS metres FROM a WHERE by_id OR (held = 0 AND score >= top)""",
    "knn_labels": f"""WITH {_PLACED}, n AS (SELECT p.key, q.key AS element, q.name AS label, {_metres('p', 'q')} AS d FROM r p JOIN e q ON abs(p.lat - q.lat) < 0.004)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY d, element)::INT AS position, element, label, round(d, 1) AS metres FROM n WHERE d <= 300 QUALIFY position <= 3""",
    "twin_pairs": f"""WITH {_PLACED}, n AS (SELECT p.key, q.key AS other, {_metres('p', 'q')} AS d, {_dice('p.toks', 'q.toks')} AS named, {_WHO} AS who FROM r p JOIN r q ON p.key <> q.key AND abs(p.lat - q.lat) < 0.001)
SELECT key, other, CASE WHEN d <= 10 THEN 'place' ELSE 'alike' END AS reason FROM n WHERE d <= 10 OR (d <= 60 AND (named >= 0.5 OR who >= 0.5))""",
    "site_components": """WITH RECURSIVE l AS (SELECT p_partkey AS key, p_brand || '|' || p_size AS id FROM part UNION ALL SELECT p_partkey, p_type || '|' || p_size FROM part WHERE p_size <= 3),
n AS (SELECT DISTINCT a.id AS x, b.id AS y FROM l a JOIN l b ON a.key = b.key),
walk AS (SELECT id AS x, id AS y FROM l UNION SELECT w.x, n.y FROM walk w JOIN n ON w.y = n.x),
least_ AS (SELECT w.x AS id, min(l.key) AS site FROM walk w JOIN l ON w.y = l.id GROUP BY w.x)
SELECT l.key, min(least_.site) AS site FROM l JOIN least_ ON l.id = least_.id GROUP BY l.key""",
    "map_diff_ops": f"""WITH {_PLACED}, {_TAGS}, o AS (SELECT key + 1 AS key, k, v FROM tags WHERE key % 2 = 1), h AS (SELECT * FROM tags WHERE key % 2 = 0 AND (k <> 'type' OR key % 3 <> 0))
SELECT o.key, o.k, CASE WHEN h.v IS NULL THEN 'add' ELSE 'mod' END AS op, o.v, h.v AS was FROM o LEFT JOIN h ON o.key = h.key AND o.k = h.k WHERE h.v IS NULL OR (o.k <> 'size' AND CASE WHEN o.k IN ('name', 'operator') THEN regexp_replace(lower(o.v), '[^a-z0-9]+', ' ', 'g') <> regexp_replace(lower(h.v), '[^a-z0-9]+', ' ', 'g') ELSE trim(o.v) <> trim(h.v) END)""",
    "address_all_or_nothing": f"""WITH {_PLACED}, {_TAGS}, o AS (SELECT key + 1 AS key, k, v FROM tags WHERE key % 2 = 1 AND k IN ('name', 'type')), h AS (SELECT * FROM tags WHERE key % 2 = 0 AND k = 'name' AND key % 4 = 0),
j AS (SELECT o.*, h.v AS was, max((h.v IS NOT NULL AND regexp_replace(lower(h.v), '[^a-z0-9]+', ' ', 'g') <> regexp_replace(lower(o.v), '[^a-z0-9]+', ' ', 'g'))::INT) OVER (PARTITION BY o.key) AS away FROM o LEFT JOIN h ON o.key = h.key AND o.k = h.k)
SELECT key, k, 'add' AS op, v FROM j WHERE away = 0 AND was IS NULL""",
    "disputed_keys": "SELECT l_partkey AS element, l_returnflag AS k, count(DISTINCT l_linestatus) AS n_values, min(l_linestatus) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) > 1",
    "record_blocks": """WITH u AS (SELECT l_orderkey, unnest(['l_returnflag', 'l_linestatus', 'l_suppkey']) AS "column", unnest([l_returnflag, l_linestatus, l_suppkey::VARCHAR]) AS v FROM lineitem)
SELECT l_orderkey, "column", count(DISTINCT v) = 1 AS constant, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value FROM u GROUP BY 1, 2""",
    "queue_page": f"""WITH {_DECIDED}, c AS (SELECT o_orderkey AS key, least(1.0::DOUBLE, o_totalprice / 500000) AS conf FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT key FROM dec)),
k AS (SELECT *, row_number() OVER (ORDER BY conf DESC, key)::INT AS rank FROM c WHERE conf BETWEEN 0.2 AND 1)
SELECT key, rank, round(conf, 4) AS conf FROM k WHERE rank > (least(2, greatest(1, ceil((SELECT count(*) FROM k) / 50.0))) - 1) * 50 AND rank <= least(2, greatest(1, ceil((SELECT count(*) FROM k) / 50.0))) * 50""",
    "area_tallies": f"""WITH {_DECIDED} SELECT c_nationkey, count(*) AS n, count(dec.key) AS decided, greatest(0, count(*) - count(dec.key)) AS pending, count(*) FILTER (WHERE kind = 'accepted') AS accepted,
count(*) FILTER (WHERE kind = 'accepted' AND decided_at >= TIMESTAMP '1998-01-01') AS accepted_lately, CASE WHEN count(dec.key) > 0 THEN round(count(*) FILTER (WHERE kind = 'accepted')::DOUBLE / count(dec.key), 4) END AS share
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN dec ON dec.key = o_orderkey GROUP BY c_nationkey""",
    "source_yields": "SELECT s_nationkey, n_name, count(*) AS n_tags, count(*) FILTER (WHERE l_discount = 0) AS unevidenced, count(DISTINCT l_orderkey) AS n_records FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "staged_batches": """WITH o AS (SELECT c_nationkey, o_custkey AS element, min(o_orderkey) AS first, count(*) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, element, n_rows, (row_number() OVER (PARTITION BY c_nationkey ORDER BY first, element) - 1) // 50 AS batch FROM o""",
    "runs_hold": """WITH x AS (SELECT user_id AS source, event_id AS last_id, CASE WHEN value < 60 THEN 'failed' ELSE 'ok' END AS last_result, sum((value < 60)::INT) OVER w = 3 AND count(*) OVER w = 3 AS hold, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT source, last_id, last_result, hold FROM x WHERE nth = 1""",
    "lockout_sessions": """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 900000000, false)::INT AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
SELECT user_id, island, count(*) AS n, count(*) >= 5 AS locked, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY 1, 2""",
    "snapshot_merge": f"""WITH {_DECIDED}, o AS (SELECT o_orderkey AS key, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 <> 0),
m AS (SELECT coalesce(o.key, n.key) AS key, o.h AS oh, n.h AS nh, CASE WHEN o.key IS NOT NULL AND o.key IN (SELECT key FROM dec) THEN 'kept' WHEN n.key IS NULL THEN 'vanished' WHEN o.key IS NULL THEN 'added' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.key = n.key)
SELECT state, CASE WHEN state IN ('kept', 'vanished') THEN oh ELSE nh END AS hash, count(*) AS n, sum(key)::BIGINT AS keys FROM m GROUP BY 1, 2""",
    "sweep_vanished": f"WITH {_DECIDED} SELECT o_orderkey AS key FROM orders WHERE o_orderkey IN (SELECT key FROM dec) OR NOT (o_orderkey % 4 <> 0 AND (o_orderkey % 6 = 0 OR o_orderdate < TIMESTAMP '1997-06-01'))",
    "conflict_refresh": f"WITH {_DECIDED}, c AS (SELECT o_orderkey AS key, o_custkey + 1 AS element, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 3 END AS base FROM orders WHERE o_orderkey NOT IN (SELECT key FROM dec)) SELECT c.key, c.element, c.base, (c_custkey % 7)::INT AS head FROM c JOIN customer ON c_custkey + 1 = element WHERE c_custkey % 7 > base",
    "newest_declaration": """WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS nth FROM lineitem),
s AS (SELECT l_partkey, l_quantity AS stated FROM w WHERE l_returnflag = 'N' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY nth) = 1)
SELECT w.l_partkey, w.l_orderkey, w.l_linenumber, w.l_extendedprice, s.stated FROM w LEFT JOIN s ON w.l_partkey = s.l_partkey WHERE nth = 1""",
    "socket_rollup": """WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n, max(l_quantity) AS most, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS status, bool_and(l_discount > 0) AS all_reduced,
array_to_string(list_sort(list_distinct(list(l_suppkey::VARCHAR))), ';') AS sup, min(CASE WHEN NOT (month(l_shipdate) = 1 AND day(l_shipdate) = 1) THEN l_shipdate::DATE END)::VARCHAR AS first_date FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n_a, n_n, most, status, all_reduced, CASE WHEN len(sup) <= 20 THEN sup END AS suppliers, first_date FROM s""",
    "name_similarity_dice": f"WITH {_PLACED} SELECT p.key AS p_partkey, trim(regexp_replace(lower(p.name), '[^a-z0-9]+', ' ', 'g')) AS name, round({_dice('p.toks', 'q.toks')}, 6) AS likeness FROM part2 p JOIN part2 q ON q.key = p.key + 1",
    "page_hosts": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages",
    "page_links": """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href="([^"#]+)', 1))) AS href FROM pages""",
    "html_text": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<noscript.*?</noscript>', ' ', 'gis'), '<svg.*?</svg>', ' ', 'gis'), '<template.*?</template>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '</?(?:p|div|br|li|tr|h[1-6]|section|article|footer|header|td)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\f\x0b\x{a0}]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10) || chr(13)) AS text, regexp_extract_all(html, '<script[^>]+application/ld\+json[^>]*>(.*?)</script>', 1, 'is') AS ld FROM pages)
SELECT page_id, text || CASE WHEN len(ld) > 0 THEN chr(10) || chr(10) || 'Structured data: ' || array_to_string(list_transform(ld, lambda x: trim(x)), chr(10)) ELSE '' END AS text FROM t""",
    "quote_evidence": rf"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS flat FROM documents), b AS (SELECT item_id, text AS quote, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS flat_quote FROM benchmark), dl AS MATERIALIZED (SELECT *, lower(flat) AS low FROM d), bl AS MATERIALIZED (SELECT *, lower(flat_quote) AS low_quote FROM b WHERE flat_quote <> ''),
h AS (SELECT *, '\Q' || replace(replace(flat_quote, '\E', '\E\\E\Q'), ' ', '\E{_SPACE}\Q') || '\E' AS p FROM dl JOIN bl ON contains(low, low_quote)),
a AS (SELECT *, CASE WHEN contains(text, quote) THEN strpos(text, quote) WHEN contains(flat, flat_quote) THEN 1 + len(regexp_extract(text, '(?s)^(.*?)' || p, 1)) ELSE 1 + len(regexp_extract(text, '(?is)^(.*?)' || p, 1)) END::BIGINT AS "at" FROM h)
SELECT doc_id, item_id, a.at, substring(text, greatest(1, a.at - 20), least(20, a.at - 1)) AS before FROM a""",
    "stale_flags": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS days, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') >= 60 AS stale FROM orders",
    "change_xml": f"""WITH {_PLACED}, {_TAGS} SELECT key AS element, '<modify><node id="' || key || '">' || string_agg('<tag k="' || k || '" v="' || replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '"/>', '' ORDER BY k, v) || '</node></modify>' AS xml FROM tags WHERE key % 2 = 0 GROUP BY key""",
    "rules_eval": rules.EXAMPLE_SQL,
    "record_rules": rules.ORDERS_SQL,
    "likely_duplicates": f"""WITH {_PLACED}, n AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d, p.comp = q.comp AS same FROM r p JOIN e q ON abs(p.lat - q.lat) < 0.003 AND p.size % 5 = q.size % 5 AND NOT coalesce(p.ref <> q.ref, false))
SELECT key, element, round(d, 1) AS metres FROM n WHERE d <= 150 OR (d <= 300 AND same) QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, element) = 1""",
    "far_namesakes": f"""WITH {_PLACED}, n AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d FROM r p JOIN e q ON abs(p.lat - q.lat) < 0.002 AND p.comp = q.comp AND p.size % 5 = q.size % 5)
SELECT key, element, round(d, 1) AS metres FROM n WHERE d > 25 AND d <= 150 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, element) = 1""",
    "one_site_parts": f"""WITH {_PLACED}, {_CLOSE}, {_MATCHED},
b AS (SELECT x.key, m.element, el.lat, el.lon, x.toks, x.comp, x.ctoks, x.kind, x.ref, x.soft, x.access, el.toks AS el_toks, el.comp AS el_comp, el.ctoks AS el_ctoks FROM m JOIN cr x ON x.key = m.key JOIN ce el ON el.key = m.element),
n AS (SELECT p.key, q.key AS other, {_metres('p', 'q')} AS d, false AS by_id FROM b p JOIN ce q ON abs(p.lat - q.lat) < 0.0005 AND q.key <> p.element AND q.kind = p.kind WHERE NOT coalesce(p.ref <> q.ref, false) AND NOT coalesce(p.soft <> q.soft, false)
  AND (len(q.toks) = 0 OR {_dice('p.toks', 'q.toks')} >= 0.5 OR (len(p.el_toks) > 0 AND {_dice('p.el_toks', 'q.toks')} >= 0.5)) AND ({_WHO} >= 0.5 OR {_WHO.replace('p.comp', 'p.el_comp').replace('p.ctoks', 'p.el_ctoks')} >= 0.5) AND NOT coalesce(p.access = 'yes' AND q.access = 'private', false)),
h AS (SELECT p.key, q.key AS other, {_metres('p', 'q')} AS d, true AS by_id FROM b p JOIN ce q ON p.soft = q.soft AND q.key <> p.element AND NOT q.gone AND NOT coalesce(p.ref <> q.ref, false) WHERE p.soft NOT IN (SELECT soft FROM cr WHERE soft IS NOT NULL GROUP BY soft HAVING count(*) > 1)),
a AS (SELECT * FROM n WHERE d <= 25 UNION ALL SELECT * FROM h WHERE (key, other) NOT IN (SELECT (key, other) FROM n WHERE d <= 25))
SELECT key, other, round(d, 1) AS metres, by_id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.element = a.other AND m.key <> a.key)""",
    "unlisted_kin": f"""WITH {_PLACED}, {_CLOSE}, k AS (SELECT * REPLACE (CASE WHEN key % 8 < 5 THEN ref ELSE ref || 'X' END AS ref) FROM cr), n AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d FROM k p JOIN ce q ON abs(p.lat - q.lat) < 0.0006 AND p.kind = q.kind AND p.ref IS NOT NULL AND q.ref IS NOT NULL AND q.ref NOT IN (SELECT ref FROM k WHERE ref IS NOT NULL)) SELECT key, element FROM n WHERE d <= 50""",
    "sister_places": f"""WITH {_PLACED}, {_CLOSE}, {_MATCHED}, v AS (SELECT key AS element, -1 AS sayer, address, contact, company FROM ce UNION ALL SELECT m.element, m.key, x.address, x.contact, x.company FROM m JOIN cr x ON x.key = m.key),
n AS (SELECT p.key, q.key AS element, {_metres('p', 'q')} AS d, v.sayer, CASE WHEN p.address = v.address THEN 'address' WHEN p.contact = v.contact THEN 'contact' WHEN p.company = v.company THEN 'company' END AS reason FROM cr p JOIN ce q ON abs(p.lat - q.lat) < 0.003 AND p.ref <> q.ref JOIN v ON v.element = q.key AND v.sayer <> p.key)
SELECT key, element, round(d, 1) AS metres, reason FROM n WHERE d <= 300 AND reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, element, sayer) = 1""",
    "twin_reasons": f"""WITH {_PLACED}, t AS (SELECT key, lat, lon, ref, comp, ctoks, key % 40 AS line, key % 3 AS num, CASE WHEN key % 3 = 0 THEN key % 50 END AS org, CASE WHEN key % 4 = 1 THEN (key % 9) || ';' || (key % 11) END AS address FROM r),
n AS (SELECT p.key, q.key AS other, {_metres('p', 'q')} AS d, p.num = q.num OR {_WHO} >= 0.5 OR true AS alike, p.ref IS NOT NULL AND q.ref IS NOT NULL AS hard FROM t p JOIN t q ON p.key <> q.key AND abs(p.lat - q.lat) < 0.001),
a AS (SELECT key, other, 'near' AS reason FROM n WHERE d <= 10 OR (d <= 60 AND alike AND NOT hard) UNION ALL SELECT p.key, q.key, 'same' FROM t p JOIN t q ON p.key <> q.key AND p.line = q.line AND p.num = q.num AND p.comp = q.comp
  UNION ALL SELECT p.key, q.key, 'organisation' FROM t p JOIN t q ON p.key <> q.key AND p.org = q.org UNION ALL SELECT p.key, q.key, 'address' FROM t p JOIN t q ON p.key <> q.key AND p.address = q.address)
SELECT key, reason, count(*) AS n, min(other) AS other FROM a GROUP BY key, reason""",
    "matched_elsewhere": """WITH m AS (SELECT DISTINCT l_partkey AS element, l_orderkey * 10 + l_linenumber AS key FROM lineitem), x AS (SELECT element, count(*) AS n, list(key ORDER BY key) AS k FROM m GROUP BY 1 HAVING count(*) > 1) SELECT element, n, array_to_string(k[1:3], ',') AS keys FROM x""",
    "nearest_of_rows": """WITH x AS (SELECT l_orderkey AS key, CASE WHEN l_quantity::INT % 2 = 0 THEN l_quantity::DOUBLE ELSE 'inf'::DOUBLE END AS gap FROM lineitem), m AS (SELECT *, min(gap) OVER (PARTITION BY key) AS least FROM x)
SELECT key, count(*) AS n, min(CASE WHEN isfinite(gap) THEN gap END) AS least FROM m WHERE gap <= least + 10 GROUP BY key""",
    "sampled_orders": "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 20",
    "name_scores": f"""WITH {_PLACED}, a AS (SELECT key, list_distinct(list_concat(list_filter(toks, lambda w: w NOT IN ('prive', 'privee', 'public', 'publique')), ctoks)) AS t, ctoks FROM part2),
b AS (SELECT a.key, a.t, a.ctoks AS brand, CASE WHEN n.key % 4 = 0 THEN n.ctoks ELSE n.t END AS o FROM a JOIN a n ON n.key = a.key + 1)
SELECT key AS p_partkey, CASE WHEN len(t) > 0 AND len(o) > 0 AND len(list_filter(o, lambda w: NOT list_contains(brand, w))) > 0 THEN round(CASE WHEN len(list_filter(o, lambda w: NOT list_contains(t, w))) = 0 THEN greatest(0.8::DOUBLE, {_dice('t', 'o')}) ELSE {_dice('t', 'o')} END, 6) END AS score FROM b""",
}
