"""The reviewers' desk over the given tables, each query with the SQL that it must agree with.

Orders are candidates, their line items tags with evidence, urgent orders decisions; nations are areas, suppliers sources,
events the states of a source's queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import desk, plan
from ..sources import crawl

NOW, LIMIT = "1998-08-02", 60


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidates(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area")), "o_custkey")
    kind = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "closure").otherwise("update")
    return o.select(
        F.col("o_orderkey").alias("key"), "area", kind.alias("type"), F.concat(F.lit("Shop "), (F.col("o_orderkey") % 26).cast("string")).alias("name"), F.concat(F.lit("S"), (F.col("o_custkey") % 7).cast("string")).alias("source"),
        F.floor(F.least(F.lit(1.0), F.col("o_totalprice").cast("double") / 500000) * 100).alias("conf"), F.col("o_orderdate").alias("fetched_at"), F.when(F.col("o_orderkey") % 50 == 0, F.lit(7)).alias("head_version"), F.col("o_custkey").alias("element"),
    )


def _tags(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_suppkey").cast("string").alias("v"), (F.col("l_quantity") >= 50).alias("invalid"), (F.col("l_linenumber") % 3).alias("n_evidence"))


def _decisions(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("decided_at"), F.concat(F.lit("C"), (F.col("o_orderkey") % 40).cast("string")).alias("changeset"))


def queue_flags(spark, sf_dir):
    """Every candidate's number of tags and worst flag."""
    return desk.with_flags(_candidates(spark, sf_dir), _tags(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("key", "n_tags", "flag")


def queue_orders(spark, sf_dir):
    """The first three candidates of the queue in each of its seven orders, up and down."""
    rows = desk.with_flags(_candidates(spark, sf_dir), _tags(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    out = None
    for sort in desk.SORTS:
        for up in (True, False):
            top = rows.orderBy(*desk.queue_order(sort, up)).limit(3).select(F.lit(sort).alias("sort"), F.lit(up).alias("up"), "key")
            out = top if out is None else out.unionByName(top)
    return out


def scope_pending(spark, sf_dir):
    """Areas by what waits in them, with their sources."""
    areas = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"))
    links = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("area"), F.col("s_suppkey").alias("source"))
    return desk.scope_areas(areas, _candidates(spark, sf_dir), _decisions(spark, sf_dir), links)


def scope_totals(spark, sf_dir):
    """What waits in all areas, in a wanted one, and in the one with most waiting."""
    scoped = scope_pending(spark, sf_dir)
    parts = [desk.scope_counts(scoped, w).withColumn("wanted", F.lit(w or "none")) for w in (None, "all", "3", "gone")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def staged_details(spark, sf_dir):
    """Staged rows with their source's label and operations."""
    sources = _read(spark, sf_dir, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source"), F.initcap("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "ODbL").alias("licence"))
    ops = _tags(spark, sf_dir).select("key", "position", F.when(F.col("invalid"), "mod").otherwise("add").alias("op"), "k", "v")
    rows = desk.staged_rows(_decisions(spark, sf_dir), _candidates(spark, sf_dir), sources, ops)
    return rows.select("key", "element", "label", F.size("ops").alias("n_ops"), F.array_join(F.transform("ops", lambda o: F.concat_ws(" ", o["op"], o["k"], o["v"])), ";").alias("ops"))


def staged_page(spark, sf_dir):
    """The second batch of forty staged objects."""
    staged = _decisions(spark, sf_dir).join(_candidates(spark, sf_dir).select("key", "element"), "key")
    return desk.staged_batch(staged, 2, 40).select("key", "element", "place")


def changeset_list(spark, sf_dir):
    """Changesets by time with the rows they carried."""
    d = _decisions(spark, sf_dir)
    sets = d.groupBy("changeset").agg(F.max("decided_at").alias("uploaded_at"), F.lit("ok").alias("result")).unionByName(d.limit(0).select(F.lit("x").alias("changeset"), "decided_at", F.lit("x").alias("result")).withColumnRenamed("decided_at", "uploaded_at"))
    return desk.changeset_history(sets, d).select("changeset", "carried", "place")


def nested_candidates(spark, sf_dir):
    """Candidates with tags and evidence as they are shown, in order."""
    tags = _tags(spark, sf_dir).dropDuplicates(["key", "position", "k"]).withColumn("tag", F.concat_ws("-", "key", "position", "k"))
    evidence = tags.filter("n_evidence > 0").select("tag", F.explode(F.sequence(F.lit(1), F.col("n_evidence").cast("int"))).alias("position"), F.concat(F.col("k"), F.lit("!")).alias("text"))
    out = desk.nested(_candidates(spark, sf_dir).filter("type = 'closure'").select("key"), tags.select("tag", "key", "position", "k"), evidence)
    return out.select("key", F.array_join(F.transform("tags", lambda t: F.concat(t["position"].cast("string"), t["k"], F.array_join(t["evidence"], ""))), " ").alias("tags"))


def due_source(spark, sf_dir):
    """The source that runs next, with and without one that was asked for."""
    s = _read(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 3 != 0).alias("enabled"), (F.col("s_suppkey") % 2 == 1).alias("failing"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 30).cast("int")).cast("timestamp").alias("next_at"), F.lit(None).cast("timestamp").alias("requested_at"))
    asked = rows.withColumn("requested_at", F.when(F.col("source") % 5 == 3, F.date_add(F.lit("2024-02-01").cast("date"), (-F.col("source")).cast("int")).cast("timestamp")))
    now = F.lit("2024-01-06").cast("timestamp")
    return desk.pick_due(rows, now).withColumn("case", F.lit("clock")).unionByName(desk.pick_due(asked, now).withColumn("case", F.lit("asked"))).unionByName(desk.pick_due(rows, now, enabled=False).withColumn("case", F.lit("off")))


def queue_notices(spark, sf_dir):
    """Events at which a user's value went from under a limit to it or over."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("pending"))
    return desk.crossings(e, LIMIT).select("source", "id")


def run_messages(spark, sf_dir):
    """Results and messages of runs: nations' customers as areas, small balances as errors."""
    c = _read(spark, sf_dir, "customer")
    rows = c.select((F.col("c_custkey") % 100).alias("run"), F.col("c_custkey").alias("area"), (F.col("c_custkey") % 4 != 1).alias("ok"), F.when(F.col("c_custkey") % 6 == 1, F.concat(F.lit("error "), F.lpad((F.col("c_custkey") % 17).cast("string"), 2, "0"))).alias("error"))
    return desk.run_results(rows)


def upload_labels(spark, sf_dir):
    """What an upload's comment says: its objects by kind and its sources, by changeset."""
    rows = _decisions(spark, sf_dir).join(_candidates(spark, sf_dir).select("key", "source", "element"), "key")
    kind = F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), (F.col("element") % 3 + 1).cast("int"))
    return rows.withColumn("kind", kind).groupBy("changeset").agg(desk.objects_label(F.col("kind")).alias("objects"), desk.source_tag(F.col("source")).alias("sources"))


def mean_confidence(spark, sf_dir):
    """A candidate's confidence: the mean over its operations."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 0.25).alias("conf"))
    return plan.confidence(rows)


def record_rows(spark, sf_dir):
    """Rules over all rows of a record: whether all or any meet a test, the values shown as evidence, a note, warning lines."""
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_suppkey").cast("string").alias("s")))).alias("rows"))
    rows = rows.withColumn("shown", desk.evidence_text(F.transform("rows", lambda r: F.when(r["i"] % 4 == 0, "").otherwise(r["s"])))).withColumn("n", F.size("rows"))
    small, mixed = F.forall("rows", lambda r: r["q"] < 40), F.exists("rows", lambda r: r["f"] == "R")
    lines = desk.warning_lines(F.when(small, F.array(F.lit("all are small"))), F.when(mixed, F.array(F.lit("some came back"), F.lit("see them"))))
    return rows.select("key", small.alias("all_small"), mixed.alias("any_back"), "shown", desk.note_text("{n} rows of {shown}", ["n", "shown"]).alias("note"), lines.alias("warnings"))


def conflict_values(spark, sf_dir):
    """What the head of a changed object says, and what a candidate would write."""
    c = _candidates(spark, sf_dir).filter("head_version is not null")
    ops = _tags(spark, sf_dir).groupBy("key", "k").agg(F.max("v").alias("v"), F.max(F.when(F.col("invalid"), "mod").otherwise("add")).alias("op"))
    heads = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element"), F.create_map(F.lit("NO"), (F.col("c_custkey") % 100).cast("string"), F.lit("AF"), F.lit("1")).alias("tags"))
    return desk.conflict_tags(c, ops, heads)


def page_seeds(spark, sf_dir):
    """Pages as seeds and the customers whose site they are on, those of nobody too."""
    seeds = _read(spark, sf_dir, "pages").select("url", text.host(F.col("url")).alias("host"))
    hosts = seeds.select("host").distinct().filter(F.pmod(F.length("host"), F.lit(3)) != 0)
    elements = hosts.select("host", F.concat(F.lit("node/"), F.length("host").cast("string")).alias("element"))
    return desk.seeds_by_host(seeds, elements)


def pages_to_read(spark, sf_dir):
    """Pages that are new or changed since they were read, by a hash of their text, and a fingerprint of what the read depends on."""
    p = _read(spark, sf_dir, "pages").select("page_id", "url", text.short_hash(F.col("html")).alias("mark"))
    before = p.filter("page_id % 3 > 0").withColumn("mark", F.when(F.col("page_id") % 5 == 0, "old").when(F.col("page_id") % 7 != 0, F.col("mark")))
    return desk.changed_reads(before, p).select("page_id", "mark")


def public_hosts(spark, sf_dir):
    """Which addresses a crawl may be led to."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    ip = F.concat_ws(".", *[(F.col("id") * k % 300).cast("string") for k in (1, 7, 11, 13)])
    return c.select("id", values.is_public_address(ip).alias("public"))


def robots_allowed(spark, sf_dir):
    """Pages that the sites' robots files let a reader have."""
    p = _read(spark, sf_dir, "pages").select("page_id", "url", text.host(F.col("url")).alias("host"), F.concat(F.lit("/"), (F.col("page_id") % 4).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    rules = F.when(F.length("host") % 2 == 0, "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /1/\nAllow: /1/*5.html$ # some\nDisallow: /2").otherwise("User-agent: Reader/2\nUser-agent: x\nDisallow: /3/\n\nUser-agent: *\nDisallow: /")
    robots = p.select("host").distinct().filter(F.length("host") % 5 != 0).select("host", rules.alias("robots"))
    return crawl.allowed_pages(p, robots, "Reader/1.0").select("page_id")


def queries():
    names = (
        queue_flags, queue_orders, scope_pending, scope_totals, staged_details, staged_page, changeset_list, nested_candidates, due_source, queue_notices, run_messages, upload_labels, mean_confidence, record_rows,
        conflict_values, page_seeds, pages_to_read, public_hosts, robots_allowed,
    )
    return {f.__name__: f for f in names}


_C = """c AS (SELECT o_orderkey AS key, c_nationkey AS area, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'closure' ELSE 'update' END AS type, 'Shop ' || (o_orderkey % 26) AS name, 'S' || (o_custkey % 7) AS source,
  floor(least(1.0::DOUBLE, o_totalprice::DOUBLE / 500000) * 100)::BIGINT AS conf, o_orderdate AS fetched_at, CASE WHEN o_orderkey % 50 = 0 THEN 7 END AS head_version, o_custkey AS element FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT l_orderkey AS key, l_linenumber::INT AS position, l_returnflag || l_linestatus AS k, l_suppkey::VARCHAR AS v, l_quantity >= 50 AS invalid, l_linenumber % 3 AS n_evidence FROM lineitem),
d AS (SELECT o_orderkey AS key, o_orderdate AS decided_at, 'C' || (o_orderkey % 40) AS changeset FROM orders WHERE o_orderpriority = '1-URGENT')"""
_F = f"""{_C}, f AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.key = c.key) AS n_tags, CASE WHEN head_version IS NOT NULL THEN 5 WHEN EXISTS (SELECT 1 FROM t WHERE t.key = c.key AND invalid) THEN 4 WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.key = c.key AND n_evidence > 0) THEN 3
WHEN EXISTS (SELECT 1 FROM t WHERE t.key = c.key AND n_evidence = 0) THEN 2 WHEN fetched_at <= TIMESTAMP '1998-08-02' - INTERVAL 60 DAY THEN 1 ELSE 0 END AS flag FROM c)"""
_A = f"""{_C}, q AS (SELECT c.area, count(*) AS queued, count(d.key) AS decided FROM c LEFT JOIN d ON c.key = d.key GROUP BY 1), l AS (SELECT s_nationkey AS area, count(*) AS sources FROM supplier GROUP BY 1),
a AS (SELECT n_nationkey AS area, coalesce(queued, 0) AS queued, coalesce(queued - decided, 0) AS pending, coalesce(sources, 0) AS sources FROM nation LEFT JOIN q ON q.area = n_nationkey LEFT JOIN l ON l.area = n_nationkey)"""


def _top(sort: str, by: str, up: bool) -> str:
    return f"SELECT * FROM (SELECT '{sort}' AS sort, {'true' if up else 'false'} AS up, key FROM f ORDER BY {by} {'ASC' if up != (sort == 'age') else 'DESC'}, conf DESC, key LIMIT 3)"


_ORDERS = {"type": "CASE type WHEN 'new' THEN 0 WHEN 'closure' THEN 1 ELSE 2 END", "name": "lower(name)", "tags": "n_tags", "source": "source", "age": "fetched_at", "flags": "flag", "conf": "conf"}

SQL = {
    "robots_allowed": r"""WITH p AS (SELECT page_id, page_id % 4 AS part, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id FROM p WHERE length(host) % 5 = 0 OR (length(host) % 2 = 0 AND (part IN (0, 3) OR (part = 1 AND page_id % 10 = 5))) OR (length(host) % 2 = 1 AND part <> 3)""",
    "queue_flags": f"WITH {_F} SELECT key, n_tags, flag FROM f",
    "queue_orders": f"WITH {_F} " + " UNION ALL ".join(_top(s, by, up) for s, by in _ORDERS.items() for up in (True, False)),
    "scope_pending": f"WITH {_A} SELECT *, row_number() OVER (ORDER BY pending DESC, area)::INT AS place FROM a",
    "scope_totals": f"""WITH {_A}, m AS (SELECT area::VARCHAR AS scope, pending, queued AS total FROM a ORDER BY pending DESC, area LIMIT 1)
SELECT *, 'none' AS wanted FROM m UNION ALL SELECT *, 'gone' FROM m UNION ALL SELECT area::VARCHAR, pending, queued, '3' FROM a WHERE area = 3 UNION ALL SELECT NULL, sum(pending)::BIGINT, sum(queued)::BIGINT, 'all' FROM a""",
    "staged_details": f"""WITH {_C}, s AS (SELECT 'S' || n_nationkey AS source, upper(n_name[1:1]) || lower(n_name[2:]) || CASE WHEN n_nationkey % 2 = 0 THEN ' (ODbL)' ELSE '' END AS label FROM nation),
o AS (SELECT key, count(*) AS n, string_agg(CASE WHEN invalid THEN 'mod ' ELSE 'add ' END || k || ' ' || v, ';' ORDER BY position, CASE WHEN invalid THEN 'mod' ELSE 'add' END, k, v) AS ops FROM t GROUP BY key)
SELECT d.key, c.element, s.label, coalesce(o.n, 0)::INT AS n_ops, coalesce(o.ops, '') AS ops FROM d JOIN c ON c.key = d.key JOIN s ON s.source = c.source LEFT JOIN o ON o.key = d.key""",
    "staged_page": f"""WITH {_C}, s AS (SELECT d.key, c.element, d.decided_at FROM d JOIN c ON c.key = d.key), e AS (SELECT element, min(struct_pack(a := decided_at, b := key)) AS first FROM s GROUP BY 1),
p AS (SELECT element, row_number() OVER (ORDER BY first, element) - 1 AS place FROM e), n AS (SELECT least(2, greatest(1, ceil(count(*) / 40.0)))::BIGINT AS page FROM e) SELECT s.key, s.element, p.place FROM s JOIN p ON p.element = s.element, n WHERE p.place // 40 = n.page - 1""",
    "changeset_list": f"WITH {_C} SELECT changeset, count(*) AS carried, row_number() OVER (ORDER BY max(decided_at) DESC, changeset) - 1 AS place FROM d GROUP BY 1",
    "nested_candidates": f"""WITH {_C}, u AS (SELECT DISTINCT key, position, k, n_evidence FROM t), x AS (SELECT key, string_agg(position || k || repeat(k || '!', n_evidence::INT), ' ' ORDER BY position, k) AS tags FROM u GROUP BY 1) SELECT c.key, coalesce(x.tags, NULL) AS tags FROM c LEFT JOIN x ON x.key = c.key WHERE c.type = 'closure'""",
    "due_source": """WITH s AS (SELECT s_suppkey AS source FROM supplier) SELECT min(source) AS source, false AS asked, 'clock' AS "case" FROM s WHERE source % 3 <> 0 AND source % 2 = 0 AND source % 30 <= 5
UNION ALL SELECT max(source), true, 'asked' FROM s WHERE source % 5 = 3""",
    "queue_notices": "WITH x AS (SELECT user_id AS source, event_id AS id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM events) SELECT source, id FROM x WHERE before < 60 AND value >= 60",
    "run_messages": """WITH x AS (SELECT c_custkey % 100 AS run, bool_or(c_custkey % 4 <> 1) AS any_ok, list_sort(list(DISTINCT 'error ' || lpad((c_custkey % 17)::VARCHAR, 2, '0')) FILTER (WHERE c_custkey % 6 = 1)) AS e FROM customer GROUP BY 1)
SELECT run, CASE WHEN NOT any_ok THEN 'failed' WHEN len(e) > 0 THEN 'partial' ELSE 'ok' END AS result, coalesce(array_to_string(e[1:3], '; '), '') || CASE WHEN len(e) > 3 THEN ' (+' || (len(e) - 3) || ' more)' ELSE '' END AS message FROM x""",
    "upload_labels": f"""WITH {_C}, x AS (SELECT changeset, count(*) FILTER (WHERE element % 3 = 0) AS a, count(*) FILTER (WHERE element % 3 = 1) AS b, count(*) FILTER (WHERE element % 3 = 2) AS r, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources FROM d JOIN c ON c.key = d.key GROUP BY 1)
SELECT changeset, concat_ws(', ', CASE WHEN a = 1 THEN '1 node' WHEN a > 1 THEN a || ' nodes' END, CASE WHEN b = 1 THEN '1 way' WHEN b > 1 THEN b || ' ways' END, CASE WHEN r = 1 THEN '1 relation' WHEN r > 1 THEN r || ' relations' END) AS objects, sources FROM x""",
    "mean_confidence": "SELECT l_orderkey AS key, floor(avg(l_linenumber * 0.25::DOUBLE) * 100 + 0.5) / 100 AS conf FROM lineitem GROUP BY 1",
    "record_rows": """WITH g AS (SELECT l_orderkey AS key, bool_and(l_quantity < 40) AS all_small, bool_or(l_returnflag = 'R') AS any_back, count(*) AS n FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey AS key, l_suppkey::VARCHAR AS s, min(struct_pack(i := l_linenumber, q := l_quantity::DOUBLE, f := l_returnflag, s := l_suppkey::VARCHAR)) AS i FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY 1, 2), v AS (SELECT key, list(s ORDER BY i) AS l FROM u GROUP BY 1),
w AS (SELECT g.*, coalesce(array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ', …' ELSE '' END, '') AS shown FROM g LEFT JOIN v ON g.key = v.key)
SELECT key, all_small, any_back, shown, n || ' rows of ' || shown AS note, concat_ws(chr(10), CASE WHEN all_small THEN 'all are small' END, CASE WHEN any_back THEN 'some came back' || chr(10) || 'see them' END) AS warnings FROM w""",
    "conflict_values": f"""WITH {_C}, o AS (SELECT key, k, max(v) AS v FROM t GROUP BY 1, 2), j AS (SELECT c.key, o.k, CASE o.k WHEN 'NO' THEN (c.element % 100)::VARCHAR WHEN 'AF' THEN '1' END AS theirs, o.v AS ours FROM c JOIN o ON o.key = c.key WHERE c.head_version IS NOT NULL)
SELECT * FROM j WHERE theirs IS DISTINCT FROM ours""",
    "page_seeds": r"WITH s AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages) SELECT url, host, CASE WHEN length(host) % 3 <> 0 THEN 'node/' || length(host) END AS element FROM s",
    "pages_to_read": "SELECT page_id, sha1(html)[1:16] AS mark FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0",
    "public_hosts": """WITH p AS (SELECT c_custkey AS id, c_custkey % 300 AS a, c_custkey * 7 % 300 AS b, c_custkey * 11 % 300 AS c, c_custkey * 13 % 300 AS d FROM customer)
SELECT id, CASE WHEN greatest(a, b, c, d) <= 255 THEN NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) END AS public FROM p""",
}
