"""Map objects as an element query answers them: one JSON text for each answer, flattened to rows, and what they hold counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import has_any

_POINT = "struct<lat:double,lon:double>"
BODY = f"remark string, elements array<struct<type:string,id:bigint,version:int,user:string,timestamp:string,lat:double,lon:double,center:{_POINT},bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,tags:map<string,string>>>"


def parse_elements(bodies: DataFrame, body: str = "body") -> DataFrame:
    """type, id, version, user, timestamp, lat, lon, bounds, tags of the objects in answers: nodes, ways and relations, where they are: a point, a centre, or their
    box's middle. What has none of these goes; without a version it is the first, without tags they are empty.

    An answer that is no JSON, or whose remark says that it failed, is an error: half an answer would have objects vanish. It stops the read.
    """
    parsed = bodies.select(F.from_json(body, BODY, {"mode": "PERMISSIVE"}).alias("b"), F.col(body).alias("raw"))
    failed = F.col("b.remark").rlike("(?i)error|timed out") | (F.col("raw").isNotNull() & F.col("b.elements").isNull() & ~F.coalesce(F.get_json_object("raw", "$").startswith("{"), F.lit(False)))
    checked = F.when(failed, F.raise_error(F.concat(F.lit("the element query failed: "), F.coalesce("b.remark", F.substring("raw", 1, 80))))).otherwise(F.col("b.elements"))
    rows = parsed.select(F.explode(checked).alias("e")).filter(F.col("e.type").isin("node", "way", "relation"))
    middle = lambda a: (F.col(f"e.bounds.min{a}") + F.col(f"e.bounds.max{a}")) / 2
    at = lambda a: F.coalesce(F.col(f"e.{a}"), F.col(f"e.center.{a}"), middle(a)).alias(a)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = rows.select("e.type", "e.id", F.coalesce("e.version", F.lit(1)).alias("version"), "e.user", "e.timestamp", at("lat"), at("lon"), "e.bounds", F.coalesce("e.tags", empty).alias("tags"))
    return out.filter("lat is not null and lon is not null")


def count_places(elements: DataFrame, main_keys: Sequence[str], area: Column) -> DataFrame:
    """area, n, places: how many objects an area has, and how many of them are places, with any main key."""
    return elements.groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("n"), F.count_if(has_any(main_keys, F.col("tags"))).alias("places"))


def value_audit(elements: DataFrame, keys: Sequence[str], shown: int = 3) -> DataFrame:
    """k, v, n, ids: how many objects have each value of some keys, and the first few ids. A value that all objects share is one count, no list of them."""
    rows = elements.select("id", F.explode("tags").alias("k", "v")).filter(F.col("k").isin(*keys))
    # The least ids by steps: each is the least above the one before, so no task lists a value's objects.
    out = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("last")).withColumn("ids", F.array("last"))
    for _ in range(shown - 1):
        following = rows.join(out.select("k", "v", "last"), ["k", "v"]).filter(F.col("id") > F.col("last")).groupBy("k", "v").agg(F.min("id").alias("after"))
        out = out.join(following, ["k", "v"], "left").select("k", "v", "n", F.coalesce("after", "last").alias("last"), F.when(F.col("after").isNotNull(), F.concat("ids", F.array("after"))).otherwise(F.col("ids")).alias("ids"))
    return out.select("k", "v", "n", "ids")
