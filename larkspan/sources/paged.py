"""Registers that are read page by page and by area: landed pages in bands of latitude, so that an area's read skips the others."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.geo import area_box, in_circle

#: Rows of a page, and rows of an answer from which the whole export is read instead (fixed values).
PAGE, CEILING = 100, 10_000
#: Bands of latitude to a degree, in which landed pages lie.
BANDS = 20


@dataclass(frozen=True)
class Area:
    """A circle (centre and metres), or a box of south, west, north and east."""

    centre: tuple[float, float] | None = None
    radius: float | None = None
    box: tuple[float, float, float, float] | None = None

    def bounds(self) -> tuple[float, float, float, float]:
        """South, west, north and east."""
        if not (self.centre and self.radius):
            return self.box
        south, north, west, east = area_box(*self.centre, self.radius)
        return south, west, north, east


def dataset_base(endpoint: str) -> str:
    """The address of a dataset from that of its records or of an export, without a query behind it."""
    bare = re.split(r"[?#]", endpoint, maxsplit=1)[0].rstrip("/")
    return re.sub(r"/(?:records|exports(?:/\w+)?)$", "", bare)


def where_clause(field: str, area: Area) -> str:
    """What to ask an API for, so that it answers with an area's rows only."""
    if area.centre and area.radius:
        lat, lon = area.centre
        return f"within_distance({field}, geom'POINT({lon} {lat})', {area.radius:g}m)"
    return f"in_bbox({field}, {', '.join(f'{x:g}' for x in area.bounds())})"


def order_field(columns: Sequence[str], key: str | None) -> str | None:
    """The column to order pages by: the key's, if the data has it. Without an order a row may come twice and another not at all."""
    return key if key in columns else None


def land_pages(rows: DataFrame, key: str, folder: str, lat: str = "lat", lon: str = "lon", size: int = PAGE) -> None:
    """Write rows as pages (offset, total_count, results), JSON lines in folders by band of latitude, those without a position in their own.

    A page's rows follow each other in the order of the key, with ties by all other columns, so that a page that is landed again
    is the same. Rows are numbered within their band: none is one task's work but a crowded band, which is split by key first.
    """
    band = F.coalesce(F.floor(F.col(lat).try_cast("double") * BANDS), F.lit(-(10**6))).cast("long")
    dealt = rows.withColumn("_band", band)
    rest = [c for c in rows.columns if c != key]
    slot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(64))
    nth = F.row_number().over(Window.partitionBy("_band", "_slot").orderBy(key, *rest)) - 1
    paged = dealt.withColumn("_slot", slot).withColumn("_nth", nth).withColumn("offset", F.floor(F.col("_nth") / size) * size)
    pages = paged.groupBy("_band", "_slot", "offset").agg(F.array_sort(F.collect_list(F.struct("_nth", F.struct(*rows.columns).alias("row")))).alias("r"))
    totals = paged.groupBy("_band").agg(F.count(F.lit(1)).alias("total_count"))
    out = pages.join(totals, "_band").select(F.col("_band").alias("band"), "_slot", "offset", "total_count", F.transform("r", lambda x: x["row"]).alias("results"))
    out.withColumnRenamed("_slot", "slot").write.mode("overwrite").partitionBy("band").json(folder)


def read_pages(spark: SparkSession, folder: str, row_schema: StructType, area: Area, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The rows of landed pages that lie in an area: only the bands that it touches are listed and read, the rest of the area's shape is held against each row."""
    south, _, north, _ = bounds = area.bounds()
    page = StructType([StructField("results", ArrayType(row_schema))])
    pages = spark.read.schema(StructType([*page.fields, *StructType.fromDDL("band long").fields])).json(folder)
    rows = pages.filter(F.col("band").between(int(south * BANDS // 1), int(north * BANDS // 1))).select(F.explode("results").alias("r")).select("r.*")
    at = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    if area.centre and area.radius:
        return rows.filter(in_circle(*at, area.centre, area.radius))
    return rows.filter(at[0].between(south, north) & at[1].between(bounds[1], bounds[3]))


def read_area(pages: DataFrame, export: DataFrame | None, key: str, skip: str = "false", ceiling: int = CEILING) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """An area's records (key, n, rows), the keys that are no places, and counts of what was read and left out.

    Where the pages hold more rows than an API pages through, they are left and the export's rows (of the area too) are taken, all of them, so none
    counts twice. Rows without a key are left out; a row for which `skip` holds is no place, but its key is still listed.
    """
    found = pages.count()
    rows = export if export is not None and found > ceiling else pages
    named = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != ""
    out = F.coalesce(F.expr(skip), F.lit(False))
    facts = rows.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~named).alias("skipped"), F.count_if(named & out).alias("not_places")).first()
    records = rows.filter(named & ~out).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias("rows"))
    return records, rows.filter(named & out).select(key).distinct(), facts.asDict() | {"export": int(rows is export)}


