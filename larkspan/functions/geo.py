"""Positions and distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0
#: Metres in a degree of latitude, a little fewer than there are, so that what is in reach is surely in the next cell.
DEGREE_M = 111_000.0


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def coordinate(text: Column, limit: float) -> Column:
    """A number in range from text, else null; blanks are refused."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & F.abs(value).between(0, limit), value)


def position(lat: Column, lon: Column) -> Column:
    """A struct of lat and lon from two texts; null if either is out of range or both are 0, which is no place but a blank."""
    y, x = coordinate(lat, 90.0), coordinate(lon, 180.0)
    return F.when(y.isNotNull() & x.isNotNull() & ((y != 0) | (x != 0)), F.struct(y.alias("lat"), x.alias("lon")))


def pair_position(text: Column) -> Column:
    """A position from one text that names two numbers, latitude first: "48.85, 2.35" or "[48.85;2.35]"."""
    numbers = F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0)
    return F.when(F.size(numbers) == 2, position(F.get(numbers, 0), F.get(numbers, 1)))


def geojson_position(text: Column) -> Column:
    """A position from a GeoJSON point, whose longitude stands first."""
    at = F.from_json(text, "type string, coordinates array<double>")
    ok = (at["type"] == "Point") & (F.size(at["coordinates"]) >= 2)
    return F.when(ok, position(F.get(at["coordinates"], 1).cast("string"), F.get(at["coordinates"], 0).cast("string")))


def decimals(value: Column) -> Column:
    """How many decimals a coordinate has, trailing zeros apart: how exactly it says where it is."""
    return F.length(F.rtrim(F.regexp_extract(F.trim(value), r"\.([0-9]+)$", 1), F.lit("0")))


def area_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """south, north, west and east of a circle, by 111,320 m a degree."""
    up = radius_m / 111_320
    wide = up / max(0.01, math.cos(math.radians(lat)))
    return lat - up, lat + up, lon - wide, lon + wide


def in_circle(lat: Column, lon: Column, centre: tuple[float, float], radius_m: float) -> Column:
    """In the circle's box, which the scan can be pruned by, and within its radius."""
    south, north, west, east = area_box(*centre, radius_m)
    return lat.between(south, north) & lon.between(west, east) & (distance(lat, lon, F.lit(centre[0]), F.lit(centre[1])) <= radius_m)


def _wide(row: Column, cell: float) -> Column:
    """Width in degrees of longitude of the cells of a row of the grid, as far from the equator as the row goes."""
    far = F.greatest(F.abs(row * cell), F.abs((row + 1) * cell))
    return F.lit(cell) / F.greatest(F.lit(0.01), F.cos(F.radians(far)))


def in_cell(df: DataFrame, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add cell_row and cell_col: the cell of each point in a grid whose cells are `metres` high and about as wide."""
    cell = metres / DEGREE_M
    df = df.withColumn("cell_row", F.floor(F.col(lat) / cell))
    return df.withColumn("cell_col", F.floor(F.col(lon) / _wide(F.col("cell_row"), cell)))


def in_cells_around(df: DataFrame, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A row for each of the nine cells around a point, each grid row with columns of its own width: what lies within
    `metres` of the point is in one of them."""
    cell = metres / DEGREE_M
    beside = F.array(F.lit(-1), F.lit(0), F.lit(1))
    df = df.withColumn("cell_row", F.explode(F.transform(beside, lambda k: F.floor(F.col(lat) / cell) + k)))
    return df.withColumn("cell_col", F.explode(F.transform(beside, lambda k: F.floor(F.col(lon) / _wide(F.col("cell_row"), cell)) + k)))


def distance_to(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Metres from a point to the nearest edge of an object's box; 0 within it."""
    clamp = lambda v, low, high: F.least(F.greatest(v, low), high)
    return distance(lat, lon, clamp(lat, south, north), clamp(lon, west, east))


def scope_box(box: tuple[float, float, float, float], reach_m: float = 220.0) -> tuple[float, float, float, float]:
    """An area's south, west, north and east, wider by what a match reaches beyond its edge; degrees of longitude by half more."""
    south, west, north, east = box
    margin = reach_m / 110_000
    return tuple(round(x, 6) for x in (south - margin, west - margin * 1.5, north + margin, east + margin * 1.5))


def box_km2(box: tuple[float, float, float, float]) -> float:
    """About how many square kilometres a box of south, west, north and east has."""
    south, west, north, east = box
    return (north - south) * 111.32 * (east - west) * 111.32 * math.cos(math.radians((south + north) / 2))
