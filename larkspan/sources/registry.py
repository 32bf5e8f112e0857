"""Reading registers: delimiters, columns that change, rows by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_value, short_hash


def sniff_delimiter(head: str) -> str:
    """Comma, or semicolon if the header has strictly more of them."""
    line = head.splitlines()[0] if head else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_csv(spark: SparkSession, path: str, quoted_lines: bool = False) -> DataFrame:
    """A register's rows as text columns, with _bad: the line of a row that did not parse. A byte order mark is dropped.

    With `quoted_lines` values may have line ends in quotes; then a file is read by one task, as it cannot be split.
    """
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0].lstrip("﻿") if head else ""
    sep = sniff_delimiter(first)
    names = [n.strip().strip('"') for n in first.split(sep)] if first else []
    schema = ", ".join(f"`{n}` string" for n in [*names, "_bad"])
    return spark.read.schema(schema).csv(path, header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", escape='"', enforceSchema=True, multiLine=quoted_lines)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def rename_columns(df: DataFrame, inputs: Mapping[str, Sequence[str]]) -> DataFrame:
    """The declared inputs, each the first value that is not blank among its columns; columns that are missing count as blank."""
    return df.select(*[first_value(*[F.col(f"`{c}`").cast("string") for c in names if c in df.columns]).alias(i) if any(c in df.columns for c in names) else F.lit("").alias(i) for i, names in inputs.items()])


def late_columns(df: DataFrame, known: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns not known before, and known ones that are missing."""
    return [c for c in df.columns if c not in known], [c for c in known if c not in df.columns]


def with_key(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Add key: the first id that is not blank, else h: and a hash of the row."""
    own = F.nullif(first_value(*[F.col(c).cast("string") for c in ids]), F.lit("")) if ids else F.lit(None).cast("string")
    return df.withColumn("key", F.coalesce(own, F.concat(F.lit("h:"), short_hash(F.to_json(F.struct(*df.columns))))))


def group_rows(df: DataFrame, key: str, position: str) -> DataFrame:
    """key, n, rows (array of structs in the order of `position`). A record's rows are few: one register entry's lines."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(position, *[c for c in df.columns if c not in (key, position)]))).alias("rows"))
