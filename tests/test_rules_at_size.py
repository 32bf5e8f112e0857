"""Cases that only larger tables have, each query against its SQL."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from larkspan.functions import values

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string", "benchmark": "item_id long, text string",
}


def both(spark, folder, name, tables):
    """The query's rows and the SQL's, sorted, over tables of rows."""
    con = duckdb.connect()
    for t, rows in tables.items():
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, COLUMNS[t])
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = __spark_entry__.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(str(list(r)) for r in got), sorted(str([r[i] for i in order]) for r in want.fetchall())


def line(order, part, supplier, number, quantity, discount=0.0, tax=0.02, day=(1998, 1, 1)):
    return order, part, supplier, number, float(quantity), 1000.0, discount, tax, "N", "O", datetime.datetime(*day)


def test_a_distance_is_rounded_by_its_exact_value(spark, tmp_path):
    rows = spark.createDataFrame([(3149.9999999999995,), (3150.0,), (5250.0,), (1049.0,), (1999.0,), (9950.0,)], "d double")
    assert [r[0] for r in rows.select(values.metres_label(F.col("d"))).collect()] == ["3.1 km", "3.1 km", "5.3 km", "1.0 km", "2.0 km", "9.9 km"]
    got, want = both(spark, tmp_path, "number_forms", {"customer": [(k, "", 0, 0.0, "") for k in (4500, 6500, 7500, 13500, 17500)]})
    assert got == want


def test_a_position_of_two_zeros_is_none(spark, tmp_path):
    got, want = both(spark, tmp_path, "positions", {"customer": [(k, "", 0, 0.0, "") for k in (97, 9999, 10000, 10001, 20000)]})
    assert got == want


def test_quotes_in_other_case_and_white_space(spark, tmp_path):
    docs = [(1, "Before it A Quick  brown FOX jumps\nover all"), (2, "it a quick brown fox jumps over all"), (3, "a quick brown"), (4, None), (5, "x  a quick\nbrown fox jumps")]
    got, want = both(spark, tmp_path, "quote_evidence", {"documents": docs, "benchmark": [(7, "a quick brown fox jumps"), (8, "a (quick) [brown"), (9, "  ")]})
    assert got == want and len(got) == 3


def test_of_two_declarations_of_one_day_the_first_names_the_connectors(spark, tmp_path):
    silent = line(0, 2, 8, 1, 4, day=(1999, 1, 1))
    got, want = both(spark, tmp_path, "station_sockets", {"lineitem": [silent, line(0, 2, 8, 2, 3, day=(1995, 1, 1)), line(0, 2, 8, 3, 3, day=(1995, 1, 1))]})
    assert got == want and "socket:type2=1" in got[0]


def test_points_of_far_sites_have_numbers_of_their_own(spark, tmp_path):
    got, want = both(spark, tmp_path, "declaration_history", {"lineitem": [line(o, p, s, 1 + p % 3, 3) for o in (400_000, 4_000_000, 4_000_003) for p, s in ((2, 6), (1, 7), (3, 12), (4, 9))]})
    assert got == want


def test_unlisted_kin_asks_every_record_with_an_id(spark):
    got = {r["key"] for r in __spark_entry__.queries()["unlisted_kin"](spark, "/root/testdata/sf0.01").collect()}
    assert {k % 8 for k in got} == {1, 3, 5, 7}
