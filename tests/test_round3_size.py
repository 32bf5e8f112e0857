"""What a larger table must not make slower than it is larger: costly expressions are worked out once for what is alike."""

from pyspark.sql import functions as F

from larkspan import steps
from larkspan.operators import declare
from larkspan.plans import register_queries, station_queries

DIR = "/root/testdata/sf0.001"


def test_what_is_alike_is_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, t string").repartition(3)
    got = {r["id"]: r["x"] for r in steps.worked_once(rows, ["t"], {"x": F.concat(F.coalesce("t", F.lit("none")), F.uuid())}).collect()}
    assert len(got) == 5 and got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3 and got[3].startswith("none")


def test_hours_are_read_once_a_text_and_before_the_rest(spark):
    said = spark.createDataFrame([(1, 0, "opening_hours", "Mo 08:00-09:00", 0.9, "Open", "Open"), (2, 0, "opening_hours", "Mo 08:00-09:00", 0.9, "Open", "Open")], "page int, position int, k string, v string, conf double, quote string, text string")
    for df in (register_queries.opening_weeks(spark, DIR), declare.vetted_tags(said, [], 0.5)):
        assert "[0-9]{2}:[0-9]{2}" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in declare.vetted_tags(said, [], 0.5).orderBy("page").collect()] == [(p, 0, "opening_hours", "Mo 08:00-09:00", 0.9) for p in (1, 2)]


def test_numbers_are_read_once_a_text(spark):
    assert "[1-9][0-9]{8}" not in station_queries.station_access(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
