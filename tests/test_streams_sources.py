"""Pages by area and streams with state of their own."""

import pytest
from pyspark.sql import functions as F

from larkspan.sources import paged
from larkspan.streaming import attempts, keyed_state


def test_what_to_ask_an_api():
    assert paged.dataset_base("https://x.org/api/datasets/a/records?x=1#y") == "https://x.org/api/datasets/a" == paged.dataset_base("https://x.org/api/datasets/a/exports/jsonl/")
    assert paged.where_clause("geo", paged.Area((43.5, 1.25), 500.0)) == "within_distance(geo, geom'POINT(1.25 43.5)', 500m)"
    assert paged.where_clause("geo", paged.Area(box=(43.0, 1.0, 44.0, 2.0))) == "in_bbox(geo, 43, 1, 44, 2)"
    assert paged.order_field(["id", "x"], "id") == "id" and paged.order_field(["x"], "id") is None and paged.order_field(["x"], None) is None


def test_only_an_areas_bands_are_read(spark, tmp_path, capfd):
    rows = spark.range(3000).select(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string")).alias("key"), (43.0 + F.col("id") / 1000.0).cast("string").alias("lat"), F.lit("1.5").alias("lon"), F.col("id").cast("string").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("none", None, "1", "x"), (None, "43.2", "1.5", "y"), (" ", "43.2", "1.5", "z"), ("skip", "43.2", "1.5", "w")], "key string, lat string, lon string, v string"))
    paged.land_pages(rows, "key", str(tmp_path / "pages"))
    area = paged.Area(box=(43.1, 1.0, 43.3, 2.0))
    found = paged.read_pages(spark, str(tmp_path / "pages"), rows.schema, area)
    assert sorted(r["v"] for r in found.collect()) == sorted([*(str(i) for i in range(100, 301)), "w", "y", "z"])
    found.explain()
    plan = capfd.readouterr().out
    assert "PartitionFilters: [isnotnull(band" in plan and ">= 862)" in plan
    files = {f.split("band=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}
    assert files and all(862 <= int(b) <= 866 for b in files)
    round_ = paged.read_pages(spark, str(tmp_path / "pages"), rows.schema, paged.Area((43.2, 1.5), 1200.0))
    assert sorted(r["v"] for r in round_.collect()) == sorted([*(str(i) for i in range(190, 211)), "w", "y", "z"])
    records, others, facts = paged.read_area(found, None, "key", skip="key = 'skip'")
    assert facts == {"fetched": 204, "skipped": 2, "not_places": 1, "export": 0} and records.count() == 201 and [r[0] for r in others.collect()] == ["skip"]
    again, _, facts = paged.read_area(found, rows.limit(0).unionByName(found.filter("v = '150'")), "key", ceiling=203)
    assert facts["export"] == 1 and facts["fetched"] == 1 and again.first()["n"] == 1
    pages = spark.read.json(str(tmp_path / "pages"))
    assert pages.select(F.max(F.size("results"))).first()[0] <= paged.PAGE and pages.groupBy("band").agg(F.sum(F.size("results")).alias("n"), F.max("total_count").alias("t")).filter("n <> t").isEmpty()


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_locks_agree_with_the_islands_at_exactly_the_pause(rocks, tmp_path):
    spark = rocks
    times = [(1, "00:00:00"), (1, "00:14:59.999999"), (1, "00:29:59.999999"), (1, "00:30:00"), (2, "00:00:00"), (2, "00:15:00"), (2, "00:29:00"), (3, "01:00:00"), *[(4, f"00:0{i}:00") for i in range(6)], (None, "00:00:00")]
    rows = spark.createDataFrame(times, "user_id long, at string").select("user_id", F.concat(F.lit("2024-01-01 "), "at").cast("timestamp").alias("ts"))
    for k in range(2):  # two batches, a user's island across both
        rows.filter(F.minute("ts") % 2 == 1 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(99, "2024-02-01 00:00:00")], "user_id long, at string").select("user_id", F.col("at").cast("timestamp").alias("ts"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["user_id"], r["first"], r["n"], r["locked"]) for r in run(spark, keyed_state.attempt_locks(read(), "3 hours"), tmp_path, "locks").collect())
    want = sorted((r["user_id"], r["first"], r["n"], r["locked"]) for r in attempts.attempt_islands(rows.filter("user_id is not null").withColumn("event_id", F.lit(1))).collect())
    assert got == want and (4, 6, True) in [(a, c, d) for a, _, c, d in got] and [c for a, _, c, _ in got if a == 2] == [1, 2]


def test_a_latched_notice_and_answers_that_expire(rocks, tmp_path):
    spark = rocks
    rows = spark.createDataFrame([("q", f"2024-01-01 00:{i:02d}:00", n) for i, n in enumerate([10, 250, 300, 249, 251, 251, 0, 250])] + [("r", "2024-01-01 00:00:00", 400), (None, "2024-01-01 00:00:00", 400)], "queue string, at string, pending int")
    rows = rows.select("queue", F.col("at").cast("timestamp").alias("ts"), "pending")
    rows.write.parquet(str(tmp_path / "queue"))
    found = run(spark, keyed_state.queue_alerts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "queue"))), tmp_path, "alerts")
    assert sorted((r["queue"], r["ts"].minute, r["pending"]) for r in found.collect()) == [("q", 1, 250), ("q", 4, 251), ("q", 7, 250), ("r", 0, 400)]
    asked = rows.select(F.col("queue").alias("question"), "ts")
    asked.write.parquet(str(tmp_path / "asked"))
    found = run(spark, keyed_state.to_ask(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), 180), tmp_path, "ask")
    assert sorted((r["question"], r["ts"].minute) for r in found.collect()) == [("q", 0), ("q", 3), ("q", 6), ("r", 0)]
