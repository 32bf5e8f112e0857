"""What a small file's rows cost is worked out on all cores, and once."""

from pyspark.sql import functions as F

from larkspan.functions import registers
from larkspan.operators import addresses, plan, stations
from larkspan.plans import register_queries, station_queries, tag_queries
from test_rules_at_size import both, line

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_compared_on_all_cores_and_once(spark):
    assert tag_queries._customers(spark, DIR).rdd.getNumPartitions() >= 4
    summed = _plan(tag_queries.same_values(spark, DIR)).splitlines()[0]
    assert summed.startswith("Aggregate") and "regexp_replace" not in summed


def test_mailboxes_are_read_on_all_cores(spark):
    assert "RepartitionByExpression" in _plan(register_queries.private_mailboxes(spark, DIR))


def test_mailboxes_without_a_name_or_place_are_held_against_roles_and_the_domain(spark):
    rows = spark.createDataFrame([("ac.xy@ac-lyon.fr", None, None), ("direction.nord@ac-lyon.fr", None, None), ("maubert@ecole.fr", "Ecole Maubert", None), ("maubert@ecole.fr", None, "Haute"), ("martin@martin.fr", None, None), (None, "a", "b"), ("jo.ab@x.fr", "jo", None)], "mail string, name string, place string")
    got = [r[0] for r in rows.select(registers.withheld_mailbox(F.col("mail"), F.col("name"), F.col("place"))).collect()]
    assert got == [True, False, False, True, False, False, False]


def test_a_plan_compares_values_once_for_all_its_readers(spark):
    made = _plan(plan.update_ops(tag_queries._proposed(spark, DIR), tag_queries._tagged(spark, DIR), tag_queries.MAIN))
    assert "regexp_replace(v" not in made and "regexp_replace(held" not in made


def test_objects_and_their_new_tags_are_made_once(spark):
    assert "map_from_entries" not in _plan(tag_queries.plan_effects(spark, DIR))


def test_declarations_are_read_once_for_their_stations(spark, monkeypatch):
    made, inner = [], stations.checkpointed
    monkeypatch.setattr(stations, "checkpointed", lambda df: made.append(_plan(df)) or inner(df))
    station_queries.current_stations(spark, DIR)
    assert made[0].count("Relation [") == 1


def test_address_lines_are_scored_by_words_that_are_compared_once_a_place(spark):
    base = spark.createDataFrame([(i, f"Rue Docteur {w}", "2", "69001", "Lyon", None, 45.0, 4.0) for i, w in enumerate(("Calmette", "Calmet", "Roux"))], "id long, street string, housenumber string, postcode string, city string, old_city string, lat double, lon double")
    asked = spark.createDataFrame([(1, "2 Rue Dr Calmete 69001 Lyon"), (2, "2 Rue Docteur Rou 69001 Lyon"), (3, "2 Rue Docteur Roux 69002 Lyon"), (4, None)], "key long, line string")
    found = addresses.lookup(asked, base)
    assert {r["key"]: r["id"] for r in found.collect()} == {1: 0, 2: 0, 3: 2}
    # Only streets of the best rows are compared word by word.
    q = asked.filter("key = 1")
    answer = addresses._asked(q, addresses.prepared_base(base).withColumns({"theirs": F.array_distinct(F.concat("words", "city_words")), "places": F.array_distinct(F.concat(F.array("postcode"), "place")), "ends": addresses._blocks(F.col("words"))}))
    scored = answer._jdf.queryExecution().optimizedPlan().toString()
    assert not any("levenshtein" in line for line in scored.splitlines() if "theirs" in line)


def test_declarations_of_a_point_meet_once_and_make_no_pairs(spark, tmp_path):
    rows = [line(o, p, s, 1 + n % 3, 3, day=(1990 + n % 9, 1, 1)) for n, (o, p, s) in enumerate([(8, 2 + 10 * i, 6) for i in range(60)] + [(9, 1, 7), (9, 3, 12), (9, 4, 9), (10, 7, 8)])]
    got, want = both(spark, tmp_path, "declaration_history", {"lineitem": rows})
    assert got == want and len(got) == 64
    assert "Join" not in station_queries.declaration_history(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
