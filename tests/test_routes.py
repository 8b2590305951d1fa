"""A route that fails, when it is made or when it runs, leaves the others' hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import routing


def test_failing_routes_cost_their_own_hits_only(spark):
    plans = spark.createDataFrame([(1, "sub1", "good", "a"), (1, "sub2", "late", "b"), (2, "sub1", "good", "c"), (2, "sub1", "early", "d")], "query_id long, sub string, route string, q string")

    def good(q):
        return q.select("query_id", F.col("q").alias("pk"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def late(q):
        return good(q).withColumn("pk", F.raise_error(F.lit("lost")).cast("string"))

    def early(q):
        raise ValueError("no such place")

    hits, outcomes = routing.dispatched(plans, {"late": late, "early": early, "good": good, "unused": good})
    assert sorted(map(tuple, hits.collect())) == [(1, "sub1", "good", "a", 1.0, 1), (2, "sub1", "good", "c", 1.0, 1)]
    rows = {r["route"]: r for r in outcomes.collect()}
    assert rows["good"]["error"] is None and (rows["good"]["asked"], rows["good"]["hits"]) == (2, 2)
    assert rows["early"]["error"] == "ValueError: no such place" and rows["early"]["hits"] == 0
    assert rows["late"]["error"] and rows["late"]["asked"] == 1
    assert tuple(rows["unused"]) == ("unused", 0, 0, None)
    none, outcomes = routing.dispatched(plans, {"early": early})
    assert none.count() == 0 and outcomes.count() == 1
