"""Contexts, model answers, plans, sinks and streams against plain Python and known results."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import answers
from corpuscle.operators import retrieval
from corpuscle.plans import q_harness
from corpuscle.plans.queries import QUERIES
from corpuscle.sources import sinks
from corpuscle.streaming import streams


def line(rank, h):
    head = [f"[{rank}] {h['type'].upper()}", f"chunk_id={h['pk']}", f"doc={h['doc_id']}"] + ([f"section={h['section']}"] if h["section"] else []) + [f"page={h['page_start'] + 1}", f"para={h['paragraph_index']}", f"year={h['publication_year']}"]
    return "\n".join([" | ".join(head), h["content"]] + (["[Related Section Context]\n" + h["context"]] if h["type"] in ("image", "table") and h["context"] else []))


def test_contexts_within_budgets(spark, tiny):
    hits: dict = {}
    for h in q_harness.route_hits(spark, tiny).collect():
        hits.setdefault(h["query_id"], {}).setdefault(h["route"], []).append(h)
    got = {r["query_id"]: r for r in QUERIES["route_context"](spark, tiny).collect()}
    assert set(got) == set(hits)
    pointers = 0
    for q, routes in hits.items():
        text, shown, cut = f"# Query\nWhat is in {q}", {}, False
        for route in q_harness.ROUTES:
            head, lines = f"# From [{route}]", []
            if len(text) >= 24_000:
                cut = True
                continue
            used, fresh = len(head), {}
            for h in sorted(routes.get(route, []), key=lambda h: (h["rank"], h["pk"])):
                own = f"[{h['rank']}] (shown as {shown[h['pk']]}, chunk_id={h['pk']})" if h["pk"] in shown else line(h["rank"], h)
                if used + len(own) + 2 > min(10_000, 24_000 - len(text)):
                    cut = True
                    break
                pointers += h["pk"] in shown
                lines.append(own)
                used += len(own) + 2
                fresh.setdefault(h["pk"], f"[{route}] #{h['rank']}")
            shown = fresh | shown
            text += "\n\n---\n\n" + head + "\n\n" + ("\n\n".join(lines) or "*(nothing found)*")
        assert (got[q]["context"], got[q]["cut"]) == (text, cut)
    assert any(r["cut"] for r in got.values()) and pointers >= 0


def test_calls_and_lists_in_answers(spark, tiny):
    got = {r["id"]: (r["source"], r["calls"]) for r in QUERIES["tool_calls"](spark, tiny).collect()}
    assert got == {
        1: ("tool_call_block", 'plan:{"a":1};ask:{}'), 2: ("tool_call_block", 'reuse:{"m": 2}'), 3: ("tool_call_block", "plan:{}"), 4: ("json_fence", 'multi:{"x":[1]}'), 5: ("bare_json", "ok:{}"),
        6: ("empty", ""), 7: ("empty", ""), 8: ("empty", ""), 9: ("empty", ""),
    }
    assert {r["id"]: r["ids"] for r in QUERIES["json_lists"](spark, tiny).collect()}[9] == "text_1,image_2"


def test_plans_and_when_they_split(spark, tiny):
    got = {r["id"]: (r["routes"], r["rewrites"], r["chunk_type"], r["time"], r["split"]) for r in QUERIES["plan_decisions"](spark, tiny).collect()}
    assert got == {
        0: ("progressive,metadata", "progressive=rust salt", None, "2010-2014", False), 1: ("metadata", "", None, "", True), 2: ("local,metadata", "local=x", "references", "", True),
        3: ("summary", "summary=all", None, "", False), 4: ("", "", None, "", False), 5: ("progressive,metadata,local", "", "table", "", True),
    }


def test_settings_are_laid_over_and_filled(monkeypatch):
    monkeypatch.setenv("OWN_NAME", "x")
    base = {"a": {"b": 1, "c": "${OWN_NAME}/y"}, "l": ["${NOT_THERE:-d}"], "k": 1}
    assert answers.merged_settings(base, {"a": {"b": {"deep": 2}}, "k": {"now": "a map"}}) == {"a": {"b": {"deep": 2}, "c": "x/y"}, "l": ["d"], "k": {"now": "a map"}}


def test_a_sink_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), i) for i in range(6)], "doc_id string, n int")
    path = str(tmp_path / "out")
    assert sinks.append_pending(rows.where("n < 2"), path, "doc_id") == 2
    assert sinks.append_pending(rows, path, "doc_id") == 4
    assert sinks.append_pending(rows, path, "doc_id") == 0
    assert sorted(r["n"] for r in spark.read.json(path).collect()) == [*range(6)]
    for kind in ("csv", "json"):
        sinks.write_report(rows, str(tmp_path / kind), kind)
        assert len([*(tmp_path / kind).glob(f"part-*.{kind}")]) == 1


def test_the_newest_layout(spark, tmp_path):
    assert sinks.newest(spark, str(tmp_path)) is None
    for i, name in enumerate(("a/x_content_list_v2.json", "b/content_list_v2.json", "b/y_content_list_v2.json", "c/other.json")):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(json.dumps([[i]]))
        stamp = time.time() - 1000 + 10 * (i if i != 1 else 5)
        __import__("os").utime(file, (stamp, stamp))
    assert sinks.newest(spark, str(tmp_path)).endswith("b/content_list_v2.json")
    assert {r["doc_id"]: r["layout"] for r in sinks.layouts(spark, str(tmp_path)).collect()} == {"a": "[[0]]", "b": "[[1]]"}


def test_texts_without_a_cached_vector(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "two")], "pk string, text string")
    cache = spark.createDataFrame([("one", [1.0])], "t string, embedding array<double>").select(F.sha2(F.col("t").cast("binary"), 256).alias("digest"), "embedding")
    known, missing = sinks.uncached(texts, cache)
    assert [r["pk"] for r in known.collect()] == ["a"] and [r["text"] for r in missing.collect()] == ["two"]


def test_where_the_table_is():
    assert sinks.location({"path": "/x", "table": "t"}) == ("folder", "/x")
    assert sinks.location({"table": "t"}) == ("table", "t")
    assert sinks.location({"uri": "./lite.db"}) == ("folder", "./lite.db")
    assert sinks.location({"uri": "http://host:1/base"}) == ("table", "base")
    assert sinks.location({}) == ("table", "chunks")


def test_dense_search_in_blocks_is_the_same(spark, tiny, monkeypatch):
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet")
    queries = vectors.where("vec_id < 60").selectExpr("vec_id AS query_id", "embedding AS q_vec")
    expected = sorted(map(tuple, retrieval.dense(queries, vectors, 7, "vec_id").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 128)
    assert sorted(map(tuple, retrieval.dense(queries, vectors, 7, "vec_id").collect())) == expected
    assert retrieval.dense(queries.where("false"), vectors, 7, "vec_id").count() == 0


@pytest.fixture
def event_stream(spark, tiny, tmp_path):
    """The events by file, to be read as a stream."""
    spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    return lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "events")).schema).parquet(str(tmp_path / "events"))


def run(stream, name, spark, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_sessions_of_a_stream(spark, tiny, event_stream, tmp_path):
    got = run(streams.session_counts(event_stream(), "user_id", "2 hours", "1 day"), "own_sessions", spark, "complete", tmp_path)
    batch = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == sorted((r["user_id"], r["n"]) for r in batch.collect())


def test_first_rows_of_a_stream(spark, tiny, event_stream, tmp_path):
    got = run(streams.first_seen(event_stream(), "user_id", "3650 days"), "own_first", spark, "append", tmp_path)
    assert got.count() == spark.read.parquet(f"{tiny}/events.parquet").select("user_id").distinct().count()


def expected_tails(rows, most, idle=None):
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[0], r[1], r[2] or ""))
        for i in range(len(own) - 1, 0, -1):
            if idle is not None and own[i][0] - own[i - 1][0] > idle * 1_000_000:
                own = own[i:]
                break
        if own:
            out[k] = own[-most:]
    return out


@pytest.mark.parametrize("idle", [None, 100])
def test_tails_over_many_batches(spark, tmp_path, idle):
    s = 1_000_000
    batches = [
        [("a", 10 * s, 1, "x"), ("a", 20 * s, 2, None), ("a", 20 * s, 2, "y"), ("b", 5 * s, 3, "x"), (None, 7 * s, 4, "n"), ("a", None, 5, "no time")],
        [("a", 150 * s, 6, "x"), ("a", 5 * s, 7, "late"), ("b", 50 * s, 8, "x"), ("b", 30 * s, 9, "late")],
        [("a", 90 * s, 10, "between"), ("b", 170 * s, 11, "after a pause")] + [("c", (100 + i) * s, 100 + i, "many") for i in range(50)],
    ]
    schema = "k string, t long, event_id long, event_type string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("t"))
    with streams.with_state(spark):
        query = streams.keep_up(streams.tail(stream.withWatermark("ts", "1 hour"), "k", 3, idle), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    rows = streams.current(spark, str(tmp_path / "out"), "k string, slot int, t long, event_id long, event_type string", ["k", "slot"]).where("t IS NOT NULL").orderBy("slot").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["k"], []).append((r["t"], r["event_id"], r["event_type"]))
    assert got == expected_tails(sum(batches, []), 3, idle)
    held = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    assert held <= len(got) * (3 + 8)  # lists of three, their lengths, slots shown, timers: not one for each row


def test_idle_tails_go(spark, tmp_path):
    s = 1_000_000
    schema = "k string, t long, event_id long, event_type string"
    for rows in ([("a", 10 * s, 1, "x"), ("a", 20 * s, 2, "x")], [("b", 10_000 * s, 3, "x")], [("b", 10_001 * s, 4, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("t"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with streams.with_state(spark):
        streams.keep_up(streams.tail(stream.withWatermark("ts", "60 seconds"), "k", 3, 100), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    rows = streams.current(spark, str(tmp_path / "out"), "k string, slot int, t long, event_id long, event_type string", ["k", "slot"]).collect()
    assert sorted((r["k"], r["slot"], r["event_id"]) for r in rows if r["t"] is not None) == [("b", 0, 3), ("b", 1, 4)]
    assert sorted((r["k"], r["slot"]) for r in rows if r["t"] is None) == [("a", 0), ("a", 1)]


def test_sidecars_and_what_they_leave_open(spark):
    from corpuscle.sources import chunks as store

    files = spark.createDataFrame([("/kb/a/one_vec.json",), ("/kb/b/two_vectors.json",), ("/kb/c/three_embedded.json",), ("/kb/d/four.json",)], "path string")
    kind = "path string, doc_name string, publication_year int"
    sidecars = spark.createDataFrame([("/kb/a/one_meta.json", "One", 2011), ("/kb/c/three_meta.json", "Three", None), ("/kb/x/none_meta.json", "None", 2000)], kind)
    got = sorted((r["path"][4], r["doc_name"], r["publication_year"]) for r in store.with_sidecars(files, sidecars).collect())
    assert got == [("a", "One", 2011), ("b", None, None), ("c", "Three", None), ("d", None, None)]
    fresh = spark.createDataFrame([("/kb/a/one_meta.json", None, 2012), ("/kb/n/new_meta.json", "New", 2020)], kind)
    merged = store.merge_sidecar(sidecars, fresh, "path", ["doc_name", "publication_year"]).collect()
    assert sorted((r["path"][4], r["doc_name"], r["publication_year"]) for r in merged) == [("a", "One", 2012), ("c", "Three", None), ("n", "New", 2020), ("x", "None", 2000)]
    meta = [
        ("/kb/smith_1999/content_vec.json", "", None, 0, "Published 2003"), ("/kb/x/deep_steel_vec.json", None, "Deep Steel", 2015, "no year"),
        ("/kb/y/plain.json", "Given", "Side", 0, "in 2021 and 1980"), ("/kb/z/nothing.json", None, " ", 0, "none"),
    ]
    rows = store.infer_meta(spark.createDataFrame(meta, "path string, explicit_name string, sidecar_name string, explicit_year int, content string")).orderBy("path").collect()
    assert [(r["doc_name"], r["publication_year"]) for r in rows] == [("smith_1999", 1999), ("Deep Steel", 2015), ("Given", 2021), ("nothing", 0)]
