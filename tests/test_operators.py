"""Small cases of the operators, worked out by hand, and each registered query against its SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from torqueline import answer_queries, candidate_queries, page_queries, queries, section_queries, source_queries, stream_queries, text_queries  # noqa: F401  each adds its queries
from torqueline.operators import evaluation, graph, knowledge, lifecycle, retrieval, usage
from torqueline.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.8g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, SF)
    theirs = duck.sql(queries.SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    a = sorted(repr(plain(tuple(r[c] for c in columns))) for r in ours.collect())
    assert a == sorted(repr(plain(tuple(r[i] for i in order))) for r in theirs.fetchall())


def test_fusion(spark):
    rows = [("q", "a", 1, "x", 0.9), ("q", "a", 2, "y", 0.8), ("q", "b", 1, "y", 0.7), ("q", "b", 5, "y", 0.7)]
    out = retrieval.fuse(spark.createDataFrame(rows, "query string, route string, rank int, doc string, relevance double")).orderBy("place").collect()
    assert [(r["doc"], r["relevance"], r["routes"]) for r in out] == [("y", 0.991935, "a,b"), ("x", 0.765, "a")]


def test_ranking_metrics(spark):
    runs = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "b"), ("q1", 3, "a"), ("q2", 1, "c"), ("q2", 2, "z"), ("q3", 1, "c")], "query string, rank int, doc string")
    qrels = spark.createDataFrame([("q1", "a", 3), ("q1", "b", 1), ("q2", "c", 2), ("q3", "c", 0)], "query string, doc string, grade int")
    mean = evaluation.mean_metrics(evaluation.ranking_metrics(runs, qrels, k=2)).first()
    gain = 0.6309297535714575
    assert (mean["queries"], mean["recall"], mean["mrr"]) == (2, 0.75, 0.75)
    assert mean["ndcg"] == pytest.approx((gain / (7 + gain) + 1) / 2, abs=1e-6)
    with pytest.raises(Exception, match="negative"):
        evaluation.ranking_metrics(runs, qrels.withColumn("grade", F.lit(-1))).collect()


def test_dwell(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [("s", 1, 7, at + dt.timedelta(seconds=s)) for s in (0, 20, 70, 90, 500)]
    out = usage.dwell(spark.createDataFrame(rows, "session_id string, user_id long, manual_id long, ts timestamp"))
    assert [r["seconds"] for r in out.orderBy("ts").collect()] == [0, 20, 30, 20, 0]
    assert [(r["seconds"], r["counted"]) for r in usage.daily_reads(out).collect()] == [(70, True)]


def test_grading(spark):
    rows = [("multiple", "A,B", "B,a"), ("multiple", "A,B", "A"), ("single", "Yes", " yes "), ("single", "Yes", ""), ("multiple", "A", None)]
    out = usage.grade(spark.createDataFrame(rows, "kind string, expected string, given string")).collect()
    assert [r["correct"] for r in out] == [True, False, True, False, False]


def test_diff(spark):
    rows = lambda *r: spark.createDataFrame([(*x, i) for i, x in enumerate(r)], "uid string, text string, position int")
    out = lifecycle.diff(rows(("A", "a"), ("B", "b")), rows(("B", "x"), ("C", "c"), ("C", "d"))).collect()
    assert {r["uid"]: r["change"] for r in out} == {"A": "deleted", "B": "modified", "C": "added"}


WRITE = "user long, name string, content string, status string, turn_ts long, source string, arrival long"


def test_arbitration(spark):
    rows = [
        (1, "new turn", "old", "active", 1, "agent_explicit", 1), (1, "new turn", "new", "active", 2, "capture_fallback", 2),
        (1, "tie", "agent", "active", 1, "agent_explicit", 1), (1, "tie", "fallback", "active", 1, "capture_fallback", 2),
        (1, "gone", "x", "deleted", 1, "agent_explicit", 1), (1, "gone", "y", "active", 2, "consolidation", 2),
        (1, "back", "x", "deleted", 1, "agent_explicit", 1), (1, "back", "y", "active", 2, "agent_explicit", 2),
        (1, "null turn", "x", "active", None, None, 9), (1, "null turn", "y", "active", 0, "capture_fallback", 1),
    ]
    out = {r["name"]: (r["content"], r["status"]) for r in lifecycle.arbitrate(spark.createDataFrame(rows, WRITE)).collect()}
    assert out == {"new turn": ("new", "active"), "tie": ("agent", "active"), "gone": ("x", "deleted"), "back": ("y", "active"), "null turn": ("y", "active")}


def test_recall_rounds_stop_at_a_malformed_segment(spark):
    facts = spark.createDataFrame([("f", 1, "3-5,9"), ("g", 1, "1,x,4"), ("h", 1, None)], "fact string, session long, ranges string")
    messages = spark.createDataFrame([(1, n, n) for n in range(1, 11)], "session long, round long, id long")
    out = lifecycle.recall_rounds(facts, messages).orderBy("fact", "round").collect()
    assert [(r["fact"], r["round"]) for r in out] == [("f", 3), ("f", 4), ("f", 5), ("f", 9), ("g", 1)]


def test_removal_keeps_nodes_near_verified_ones(spark):
    nodes = spark.createDataFrame([(i, [1], i == 4, None) for i in range(6)] + [(9, [1, 2], False, None)], "id long, manuals array<int>, verified boolean, task long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {r["id"] for r in graph.removable(nodes, edges, 1).collect()} == {0, 5}


def test_mcnemar_and_bootstrap(spark):
    pairs = [(True, False)] * 2 + [(False, True)] + [(True, True)] * 7
    both = spark.createDataFrame([("both", a, b) for a, b in pairs], "side string, base_passed boolean, cand_passed boolean")
    assert tuple(evaluation.mcnemar(both).first()) == (2, 1, 1.0)
    deltas = spark.createDataFrame([(float(b) - float(a),) for a, b in pairs], "delta double")
    out = evaluation.bootstrap(deltas).first()
    assert out["pairs"] == 10 and out["mean"] == -0.1 and out["low"] == pytest.approx(-0.4, abs=0.11) and out["high"] == pytest.approx(0.2, abs=0.11)


def test_order_of_input_does_not_matter(spark):
    for name in ("k3_rrf", "w9_arbitrate", "l4_merge_nodes"):
        once = queries.QUERIES[name](spark, SF).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = queries.QUERIES[name](spark, SF).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted(map(repr, once)) == sorted(map(repr, again))


def test_streams(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [("m1", at), ("m1", at + dt.timedelta(hours=1)), (None, at), (None, at), ("", at), ("m2", at)]
    spark.createDataFrame(rows, "message_id string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("message_id string, ts timestamp").parquet(f"{tmp_path}/in")
    q = jobs.consume_once(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] or "" for r in spark.table("once").select("message_id").collect()) == ["", "", "", "m1", "m2"]


def test_toc_paths(spark):
    rows = [("d", 0, 1, "A"), ("d", 1, 2, "A1"), ("d", 2, 3, "A1x"), ("d", 3, 2, "A2"), ("d", 4, 1, "B"), ("d", 5, 3, "Bx"), ("d", 6, 3, " "), ("e", 0, 2, "C")]
    out = knowledge.toc_paths(spark.createDataFrame(rows, "document string, pos int, level int, title string")).orderBy("document", "pos").collect()
    assert ["/".join(r["path"]) for r in out] == ["A", "A/A1", "A/A1/A1x", "A/A2", "B", "B/Bx", "C"]
    deep = spark.createDataFrame([("d", 0, 9, "A")], "document string, pos int, level int, title string")
    with pytest.raises(Exception, match="no such level"):
        knowledge.toc_paths(deep).collect()


def test_match_procedure(spark):
    devices = spark.createDataFrame([(1, "engine pump", "L1"), (2, "engine", "L2"), (3, " ", "L1"), (4, None, "L1"), (5, "valve", None)], "device int, name string, level string")
    rows = [(1, "pump", "L1", 1, "PUBLISHED"), (2, "engine", None, 3, "PUBLISHED"), (3, "engine", "", 2, "PUBLISHED"), (4, "engine", "L2", 9, "DRAFT"), (5, " ", None, 9, "PUBLISHED")]
    procedures = spark.createDataFrame(rows, "procedure int, type string, level string, version int, status string")
    out = knowledge.match_procedure(devices, procedures).orderBy("device").collect()
    assert [tuple(r) for r in out] == [(1, 1, True), (2, 2, False)]
    assert knowledge.match_procedure(devices, procedures.limit(0)).count() == 0


def test_records_history_and_tasks(spark):
    rows = [("d", "step", 1, "a", None, 3), ("d", "step_raw", 2, "a", None, None), ("d", "text", 3, "", "b", 1), ("d", "text", 4, None, "", 1), ("d", "text", 5, " ", None, 2)]
    records = spark.createDataFrame(rows, "document string, chunk_type string, seq int, source_chunk_id string, chunk_uid string, page int")
    out = knowledge.dedupe_records(records, ["source_chunk_id", "chunk_uid"], ["document", "page"], ["page"]).orderBy("place").collect()
    assert [r["seq"] for r in out] == [4, 3, 5, 2]
    steps = spark.createDataFrame([(1, "COMPLETED"), (1, "SKIPPED"), (2, "COMPLETED"), (2, None)], "task int, status string")
    assert [tuple(r) for r in knowledge.promote_tasks(steps).collect()] == [(1, 2, 1, "DRAFT")]
    tasks = spark.createDataFrame([("u", i, i) for i in range(8)], "user string, id int, at int")
    out = knowledge.history(tasks, tasks).orderBy("place").collect()
    assert [(r["kind"], r["id"]) for r in out][6:] == [("maintenance_task", 1), ("maintenance_task", 0), ("approved_case", 7), ("approved_case", 6)]
