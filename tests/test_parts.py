"""Parts of operators by worked cases."""

import datetime as dt

from pyspark.sql import functions as F

from torqueline.operators import answers, candidates, chunking, evaluation, graph, lifecycle, retrieval, usage


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_quiz_sessions_and_activities(spark):
    questions = spark.createDataFrame([(1, "multiple", "A,B", "b, a"), (1, "single", "A", "a"), (1, "single", "A", ""), (2, "single", "A", "A")], "session int, kind string, expected string, given string")
    sessions = spark.createDataFrame([(1, "READY"), (2, "SUBMITTED"), (3, "READY")], "session int, status string")
    assert sorted(rows_of(usage.session_scores(questions, sessions))) == [(1, 2, 3), (3, 0, 0)]
    logs = spark.createDataFrame([(i, None if i % 2 else "u", "a", "s", i // 2) for i in range(120)], "id int, user string, action string, status string, at int")
    assert rows_of(usage.recent_activities(logs, 2)) == [(119, "system", "a", "s", 59), (118, "u", "a", "s", 59)]
    assert usage.recent_activities(logs, 0).count() == 1 and usage.recent_activities(logs, 999).count() == 50


def test_messages_that_wait_and_go(spark):
    rows = [(1, 1, 2, 5, None), (1, 1, 1, 9, False), (1, 1, 1, 8, True), (2, 1, 1, 1, False)]
    out = lifecycle.unconsolidated(spark.createDataFrame(rows, "session int, user int, round int, id int, consolidated boolean"))
    assert sorted(rows_of(out.select("session", "id", "place"))) == [(1, 5, 2), (1, 9, 1), (2, 1, 1)]
    now = dt.datetime(2025, 1, 10)
    handled = spark.createDataFrame([("a", now - dt.timedelta(days=8)), ("b", now - dt.timedelta(days=7)), ("c", None)], "message_id string, handled_at timestamp")
    assert sorted(r[0] for r in rows_of(lifecycle.purge_handled(handled, F.lit(now)))) == ["b", "c"]


def test_chapters_keep_the_first_hit(spark):
    rows = [("q", "d", None, 3, "h3", "t3"), ("q", "d", None, 1, "h1", "t1"), ("q", "e", "s", 2, "h2", None)]
    out = retrieval.chapters(spark.createDataFrame(rows, "query string, document string, section string, rank int, hit string, title string"), ("title",))
    assert sorted(rows_of(out), key=lambda r: r[-1]) == [("q", "d", "", 2, ["h1", "h3"], "t1", 1), ("q", "e", "s", 1, ["h2"], None, 2)]


def test_frozen_parts_give_nothing_away(spark):
    cases = spark.createDataFrame([("c1", "why?", "because", "easy", "a", "b", "c", "resolved")], "case_id string, query string, gold_answer string, difficulty string, author_id string, reviewer_a_id string, reviewer_b_id string, review_status string")
    parts = answers.frozen_parts(cases)
    assert parts["questions"].columns == ["case_id", "query"] and rows_of(parts["gold"]) == [("c1", "because")]
    assert rows_of(parts["qrels"]) == [("c1", None)] and rows_of(parts["review_signoff"]) == [("c1", "a", "b", "c", "resolved")] and parts["scoring_cases"].columns == cases.columns


def test_picture_counts_and_steps(spark):
    rows = [(["i1", "i2"], [1], [9], ["i1", "i3"], [9], 1, 1), (None, [1, 2], None, ["x"], [2], None, None), ([], [], [], [], [], 1, None), ([], [4], [], [], [], None, 0)]
    df = spark.createDataFrame(rows, "ei array<string>, ep array<int>, fb array<int>, i array<string>, p array<int>, lo int, hi int")
    out = df.select(answers.picture_counts(*map(F.col, df.columns)).alias("c")).select("c.*")
    assert rows_of(out) == [(0.5, 0.5, False, False), (0.5, 1.0, True, True), (1.0, 1.0, False, True), (0.0, 0.0, True, True)]
    steps = spark.createDataFrame([([("拆下盖板", 3), ("装上", 4), (None, 3), ("装上", None)], "先拆下盖板", [3]), ([], "", [])], "s array<struct<step:string,page:int>>, a string, p array<int>")
    out = steps.select(answers.step_pictures(F.col("s"), F.col("a"), F.col("p")).alias("f")).collect()
    assert [[tuple(x) for x in r["f"]] for r in out] == [[("装上", 4, "step"), ("装上", 4, "page"), ("装上", None, "step")], []]


def test_case_totals_leave_out_what_does_not_apply(spark):
    rows = [("c", 2, "b", 5, 7, True, None), ("c", 1, "a", None, 1, False, None), ("c", 3, "", 4, None, None, None), ("d", 1, None, None, None, True, True)]
    out = evaluation.case_totals(spark.createDataFrame(rows, "case string, turn int, query string, latency int, tokens int, ok boolean, shown boolean"), ["latency", "tokens"], ["ok", "shown"])
    assert sorted(rows_of(out)) == [("c", 3, "a | b", 9, 8, False, None), ("d", 1, "", None, None, True, True)]


def test_triples_merge_and_scopes(spark):
    rows = [("k", 2, 1, ["c2", "c1"], 5, "late", "x"), ("k", 1, 2, None, 3, None, "y"), ("k", 3, 1, ["c3"], None, "later", None)]
    out = graph.merge_triples(spark.createDataFrame(rows, "key string, arrival int, manual int, chunks array<string>, page int, name string, unit string"), ["name", "unit"])
    assert rows_of(out) == [("k", "late", "y", [1, 2], ["c1", "c2", "c3"], 3, 5)]
    schema = "device string, component string, fault string, path string, component_document string, device_document string, fault_document string, component_section string, fault_section string, component_chunks array<string>, fault_chunks array<string>"
    paths = spark.createDataFrame([("d", "c", "f", "p1", None, "doc", "other", None, "s", ["u1"], ["u2"]), ("d", "c2", None, "p2", "doc2", "doc", None, "s", None, None, None)], schema)
    kept = lambda **lists: sorted(r["path"] for r in graph.in_scope(paths, lists).collect())
    assert kept() == ["p1", "p2"] and kept(documents=["doc"]) == ["p1"] and kept(sections=["s"]) == ["p1", "p2"] and kept(chunks=["u2"]) == ["p1"] and kept(faults=[]) == []
    assert kept(nodes=["d", "c2"]) == ["p2"] and kept(nodes=["d", "c"]) == [] and kept(devices=["d"], paths=["p1"]) == ["p1"]


def test_targets_and_fact_ids(spark):
    pairs = [("活塞环", "活塞 环", 1000), ("活塞环", "安装活塞环组件", 880), ("活环", "活塞环", 616), ("环活", "活塞环", 0), ("", "x", 0), ("a", "b", 0), (None, "x", 0)]
    df = spark.createDataFrame(pairs, "q string, c string, want int").select("want", candidates.target_similarity(F.col("q"), F.col("c")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    ids = spark.createDataFrame([("d", "漏油 更换。"), ("d", "|漏油更换；"), ("e", "漏油更换")], "d string, f string").select(chunking.fact_id(F.col("d"), F.col("f")).alias("i")).collect()
    assert ids[0] == ids[1] != ids[2]


def test_anchor_bonus_and_identity_heads(spark):
    pairs = [
        ("螺栓插入哪里", "将螺栓插入孔中", 0.60), ("垫片在哪", "垫片朝上", 0.22), ("油封朝外吗", "朝外", 0.10), ("飞轮上t标记对准", "飞轮上的t标记", 0.18), ("b孔位置", "b与孔", 0.12), ("无关", "螺栓", 0.0), ("插到底", "插在孔", 0.12)]
    df = spark.createDataFrame(pairs, "q string, c string, want double").select("q", "want", candidates.anchor_bonus(F.col("q"), F.col("c")).alias("got"))
    assert [(r["q"], r["got"]) for r in df.collect()] == [(q, w) for q, _, w in pairs]
    rows = [("雅马哈摩托车发动机", ["发动机"], "摩托车", "雅马哈", "", "发动机"), ("X1 Pump", None, "", "", "x1", "pump"), ("Pump", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, a array<string>, carrier string, maker string, model string, category string")
    out = df.select(candidates.identity_heads(F.col("n"), F.col("a"), [F.col("carrier"), F.col("maker"), F.col("model")], F.col("category")).alias("h"))
    assert [r["h"] for r in out.collect()] == [["发动机"], ["pump"], []]
    asked = spark.createDataFrame([("怎么拆发动机", "", False, None), ("怎么拆发动机", "", False, True), ("拆卸发动机", "发动机", True, None), ("发动机怎么拆", "发动机", True, None), ("怎么拆泵", "泵", True, None), (None, "发动机", True, None)], "q string, s string, e boolean, x boolean")
    out = asked.select(candidates.unresolved_identity(F.col("q"), F.col("s"), F.col("e"), F.col("x"), F.array(F.lit("发动机"))).alias("u"))
    assert [r["u"] for r in out.collect()] == [True, False, True, False, False, False]
