"""Text, planning and candidate operators against plain versions of themselves and hand-worked cases."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from torqueline.operators import candidates, chunking, planning
from torqueline.sources import tables


def first(df):
    return [tuple(r) for r in df.collect()]


def test_long_texts_are_split_at_the_last_boundary():
    text = "a" * 300 + "。" + "b" * 400 + "\n" + "c" * 200
    parts = chunking.long_parts(text, 520, 90, 160)
    assert parts[0] == "a" * 300 + "。"
    assert parts[1] == "a" * 89 + "。" + "b" * 400
    assert parts[2].startswith("b" * 89 + "\n") and parts[2].endswith("c" * 200)
    # Every character is covered, and parts overlap by 90 characters.
    r = random.Random(3)
    text = "".join(r.choice("xyz。；\n ") for _ in range(3000)).strip()
    assert all(p and p in text and len(p) <= 520 for p in chunking.long_parts(text, 520, 90, 160))


def test_numeric_values(spark):
    df = spark.createDataFrame([("扭矩 20 ± 2 N·m，间隙0.1-0.2mm",), ("无",), ("20 N·m 20 N·m",)], "t string")
    out = df.select(chunking.numeric_values(F.col("t"), chunking.unit_values(F.col("t"))).alias("v")).collect()
    got = [[(x["raw"], x["unit"]) for x in r["v"]] for r in out]
    assert got[0] == [("20 ± 2", "N·m"), ("0.1-0.2", "mm")] and got[1] == [] and got[2] == [("20", "N·m")]


def test_section_chunks_keep_their_order(spark):
    rows = [(1, 0, "1. 拆下\n2. 装上", "general"), (1, 1, "故障原因：油压", "general"), (1, 2, "扭矩 20 N·m", "general"), (1, 3, "注意高温", "general"), (1, 4, "目录", "outline"), (1, 5, " ", "general"), (1, 6, "普通", None)]
    out = chunking.section_chunks(spark.createDataFrame(rows, "doc long, pos int, text string, label string")).orderBy("pos", "part").collect()
    assert [(r["pos"], r["part"], r["label"], r["role"]) for r in out] == [
        (0, 0, "step", "procedure_step"), (0, 1, "step", "procedure_step"), (1, 0, "troubleshooting", "diagnostic_logic"), (2, 0, "parameter", "exact_value"),
        (3, 0, "safety", "safety_warning"), (4, 0, "outline", "navigation"), (6, 0, "general", "context_explain")]
    assert out[3]["units"] == ["N·m"] and out[3]["parameter_type"] == "torque"


def test_continued_tables(spark):
    head, row = ["序号", "名称"], ["1", "x"]
    rows = [("s", 0, "a", 1, [head, row]), ("s", 1, "b", 2, [head, row]), ("s", 2, "c", 3, [["3", "y"]]), ("s", 3, "d", 4, [["别的", "z"], row]), ("s", 4, "e", 6, [["5", "z"]]), ("s", 5, "f", 7, [["1", "2", "3"]]), ("s", 6, "g", 8, [head]), ("s", 7, "h", 9, [head, row])]
    out = chunking.continued_tables(spark.createDataFrame(rows, "section string, pos int, table string, page int, rows array<array<string>>"))
    assert {r["table"]: r["logical"] for r in out.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "g"}


def test_component_names(spark):
    titles = ("4.7 气缸头", "第三章 火花塞的检查", "拆卸式制动器总成", "动力电池主要参数", "后桥总成分解图", "检查、维修和更换", "车辆的识别标志", "（左）活塞（右）", None, "参数", "装配部件清单", "安装作业指导", "、气缸头的拆卸与安装步骤 ", "5 式主要气门组件规格表", "\u3000活塞 ")
    df = spark.createDataFrame(list(enumerate(titles)), "i long, t string").select("i", candidates.component_name(F.col("t")).alias("name"))
    assert [r["name"] for r in df.orderBy("i").collect()] == [
        "气缸头", "火花塞", "制动器总成", "动力电池", "后桥总成", "", "", "活塞", "", "参数", "", "", "气缸头", "气门", "活塞"]


def test_aspects_take_over_the_place(spark):
    df = spark.createDataFrame([("发动机里油压是多少？机油温度呢",), ("螺栓1和螺栓2分别是多少",), ("油压？ 油压",), ("",)], "q string")
    assert [[a["text"] for a in r[0]] for r in df.select(planning.aspects(F.col("q"))).collect()] == [["发动机里油压是多少", "发动机里机油温度呢"], ["螺栓1", "螺栓2"], ["油压"], []]


def test_leaks_against_all_pairs(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(3, 80))) for _ in range(40)]
    def edited(t, n):
        t = list(t)
        for _ in range(n):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice("abcdefgh")
        return "".join(t)
    other = [edited(t, r.randint(0, 5)) for t in base] + base[:3] + ["", "a"]
    rows = [(i, t) for i, t in enumerate(base)] + [(100, ""), (101, "a")]
    kept = lambda t: "".join(c for c in t.lower() if c.isalnum() or c == "_")
    want = {}
    for i, t in rows:
        for o in other:
            a, b = kept(t), kept(o)
            s = 1.0 if a == b else SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            if s >= 0.92:
                want[i] = max(want.get(i, 0), round(s, 6))
    out = candidates.leaks(spark.createDataFrame(rows, "case long, text string"), spark.createDataFrame([(t,) for t in other], "text string"))
    assert {x["case"]: x["similarity"] for x in out.collect()} == want and 10 < len(want) < 42


def test_title_similarity(spark):
    df = spark.createDataFrame([("如何拆卸气缸头", "气缸头"), ("气缸头", "气缸头"), ("abc", ""), ("拆卸气缸头和活塞环的步骤", "气缸")], "q string, t string")
    got = [r[0] for r in df.select(candidates.title_similarity(F.col("q"), F.col("t"))).collect()]
    ratio = SequenceMatcher(None, "气缸", "拆卸气缸头和活塞环的步骤").ratio()
    short = SequenceMatcher(None, "气缸头", "如何拆卸气缸头").ratio()
    assert got == [round(0.75 * short + 0.25 * 3 / 7, 6), 1.0, 0.0, round(0.75 * ratio + 0.25 * 2 / 12, 6)]


def test_groups_that_share_a_name_are_left_out(spark):
    groups = [("u", 0, "a", ["b", "x", "b", "a"]), ("u", 1, "b", ["c"]), ("u", 2, " c ", ["d"]), ("u", 3, "x", ["e"]), ("u", 4, "e", []), ("v", 0, "a", ["b"])]
    names = [("u", n) for n in "abcde"] + [("v", "a")]
    out = candidates.disjoint_groups(spark.createDataFrame(groups, "user string, seq int, keep string, drop array<string>"), spark.createDataFrame(names, "user string, name string"))
    assert sorted((r["user"], r["keep"], tuple(r["drop"])) for r in out.collect()) == [("u", "a", ("b",)), ("u", "c", ("d",))]


def test_cases_from_csv_and_json_lines(spark, tmp_path):
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    (tmp_path / "c.csv").write_text("﻿id,golden,skip\n1,a1; b1|c1,true\n2,,\n", encoding="utf-8")
    schema = StructType([StructField("id", StringType()), StructField("golden", StringType()), StructField("skip", StringType())])
    rows = tables.csv_cases(spark, f"file://{tmp_path}/c.csv", schema, lists=["golden"], flags=["skip"]).collect()
    assert [(r["id"], r["golden"], r["skip"]) for r in rows] == [("1", ["a1", "b1", "c1"], True), ("2", [], False)]
    (tmp_path / "c.jsonl").write_text('// note\n{"id": "1", "ok": true}\n\nnot json\n', encoding="utf-8")
    good, bad = tables.jsonl_cases(spark, f"file://{tmp_path}/c.jsonl", StructType([StructField("id", StringType()), StructField("ok", BooleanType())]))
    assert first(good) == [("1", True)] and first(bad) == [("not json",)]


def test_bootstrap_of_many_values_is_that_of_all_pairs(spark):
    import numpy as np

    from torqueline.operators import evaluation

    values = np.random.default_rng(2).normal(0.1, 1, 5000)
    df = spark.createDataFrame([(float(v),) for v in values], "delta double")
    out, again = (evaluation.bootstrap(df, samples=2000, values=v).first() for v in (500, 10_000))
    assert out["pairs"] == 5000 and abs(out["mean"] - values.mean()) < 1e-6
    plain = np.random.default_rng(3).choice(values, (2000, 5000)).mean(1)
    for low, high in ((out["low"], out["high"]), (again["low"], again["high"])):
        assert abs(low - np.quantile(plain, 0.025)) < 0.004 and abs(high - np.quantile(plain, 0.975)) < 0.004
    assert evaluation.bootstrap(df.limit(0)).first()["pairs"] == 0


def test_candidates_are_fused_first_fit(spark):
    from torqueline.operators import pages

    rows = [("q", 1, "a", "section", "d", "s1", ["u1"], None), ("q", 2, "b", "section", "d", "s2", ["u2"], ["p1"]), ("q", 3, "c", "graph", "d", "s2", ["u3"], ["p2"]),
            ("q", 4, "e", "graph", "d", None, ["u1"], ["p3"]), ("q", 5, "f", "graph", "d", "s1", ["u9"], ["p3"]), ("q", 6, "g", "graph", None, "s1", ["u1"], None)]
    df = spark.createDataFrame(rows, "query string, seq int, candidate string, kind string, document string, section string, chunks array<string>, paths array<string>")
    assert sorted((r["place"], tuple(r["members"])) for r in pages.fuse_candidates(df).collect()) == [(0, ("a", "e", "f")), (1, ("b",)), (2, ("c",)), (3, ("g",))]


def test_store_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    spark.createDataFrame([("d1", 1, "x"), ("d1", 2, "y"), ("d2", 3, "z")], "document_id string, doc_id int, t string").write.partitionBy("document_id").parquet(path)
    spark.createDataFrame([("d/3", 4, "w")], "document_id string, doc_id int, t string").write.mode("append").partitionBy("document_id").parquet(path)
    gone = spark.createDataFrame([(2, "d1"), (4, "d/3")], "doc_id int, document_id string")
    tables.rewrite_partitions(spark, path, gone, "document_id", lambda part: tables.delete(part, gone, "doc_id"))
    assert sorted((r["document_id"], r["doc_id"]) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 3)]
    more = spark.createDataFrame([("d1", 1, "new", None, None, 2), ("d1", 9, "nine", "rule", "draft", 1)], "document_id string, doc_id int, t string, record_type string, status string, written int")
    last = tables.upsert(spark.read.parquet(path).selectExpr("document_id", "doc_id", "t", "'manual' AS record_type", "'ready' AS status", "0 AS written"), more)
    assert sorted((r["doc_id"], r["t"], r["record_type"], r["status"]) for r in last.collect()) == [(1, "new", "manual", "ready"), (3, "z", "manual", "ready"), (9, "nine", "rule", "draft")]


def test_a_key_that_moves_leaves_its_partition(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", "doc_id int, t string, record_type string, status string, written int, document_id string"
    spark.createDataFrame([(1, "x", "manual", "ready", 1, "a"), (2, "y", "manual", "ready", 1, "a"), (3, "z", "manual", "ready", 1, "b"), (4, "w", "manual", "ready", 1, "c")], schema).write.partitionBy("document_id").parquet(path)
    tables.upsert_into(spark, path, spark.createDataFrame([(1, "new", None, None, 2, "b"), (3, "moved", None, None, 2, "d")], schema), "document_id")
    assert sorted((r["document_id"], r["doc_id"], r["t"]) for r in spark.read.parquet(path).collect()) == [("a", 2, "y"), ("b", 1, "new"), ("c", 4, "w"), ("d", 3, "moved")]
    assert [p.name for p in tmp_path.iterdir()] == ["s"]


def test_reads_by_week_and_month(spark, tmp_path):
    from torqueline.streaming import jobs

    rows = [("2025-12-31 15:59:00", 1), ("2025-12-31 16:01:00", 1), ("2026-01-04 15:00:00", 2)]
    spark.createDataFrame(rows, "t string, manual int").selectExpr("cast(t AS timestamp) ts", "manual").write.parquet(f"file://{tmp_path}/in")
    for kind, want in (("month", {("202512", 1, 1), ("202601", 1, 1), ("202601", 2, 1)}), ("week", {("2026-01", 1, 2), ("2026-01", 2, 1)})):
        stream = spark.readStream.schema("ts timestamp, manual int").parquet(f"file://{tmp_path}/in")
        q = jobs.period_counts(stream, kind).writeStream.format("memory").queryName(f"by_{kind}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(f"by_{kind}").collect()} == want
    stream = spark.readStream.schema("ts timestamp, manual int").parquet(f"file://{tmp_path}/in")
    q = jobs.daily_counts(stream).writeStream.format("memory").queryName("by_day").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["manual"], str(r["start"])[:10], r["reads"]) for r in spark.table("by_day").collect()} == {(1, "2025-12-30", 1), (1, "2025-12-31", 1), (2, "2026-01-03", 1)}


def test_results_with_a_summary(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "v", 1), ("r2", "v", 2)], "run string, variant string, n int")
    tables.write_results(rows, f"file://{tmp_path}/out", ["run", "variant"], rows.groupBy().sum("n"))
    assert spark.read.parquet(f"file://{tmp_path}/out/rows").count() == 2 and spark.read.json(f"file://{tmp_path}/out/summary").first()[0] == 3


def test_diagnostic_facts(spark):
    texts = ["检查活塞环：\n1. 活塞环磨损时更换；2）气缸发黑。清洗气缸。", "确认油位\n漏油\n调整", "只有说明。", "更换。", " "]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.diagnostic_facts(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in out] == [["检查活塞环：活塞环磨损时更换；", "检查活塞环：气缸发黑。检查活塞环：清洗气缸。"], ["确认油位：漏油确认油位：调整"], ["只有说明。"], ["更换。"], []]


def test_messages_are_answered_once(spark, tmp_path):
    from torqueline.streaming import jobs

    schema, source, out = "message_id string, ts timestamp, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    handle = lambda m: m.select("message_id", F.lit("echo").alias("type"), F.lit(True).alias("success"), F.upper("text").alias("data"))
    for rows in ([("a", "x"), ("a", "x"), ("b", "y")], [("b", "y"), ("c", "z"), (None, "w")]):
        spark.createDataFrame(rows, "message_id string, text string").selectExpr("message_id", "timestamp'2026-01-01' AS ts", "text").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.answer_messages(stream, handle, out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["message_id"] or "", r["data"]) for r in spark.read.parquet(out).collect()) == [("", "W"), ("a", "X"), ("b", "Y"), ("c", "Z")]


def test_claims_meet_evidence_in_one_join(spark):
    """literals and vectors of all claims meet the evidence of their query at once, by Spark's own functions; zero, null and odd vectors have no cosine."""
    from torqueline.operators import answers

    nan, far = float("nan"), [0.0, 0.0]
    claims = [(1, 0, "无数", [3.0, 4.0]), (1, 1, "扭矩 5 mm 和 7 mm", [1.0, 0.0]), (2, 0, "无数", far), (3, 0, "无数", [1.0, 0.0]), (4, 0, "6 mm", None), (5, 0, "无数", None), (6, 0, "无数", [1.0, 1.0])]
    evidence = [(1, "5  MM", [6.0, 8.0]), (1, None, far), (1, "x", [1.0]), (1, "x", None), (1, "x", [nan, 1.0]), (2, "x", [1.0, 1.0]), (4, "6mm", None), (5, "x", [1.0, 1.0]), (6, "x", [-1.0, -1.0]), (6, "x", [None, 1.0])]
    out = answers.grounded(spark.createDataFrame(claims, "query long, claim int, text string, vec array<double>"), spark.createDataFrame(evidence, "query long, text string, vec array<double>"))
    got = {(r["query"], r["claim"]): tuple(r)[2:] for r in out.collect()}
    none = (0, [], 0.0, False)
    assert got == {(1, 0): (0, [], 1.0, True), (1, 1): (2, ["7mm"], None, False), (2, 0): none, (3, 0): none, (4, 0): (1, [], None, True), (5, 0): none, (6, 0): (0, [], -1.0, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Join ") == 1


def test_long_texts_stay_in_their_buffers():
    """of 40 MB of texts only a few are Python's own at once."""
    import tracemalloc

    import pyarrow as pa

    from torqueline.operators import chunking

    texts = pa.array([None, "a。" * 600] + [f"{i} " + "word " * 4000 for i in range(2000)])
    tracemalloc.start()
    parts = chunking.cut_texts(texts, 520, 90, 160)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(parts) == 2002 and parts[0].as_py() == [] and [len(p) for p in parts[1].as_py()] == [520, 520, 340]
    assert parts[1001].as_py() == chunking.long_parts(texts[1001].as_py(), 520, 90, 160)
