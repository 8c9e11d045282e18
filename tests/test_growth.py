"""Joins that meet kinds of rows and not rows, so that they do not grow as a product."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from torqueline.operators import answers, candidates, graph, knowledge, pages


def joined_rows(df):
    """The largest number of rows that a join or an explode of the plan gives."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), df._jdf.queryExecution().logical()).queryExecution().executedPlan()
        plan.executeCollect()
        out, todo = 0, [plan]
        while todo:
            node = todo.pop()
            if any(n in node.nodeName() for n in ("Join", "Generate")):
                out = max(out, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return out
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_procedures_meet_kinds_of_devices(spark):
    """600 devices of three names and 400 procedures of one type."""
    devices = spark.range(600).select(F.col("id").alias("device"), F.concat(F.lit("pump P"), F.col("id") % 3).alias("name"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("level"))
    procedures = spark.range(400).select(F.col("id").alias("procedure"), F.lit("P1").alias("type"), F.when(F.col("id") % 5 > 1, (F.col("id") % 5).cast("string")).alias("level"), (F.col("id") % 9).alias("version"), F.lit("PUBLISHED").alias("status"))
    out = knowledge.match_procedure(devices, procedures)
    given = [(p, None if p % 5 < 2 else str(p % 5), p % 9) for p in range(400)]
    want = {}
    for d in range(1, 600, 3):
        level = str(d % 4) if d % 4 else None
        fits = [(own is not None and own == level, v, -p) for p, own, v in given if own is None or own == level]
        exact, _, p = max(fits)
        want[d] = (-p, exact)
    assert {r["device"]: (r["procedure"], r["exact"]) for r in out.collect()} == want
    assert joined_rows(out) <= 600


def test_gold_meets_kinds_of_paths(spark):
    """300 gold sources and 300 paths of one component and document."""
    gold = spark.range(300).select(F.col("id").alias("gold"), F.lit("c").alias("component"), F.lit(1).alias("document"), F.when(F.col("id") % 3 == 0, "f").otherwise("F1").alias("fault"), F.when(F.col("id") % 2 == 0, "v1").alias("version"), F.lit("").alias("device"))
    paths = spark.range(300).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.lit("c").alias("component"), F.lit(1).alias("document"), F.when(F.col("id") == 7, "f1").otherwise("f22").alias("fault"), F.when(F.col("id") % 2 == 0, "v1").otherwise("v2").alias("version"), F.lit("d").alias("device"), (F.col("id") > 0).alias("complete"))
    out = answers.refresh_gold(gold, paths)
    want = {g: (None, "ambiguous") if g % 3 == 0 else (None, "not_found") if g % 2 == 0 else ("p7", "") for g in range(300)}
    assert {r["gold"]: (r["path"], r["issue"]) for r in out.collect()} == want
    assert joined_rows(out) <= 600


@pytest.mark.parametrize("several", [False, True])
def test_terms_meet_kinds_of_nodes(spark, several):
    """F16: 500 nodes of two texts and 20 queries of one term; a node may have several texts."""
    names = ["pump red", "pump blue red"]
    rows = [(i, names[i % 2]) for i in range(500)] + ([(3, "valve"), (9, "valve"), (4, None)] if several else [])
    terms = [(q, t) for q in range(20) for t in ("pump", "blue", "valve")[: 1 + q % 3]]
    out = graph.lexical_hits(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(terms, "query long, term string"), top=4)
    for q in range(3):
        asked = ("pump", "blue", "valve")[: 1 + q % 3]
        hits = Counter({(i, t) for i, x in rows if x for t in asked if t in x})
        count = Counter(i for i, _ in hits)
        best = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:4]
        got = sorted((r["place"], r["id"], r["hits"]) for r in out.where(F.col("query") == q).collect())
        assert got == [(p + 1, i, n) for p, (i, n) in enumerate(best)]
    assert joined_rows(out) <= 1000


def test_places_are_tried_once(spark):
    """400 blocks at four places and 300 tables at two, of one page."""
    block = "document long, page long, height int, text string, box array<double>"
    blocks = [(1, 1, 792, f"t{i}", [float(i % 4 * 100), 300.0, i % 4 * 100 + 90.0, 320.0]) for i in range(400)] + [(1, 1, 792, "no box", None)]
    tables = [(1, 1, [float(i % 2 * 100), 290.0, i % 2 * 100 + 95.0, 330.0]) for i in range(300)]
    out = pages.page_lines(spark.createDataFrame(blocks, block), spark.createDataFrame(tables, "document long, page long, box array<double>"))
    assert {r["text"] for r in out.collect()} == {f"t{i}" for i in range(400) if i % 4 > 1} | {"no box"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(box" in plan and "Aggregate [document" in plan


@pytest.mark.parametrize("most", [candidates.BROADCAST_PIECES, 0])
def test_questions_meet_texts_with_a_piece(spark, monkeypatch, most):
    """long texts with edits are found, and others are not compared; broadcast or not."""
    rng = random.Random(4)
    monkeypatch.setattr(candidates, "BROADCAST_PIECES", most)
    made = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    base = [made(rng.randint(150, 190)) for _ in range(30)]
    others = [made(rng.randint(150, 190)) for _ in range(300)] + [t[:40] + "x" + t[44:100] + made(3) + t[100:] for t in base[:10]]
    asked, existing = spark.createDataFrame(list(enumerate(base)), "case long, text string"), spark.createDataFrame([(t,) for t in others], "text string")
    out = candidates.leaks(asked, existing)
    want = {i: round(max(SequenceMatcher(None, t, o).ratio() for o in others), 6) for i, t in enumerate(base)}
    assert {r["case"]: r["similarity"] for r in out.collect()} == {i: s for i, s in want.items() if s >= 0.92} and sum(s >= 0.92 for s in want.values()) > 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "levenshtein" in plan
