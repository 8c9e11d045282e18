"""Tables in parts of even size, and queries that group by their keys without moving them again."""

import pytest
from pyspark.sql import functions as F

from torqueline.sources import tables


def test_parts_follow_the_number_of_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), "id")
    parts = tables.in_parts(rows, "k", size=100)
    assert parts.rdd.getNumPartitions() == 50 and parts.count() == 5000
    assert parts.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert tables.in_parts(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["w4_continued_tables", "a31_question", "a3_device_overview", "j2_own_devices"])
def test_lines_are_taken_in_parts(spark, monkeypatch, name):
    """parts grow in number and not in size."""
    import __spark_entry__ as entry

    monkeypatch.setattr(tables.in_parts, "__kwdefaults__", {"size": 50})
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["k4_structural_score", "c2_query_terms"])
def test_parts_are_read_by_all_cores(spark, name):
    """the texts of parts, whose terms cost much more than their bytes tell, are dealt out before terms are looked for."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.index("ArrowEvalPython") < plan.rindex("REPARTITION_BY_NUM")


def test_views_of_a_question_are_made_once(spark):
    """the views are not made anew for each of them, and parts are dealt out."""
    import __spark_entry__ as entry
    from torqueline.operators import planning

    plan = entry.queries()["c18_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("component_action") == 1 and "REPARTITION_BY_NUM" in plan.executedPlan().toString()
    rows = [(" Pump A leak fix ", "pump a", "LEAK", "fix", ["leak", None, "no"], ["A", "pump A leak fix", ""]), ("", "", "x", None, [""], [""]), (None, None, None, None, None, None), ("ab", "b", None, None, ["b"], None)]
    given = spark.createDataFrame(rows, "q string, c string, f string, a string, fields array<string>, aspects array<string>")
    out = given.select(planning.variants(*map(F.col, given.columns)).alias("v")).collect()
    assert [[tuple(v) for v in r["v"]] for r in out] == [[(" Pump A leak fix ".strip(), "original"), ("pump a LEAK", "component_fault"), ("pump a fix leak", "component_action"), ("A", "aspect")], [], [], [("ab", "original"), ("b", "component_action")]]


@pytest.mark.parametrize("name", ["k2_keyword_all", "k2_keyword_every_word"])
def test_words_are_counted_in_parts(spark, monkeypatch, name):
    """texts are dealt out in parts before their words are counted, which is done once, and counts meet candidates in parts."""
    import __spark_entry__ as entry
    from torqueline import queries
    from torqueline.sources import scratch

    monkeypatch.setattr(queries, "TEXT_ROWS", 20)
    plans = []
    monkeypatch.setattr("torqueline.operators.retrieval.written", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scratch.written(df, n), raising=False)
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and "REPARTITION_BY_NUM" in plans[0] and "REPARTITION_BY_NUM" in found and "documents.parquet" not in found
