"""C32 and J21 by worked cases."""

from torqueline.operators import claims

SOURCE = claims.SOURCE
CLAIM = f"case string, claim string, answer_patterns array<string>, evidence_patterns array<string>, disclosures array<string>, forbidden array<string>, sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ', ')}>>"
EVIDENCE = f"case string, evidence string, qualification string, eligible boolean, bound boolean, text string, {SOURCE}"
CONFLICT = f"case string, conflict string, disclosures array<string>, alternatives array<struct<values:array<string>, units:array<string>, sources:array<struct<{SOURCE.replace(' ', ':').replace(',:', ', ')}>>>>"


def source(kind="manual", document=None, version=None, pages=None, chunks=None, nodes=None, relations=None, paths=None, rule=None, status=None):
    return (kind, document, version, pages, chunks, nodes, relations, paths, rule, status)


def one(spark, claim, answer, evidence, **how):
    made = spark.createDataFrame([("c", "k", *claim)], CLAIM)
    given = spark.createDataFrame([("c", f"e{i}", *e) for i, e in enumerate(evidence)], EVIDENCE)
    r = claims.observe_claims(made, spark.createDataFrame([("c", answer)], "case string, answer string"), given, **how).first()
    return r["supported"], r["asserted"], r["disclosed"], r["forbidden"], r["issues"]


def test_claims(spark):
    torque = (["扭矩 20 N·m"], ["20N·m"], ["资料没有给出"], ["扭矩 25"], [source(document="d1", pages=[3])])
    hit = ("qualified", True, False, "拧紧扭矩：20 Ｎ·m", *source(document="d1", pages=[2, 4]))
    assert one(spark, torque, "扭矩 20 N·m。", [hit]) == (True, True, False, False, [])
    assert one(spark, torque, "无法确定扭矩 20 N·m。", [hit]) == (True, False, False, False, ["answer_pattern_missing"])
    assert one(spark, torque, "扭矩 200 N·m；扭矩25", [("qualified", True, False, "扭矩 120N·m", *source(document="d1", pages=[3]))]) == (False, False, False, True, ["evidence_pattern_missing", "unsupported_completion"])
    assert one(spark, torque, "资料没有给出", [("qualified", True, False, "20N·m", *source(document="d2", pages=[3]))]) == (False, False, True, False, ["allowed_source_missing"])
    assert one(spark, torque, None, [("reference_only", *hit[1:])]) == (False, False, False, False, ["evidence_pattern_missing"])
    assert one(spark, (*torque[:4], []), "扭矩 20 N·m", [hit])[4] == ["allowed_sources_missing", "unsupported_completion"]
    assert one(spark, ([], [], [], [], []), "x", [hit])[4] == ["evidence_patterns_missing"]


def test_graph_sources(spark):
    path = source("graph", chunks=["c1"], nodes=["n1", ""], relations=["CAUSES"], paths=["p1", "p2"])
    claim = (["断裂"], ["断裂"], [], [], [path])
    own = lambda **change: [("qualified", True, change.pop("bound", False), "断裂", *source("graph", **{"chunks": ["c1", "c2"], "nodes": ["n1"], "relations": ["CAUSES", "OWNS"], "paths": ["p2", "p1"], **change}))]
    assert one(spark, claim, "断裂", own())[0]
    assert not one(spark, claim, "断裂", own(paths=["p1"]))[0] and not one(spark, claim, "断裂", own(paths=["p1", "p2", "p3"]))[0]
    assert not one(spark, claim, "断裂", own(relations=["OWNS"]))[0] and not one(spark, claim, "断裂", own(nodes=[]))[0]
    assert one(spark, claim, "断裂", own(), binding=True) == (False, True, False, False, ["final_binding_missing", "unsupported_completion"])
    assert one(spark, claim, "断裂", own(bound=True), binding=True)[0]


def test_conflicts_need_different_evidence_and_disclosure(spark):
    two = [(["20"], ["Nm"], [source()]), (["25"], ["Nm"], [source()])]
    e = lambda i, text, **how: ("c", i, how.get("q", "qualified"), how.get("ok", True), False, text, *source())

    def seen(evidence, answer):
        made = spark.createDataFrame([("c", "k", ["不一致"], two)], CONFLICT)
        r = claims.observe_conflicts(made, spark.createDataFrame([("c", answer)], "case string, answer string"), spark.createDataFrame(evidence, EVIDENCE)).first()
        return r["n_found"], r["distinct"], r["passed"]

    both = [e("a", "20 Nm"), e("b", "25 Nm", q="reference_only")]
    assert seen(both, "资料不一致：20 Nm 或 25 Nm") == (2, True, True)
    assert seen(both, "20 Nm 或 25 Nm") == (2, True, False) and seen(both, "资料不一致：20 Nm") == (2, True, False)
    assert seen([e("a", "20 Nm 或 25 Nm")], "资料不一致：20 Nm 或 25 Nm") == (2, False, False)
    assert seen([e("a", "20 Nm 或 25 Nm"), e("b", "25 Nm")], "资料不一致：20 Nm 或 25 Nm") == (2, True, True)
    assert seen([e("a", "20 Nm"), e("b", "25 Nm", ok=False)], "资料不一致：20 Nm") == (1, False, False)


def test_conflicts_meet_by_case_alone(spark):
    """what an answer tells and what fits an alternative is found in joins by case, without moving rows by other keys in between."""
    import __spark_entry__ as entry

    plan = entry.queries()["c32_conflicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("Join ") == 2
