"""Registered queries of answers, evidence and frozen cases, each with the DuckDB SQL that says the same."""

from pyspark.sql import functions as F

from .candidate_queries import pick
from .operators import answers, claims
from .queries import query
from .sources.tables import in_parts, table
from .text_queries import HAN, LETTERS

ZH_SQL = f"translate(replace(p_name, ' ', ''), '{LETTERS}', '{HAN}')"
ANSWER_SQL = f"""
WITH a AS (SELECT p_partkey AS part, p_name, p_size, {ZH_SQL} AS z, p_partkey % 6 AS k FROM part),
t AS (SELECT part, z, p_size, k, CASE k WHEN 0 THEN '' WHEN 1 THEN '资料不足' WHEN 2 THEN '扭矩为 ' || p_size || ' N·m。' || z WHEN 3 THEN '先' || left(z, 2) || '，再装' || right(z, 2) WHEN 4 THEN '手册未提及' || z || ' ' || p_size ELSE z || ' ' || (p_size + 1) || ' mm' END AS answer FROM a)
"""


def given(spark, d):
    """``part, z, p_size, k, answer``: answers about parts of six kinds."""
    z = F.translate(F.replace("p_name", F.lit(" "), F.lit("")), LETTERS, HAN)
    rows = in_parts(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("part"), z.alias("z"), "p_size", (F.col("p_partkey") % 6).alias("k"))
    size = F.col("p_size").cast("string")
    kinds = [F.lit(""), F.lit("资料不足"), F.concat(F.lit("扭矩为 "), size, F.lit(" N·m。"), "z"), F.concat(F.lit("先"), F.left("z", F.lit(2)), F.lit("，再装"), F.right("z", F.lit(2))),
             F.concat(F.lit("手册未提及"), "z", F.lit(" "), size), F.concat("z", F.lit(" "), (F.col("p_size") + 1).cast("string"), F.lit(" mm"))]
    return rows.withColumn("answer", F.get(F.array(*kinds), F.col("k").cast("int")))


@query(ANSWER_SQL + """, n AS (SELECT part, k, part % 4 AS m, z, p_size, lower(answer) AS a, regexp_extract_all(answer, '\\d+') AS an FROM t)
SELECT part, CASE WHEN a = '' THEN 0.0 WHEN m = 0 THEN CASE WHEN regexp_matches(a, '资料不足') THEN 1.0 ELSE 0.0 END
  WHEN m = 1 THEN CASE (contains(a, z) AND z <> '')::INT + (list_contains(an, p_size::VARCHAR) AND (contains(replace(a, ' ', ''), 'n·m') OR contains(replace(a, ' ', ''), 'm')))::INT WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END
  WHEN m = 2 THEN CASE WHEN list_contains(an, p_size::VARCHAR) AND contains(a, 'm') THEN 1.0 WHEN list_contains(an, p_size::VARCHAR) THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score FROM n""")
def c22_answer_score(spark, d):
    m, size = F.col("part") % 4, F.col("p_size").cast("string")
    facts = F.when(m == 1, F.array(F.col("z"), F.concat(size, F.lit(" N·m")))).otherwise(F.array().cast("array<string>"))
    golden = F.when(m == 2, F.concat(size, F.lit(" m"))).otherwise(F.lit(" "))
    return given(spark, d).select("part", answers.answer_score(F.col("answer"), m != 0, facts, golden).alias("score"))


@query(ANSWER_SQL + """, n AS (SELECT *, lower(regexp_replace(answer, '[\\s，。]+', '', 'g')) AS a FROM t)
SELECT part, contains(a, z) OR list_has_all(string_split(a, ''), list_distinct(regexp_extract_all(z, '[\\x{4e00}-\\x{9fff}]'))) AND len(regexp_extract_all(z, '[\\x{4e00}-\\x{9fff}]')) >= 4
    OR len(regexp_extract_all(z, '[\\x{4e00}-\\x{9fff}]')) >= 4 AND len(list_filter(list_distinct(regexp_extract_all(z, '[\\x{4e00}-\\x{9fff}]')), lambda c: contains(a, c))) >= 0.8 * len(list_distinct(regexp_extract_all(z, '[\\x{4e00}-\\x{9fff}]'))) AS matched,
  contains(a, left(z, 2)) AND contains(substr(a, strpos(a, left(z, 2)) + 2), right(z, 2)) AS ordered,
  contains(a, z || p_size) AND k <> 4 AS forbidden FROM n""")
def c23_phrases(spark, d):
    z, size = F.col("z"), F.col("p_size").cast("string")
    first_then = F.concat(F.lit("先"), F.left(z, F.lit(2)), F.lit("再"), F.right(z, F.lit(2)))
    both = answers.in_order(F.array(F.left(z, F.lit(2)), F.right(z, F.lit(2))), F.col("answer"))["passed"]
    return given(spark, d).where(first_then.isNotNull()).select(
        "part", answers.phrase_matched(z, F.col("answer")).alias("matched"), both.alias("ordered"), answers.forbidden_matched(F.concat(z, F.lit(" "), size), F.col("answer")).alias("forbidden"))


@query("""WITH o AS (SELECT l_orderkey AS "case", list(l_linenumber ORDER BY l_linenumber, l_partkey) AS steps, string_agg(l_returnflag || '步' || l_linenumber, '，' ORDER BY l_linenumber % 4, l_linenumber, l_partkey) AS t FROM lineitem GROUP BY 1),
w AS (SELECT "case", list_filter(list_distinct(steps), lambda x: x <= 3) AS s, replace(lower(t), '，', '') AS a FROM o),
p AS (SELECT "case", a, CASE WHEN list_contains(s, 1) THEN '步1' END AS s1, CASE WHEN list_contains(s, 2) THEN '步2' END AS s2, CASE WHEN list_contains(s, 3) THEN '步3' END AS s3 FROM w),
q1 AS (SELECT *, CASE WHEN s1 IS NULL THEN 1 ELSE strpos(a, s1) + 2 END AS c1 FROM p),
q2 AS (SELECT *, CASE WHEN s2 IS NULL THEN c1 WHEN strpos(substr(a, c1), s2) = 0 THEN 0 ELSE c1 + strpos(substr(a, c1), s2) + 1 END AS c2 FROM q1),
q3 AS (SELECT *, CASE WHEN c2 = 0 THEN 0 WHEN s3 IS NULL THEN c2 WHEN strpos(substr(a, c2), s3) = 0 THEN 0 ELSE c2 + strpos(substr(a, c2), s3) + 1 END AS c3 FROM q2)
SELECT "case", c3 > 0 AS passed, (s1 IS NOT NULL)::INT + CASE WHEN c2 = 0 THEN 0 ELSE (s2 IS NOT NULL)::INT END + CASE WHEN c3 = 0 THEN 0 ELSE (s3 IS NOT NULL)::INT END AS met FROM q3""")
def w15_ordered_steps(spark, d):
    n = F.col("l_linenumber")
    said = F.concat("l_returnflag", F.lit("步"), n.cast("string"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case")).agg(
        F.array_sort(F.collect_set(F.when(n <= 3, n))).alias("steps"), F.array_sort(F.collect_list(F.struct((n % 4).alias("a"), n.alias("b"), F.col("l_partkey").alias("c"), said.alias("t")))).alias("said"))
    found = answers.in_order(F.transform("steps", lambda s: F.concat(F.lit("步 "), s.cast("string"))), F.array_join(F.transform("said", lambda x: x["t"]), "，"))
    return rows.select("case", found["passed"].alias("passed"), found["met"].alias("met"))


@query("""WITH o AS (SELECT l_orderkey AS "case", list(l_suppkey % 9 ORDER BY l_linenumber, l_partkey, l_suppkey % 9) FILTER (l_returnflag = 'A') AS w, list(l_suppkey % 9 ORDER BY l_linenumber, l_partkey, l_suppkey % 9) FILTER (l_returnflag <> 'R') AS f, list(l_suppkey % 9) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS b FROM lineitem GROUP BY 1),
x AS (SELECT "case", list_filter(coalesce(w, []), (v, i) -> list_position(w, v) = i) AS w, list_filter(coalesce(f, []), (v, i) -> list_position(f, v) = i) AS f, coalesce(b, []) AS b FROM o),
r AS (SELECT *, len(list_intersect(w, f)) AS n FROM x)
SELECT "case", len(w) > 0 OR len(b) > 0 AS required, round(CASE WHEN len(w) > 0 THEN n / len(w)::DOUBLE WHEN len(f) = 0 THEN 1 ELSE 0 END, 6) AS recall, round(CASE WHEN len(w) = 0 THEN CASE WHEN len(f) = 0 THEN 1 ELSE 0 END WHEN len(f) > 0 THEN n / len(f)::DOUBLE ELSE 0 END, 6) AS precision,
  NOT list_has_any(f, b) AS forbidden_pass, len(w) = 0 OR list_filter(f, v -> list_contains(w, v)) = w AS order_pass,
  NOT (len(w) > 0 OR len(b) > 0) OR (CASE WHEN len(w) > 0 THEN n = len(w) AND n = len(f) ELSE len(f) = 0 END AND NOT list_has_any(f, b) AND (len(w) = 0 OR list_filter(f, v -> list_contains(w, v)) = w)) AS passed FROM r""".replace("(v, i) -> ", "lambda v, i: ").replace("v -> ", "lambda v: "))
def c24_pictures(spark, d):
    at = F.struct("l_linenumber", "l_partkey", (F.col("l_suppkey") % 9).alias("page"))
    of = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, at))), lambda x: x["page"])
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case")).agg(of(F.col("l_returnflag") == "A").alias("w"), of(F.col("l_returnflag") != "R").alias("f"), of((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("b"))
    return rows.select("case", answers.picture_check(F.col("w"), F.lit(None), F.col("b"), F.col("f")).alias("c")).select("case", "c.*")


@query("""WITH i AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank, 'd' || l_suppkey || ':c' || l_partkey AS chunk, CASE WHEN l_partkey % 3 = 0 THEN 'a' || l_partkey END AS anchor, 's' || l_suppkey % 5 AS section, l_partkey % 10 AS page FROM lineitem),
k AS (SELECT query, rank, 1 AS n, chunk AS key FROM i UNION ALL SELECT query, rank, 2, 'id:' || chunk FROM i UNION ALL SELECT query, rank, 3, 'id_tail:' || string_split(chunk, ':')[2] FROM i UNION ALL SELECT query, rank, 4, 'anchor:' || anchor FROM i WHERE anchor IS NOT NULL UNION ALL SELECT query, rank, 6, 'section_page_type:' || section || '|text|' || page FROM i),
g AS (SELECT o_orderkey AS query, 'z:c' || o_custkey AS key, false AS explicit FROM orders UNION ALL SELECT o_orderkey, 'section_page_type:s' || o_custkey % 5 || '|text|' || o_orderkey % 10, true FROM orders WHERE o_orderkey % 2 = 0),
w AS (SELECT query, key, 0 AS tier FROM g WHERE explicit UNION SELECT query, key, 1 FROM g UNION SELECT query, 'id:' || key, 1 FROM g WHERE NOT explicit UNION SELECT query, 'id_tail:' || string_split(key, ':')[2], 1 FROM g WHERE NOT explicit),
f AS (SELECT query, min({'tier': tier, 'rank': rank, 'n': n, 'key': key}) AS s FROM k JOIN w USING (query, key) GROUP BY query)
SELECT DISTINCT g.query, s.rank AS rank, coalesce(s.key, '') AS key FROM g LEFT JOIN f USING (query)""")
def c25_first_hit(spark, d):
    from pyspark.sql import Window

    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.row_number().over(order).alias("rank"), F.concat_ws(":", text("d", "l_suppkey"), text("c", "l_partkey")).alias("chunk"), F.when(F.col("l_partkey") % 3 == 0, text("a", "l_partkey")).alias("anchor"),
        F.lit(None).cast("string").alias("parent"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("section"), F.lit("text").alias("kind"), F.lit(" ").alias("label"), (F.col("l_partkey") % 10).alias("page"))
    orders = table(spark, d, "orders")
    key = F.concat(F.lit("section_page_type:s"), (F.col("o_custkey") % 5).cast("string"), F.lit("|text|"), (F.col("o_orderkey") % 10).cast("string"))
    golden = orders.select(F.col("o_orderkey").alias("query"), F.concat(F.lit("z:c"), F.col("o_custkey").cast("string")).alias("key"), F.lit(False).alias("explicit"))
    golden = golden.unionByName(orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("query"), key.alias("key"), F.lit(True).alias("explicit")))
    return answers.first_hit(items, golden)


@query("""WITH e AS (SELECT l_orderkey % 500 AS scope, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq, 'e' || l_partkey % 50 AS evidence, ['manual', 'graph', 'domain_rule', 'other'][1 + l_partkey % 4] AS source, (l_quantity > 45)::INT AS raw, l_suppkey % 4 AS filled, l_returnflag AS body FROM lineitem),
k AS (SELECT *, min({'seq': seq, 'source': source}) OVER (PARTITION BY scope, evidence) AS f FROM e WHERE source <> 'other'),
b AS (SELECT *, row_number() OVER (PARTITION BY scope, evidence ORDER BY raw DESC, filled DESC, seq) AS n FROM k WHERE seq = f.seq OR f.source = 'manual' AND source = 'manual')
SELECT scope, count(*) AS n, sha256(string_agg(evidence || chr(31) || source || chr(31) || body, chr(30) ORDER BY f.seq)) AS digest FROM b WHERE n = 1 GROUP BY scope""")
def c26_ledger(spark, d):
    part = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("scope"), (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + part).alias("seq"), F.concat(F.lit("e"), (part % 50).cast("string")).alias("evidence"),
        pick(["manual", "graph", "domain_rule", "other"], part % 4).alias("source"), (F.col("l_quantity") > 45).cast("int").alias("raw"), (F.col("l_suppkey") % 4).alias("filled"), F.col("l_returnflag").alias("body"))
    return answers.ledger(rows)


@query(ANSWER_SQL + """, v AS (SELECT *, [length(answer) - 20.0, p_size - 25.0, 1.0 + part % 7] AS vec, lower(regexp_replace(answer, '\\s+', '', 'g')) AS body FROM t),
e AS (SELECT part - 1 AS part, vec, body FROM v UNION ALL SELECT part, vec, body FROM v WHERE part % 3 = 0),
c AS (SELECT part, CASE k WHEN 2 THEN [p_size || 'n·m'] WHEN 5 THEN [(p_size + 1) || 'mm'] ELSE [] END AS lits, vec FROM v WHERE k IN (1, 2, 3)),
f AS (SELECT c.part, len(lits) AS n_literals, max(CASE WHEN len(lits) > 0 THEN contains(body, lits[1])::INT ELSE list_cosine_similarity(c.vec, e.vec) END) AS best FROM c LEFT JOIN e USING (part) GROUP BY ALL)
SELECT part, n_literals, CASE WHEN n_literals = 0 THEN round(coalesce(best, 0), 4) END AS similarity, coalesce(best >= CASE WHEN n_literals > 0 THEN 1 ELSE 0.35 END, false) AS verified FROM f""")
def c19_grounded(spark, d):
    vec = F.array((F.length("answer") - 20).cast("double"), (F.col("p_size") - 25).cast("double"), (F.col("part") % 7 + 1).cast("double"))
    rows = given(spark, d).withColumn("vec", vec)
    claims = rows.where("k IN (1, 2, 3)").select(F.col("part").alias("query"), F.lit(0).alias("claim"), F.col("answer").alias("text"), "vec")
    evidence = rows.select((F.col("part") - 1).alias("query"), F.col("answer").alias("text"), "vec").unionByName(rows.where("part % 3 = 0").select(F.col("part").alias("query"), F.col("answer").alias("text"), "vec"))
    return answers.grounded(claims, evidence).select(F.col("query").alias("part"), "n_literals", "similarity", "verified")


@query("""WITH x AS (SELECT vec_id // 10 AS query, vec_id % 10 AS i, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT a.query, a.i AS claim, max(list_cosine_similarity(a.v, b.v)) AS best FROM x a LEFT JOIN x b ON a.query = b.query AND b.i >= 5 WHERE a.i < 5 GROUP BY ALL)
SELECT query, claim, round(coalesce(best, 0), 4) AS similarity, coalesce(best, 0) >= 0.1 AS verified FROM f""")
def c19_semantic(spark, d):
    """C19's vectors: half of each ten are claims of a query, the others its evidence; its vectors are random, hence the lower threshold."""
    x = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("query"), (F.col("vec_id") % 10).alias("claim"), F.lit("无数").alias("text"), F.col("embedding").alias("vec"))
    return answers.grounded(x.where("claim < 5"), x.where("claim >= 5"), least=0.1).select("query", "claim", "similarity", "verified")


@query("""WITH a AS (SELECT p_partkey AS part, ['怎么拆卸皮带', '皮带是什么', '电池更换步骤'][1 + p_partkey % 3] AS q, ['皮带和齿轮', '检查电池，断开负极，防止短路，注意绝缘', '加注机油', '停机断电后装防护罩，检查皮带', '高压电缆'][1 + p_size % 5] AS a FROM part)
SELECT part, CASE WHEN contains(q, '是什么') THEN '' ELSE CASE a WHEN '皮带和齿轮' THEN '旋转部件防护' WHEN '加注机油' THEN '化学品防护' WHEN '高压电缆' THEN '高压电气安全' WHEN '停机断电后装防护罩，检查皮带' THEN '旋转部件防护' ELSE '电池/电源安全' END END AS triggered,
  CASE WHEN contains(q, '是什么') THEN '' ELSE CASE a WHEN '皮带和齿轮' THEN '旋转部件防护' WHEN '加注机油' THEN '化学品防护' WHEN '高压电缆' THEN '高压电气安全' ELSE '' END END AS missing FROM a""")
def c20_danger_audit(spark, d):
    asked = pick(["怎么拆卸皮带", "皮带是什么", "电池更换步骤"], F.col("p_partkey") % 3)
    said = pick(["皮带和齿轮", "检查电池，断开负极，防止短路，注意绝缘", "加注机油", "停机断电后装防护罩，检查皮带", "高压电缆"], F.col("p_size") % 5)
    out = table(spark, d, "part").select(F.col("p_partkey").alias("part"), answers.danger_audit(asked, said).alias("x"))
    return out.select("part", F.array_join("x.triggered", ",").alias("triggered"), F.array_join("x.missing", ",").alias("missing"))


@query("""SELECT o_orderkey AS "case", 'p' || o_custkey || '号轴承磨损>请把p' || o_custkey || '号轴承更换' || CASE WHEN o_custkey % 2 = 0 THEN '|油泵' || o_orderkey || '泄漏>重新把螺栓紧固' ELSE '' END AS pairs FROM orders""")
def c21_fault_pairs(spark, d):
    p = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("号轴承"))
    one = F.concat(F.lit("1. "), p, F.lit("磨损：请把"), p, F.lit("更换。\n"))
    two = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("- 油泵"), F.col("o_orderkey").cast("string"), F.lit("泄漏, 重新把螺栓紧固\n"))).otherwise("好的。\n")
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("case"), answers.fault_pairs(F.concat(one, two, one)).alias("x"))
    return out.select("case", F.array_join(F.transform("x", lambda v: F.concat_ws(">", v["fault"], v["solution"])), "|").alias("pairs"))


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'c' || o_custkey END AS c, o_custkey % 7 AS a, o_orderkey % 5 AS b, o_orderstatus AS s, o_orderkey % 50 = 3 AS leaked FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM c), u AS (SELECT c, unnest([CASE WHEN c = '' THEN 'missing_case_id' WHEN n > 1 THEN 'duplicate_case_id' END, CASE WHEN a = b OR a = 6 OR b = 0 AND a = 0 THEN 'reviewers_not_distinct' END, CASE WHEN s <> 'F' THEN 'not_resolved' END, CASE WHEN leaked THEN 'leaked' END]) AS code FROM n)
SELECT code, count(*) AS n FROM u WHERE code IS NOT NULL GROUP BY code""")
def l9_freeze_issues(spark, d):
    key, name = F.col("o_orderkey"), lambda c: F.concat(F.lit("p"), c.cast("string"))
    cases = table(spark, d, "orders").select(
        F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("case"), name(F.col("o_custkey") % 7).alias("author"), name(key % 5).alias("reviewer_a"),
        F.lit("p6").alias("reviewer_b"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), (key % 50 == 3).alias("leaked"))
    return answers.freeze_issues(cases).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT 's' || l_suppkey % 20 AS device, 'p' || l_partkey AS component FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT component, solution, min(tier) AS tier FROM (SELECT 'p' || l_partkey AS component, 'x' || l_linenumber AS solution, 0 AS tier FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'p' || l_partkey, 'f' || l_suppkey % 7, 1 FROM lineitem WHERE l_quantity < 10) GROUP BY 1, 2),
f AS (SELECT component, string_agg(solution, ',' ORDER BY n) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY tier, solution) AS n FROM b) WHERE n <= 3 GROUP BY component),
r AS (SELECT device, component, coalesce(expected, '') AS expected FROM o LEFT JOIN f USING (component))
SELECT device, component, expected, 'recall_with_device' AS case_type, device AS keyword FROM r UNION ALL SELECT device, component, expected, 'recall_no_device', '' FROM r""")
def l10_golden_cases(spark, d):
    rows, name = table(spark, d, "lineitem"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    part = name("p", F.col("l_partkey")).alias("component")
    owns = rows.where("l_returnflag = 'A'").select(name("s", F.col("l_suppkey") % 20).alias("device"), part)
    return answers.golden_cases(owns, rows.where("l_quantity > 40").select(part, name("x", F.col("l_linenumber")).alias("solution")), rows.where("l_quantity < 10").select(part, name("f", F.col("l_suppkey") % 7).alias("solution")))


@query("""WITH t AS (SELECT ['no_graph', 'graph_shadow', 'graph_full', 'other'][1 + l_orderkey % 4] AS v, l_returnflag = 'R' AS req, CASE WHEN l_orderkey % 4 = 0 AND l_quantity > 49 THEN 1 ELSE 0 END AS used, l_linenumber AS cand, l_partkey % 3 AS b FROM lineitem),
c AS (SELECT 'no_graph_zero_activity' AS "check", used <> 0 AS bad FROM t WHERE v = 'no_graph' UNION ALL SELECT 'graph_shadow_zero_activity', used <> 0 FROM t WHERE v = 'graph_shadow' UNION ALL SELECT 'graph_full_required_chain', b <> 0 OR cand <= 0 FROM t WHERE v = 'graph_full' AND req)
SELECT "check", count(*) AS turns, count(*) FILTER (bad) AS failed, CASE WHEN count(*) FILTER (bad) > 0 THEN 'failed' ELSE 'passed' END AS status FROM c GROUP BY 1""")
def a36_mechanism_gate(spark, d):
    bindings = pick(['[{"emitted": true, "evidence_ids": ["x", "graph:1"]}]', '[{"emitted": false, "evidence_ids": ["graph:1"]}]', "not json"], F.col("l_partkey") % 3)
    used = F.when((F.col("l_orderkey") % 4 == 0) & (F.col("l_quantity") > 49), 1)
    turns = table(spark, d, "lineitem").select(
        pick(["no_graph", "graph_shadow", "graph_full", "other"], F.col("l_orderkey") % 4).alias("variant"), F.when(F.col("l_returnflag") == "R", "Required ").otherwise("none").alias("dependency"),
        bindings.alias("bindings"), used.alias("used"), F.col("l_linenumber").alias("candidates"))
    return answers.mechanism_gate(turns, {"no_graph": ["used"], "graph_shadow": ["used"]}, "graph_full", ["candidates"])


@query("""WITH c AS (SELECT o_orderkey AS claim, o_orderkey AS query, ['manual', 'graph', 'rule'][1 + o_orderkey % 3] AS source, o_custkey % 10 AS doc, o_custkey % 3 AS k FROM orders),
e AS (SELECT l_orderkey AS query, l_linenumber || '-' || l_partkey AS evidence, ['manual', 'graph', 'rule'][1 + l_partkey % 3] AS source, l_suppkey % 10 AS doc, l_linenumber AS page, l_partkey % 3 AS c1, l_suppkey % 3 AS c2, l_returnflag AS st FROM lineitem)
SELECT claim, evidence FROM c JOIN e USING (query, source) WHERE CASE source WHEN 'manual' THEN (k = 0 OR c.doc = e.doc) AND page BETWEEN 1 AND 3 AND (k = 1 OR k IN (c1, c2)) WHEN 'graph' THEN k IN (c1, c2) ELSE st = 'A' END""")
def j21_claim_sources(spark, d):
    key, text = F.col("o_orderkey"), lambda c: c.cast("string")
    k, none = F.col("o_custkey") % 3, F.lit(None).cast("string")
    kinds = ["manual", "graph", "rule"]
    claims = table(spark, d, "orders").select(
        key.alias("claim"), key.alias("query"), pick(kinds, key % 3).alias("source"), F.when(k != 0, text(F.col("o_custkey") % 10)).alias("document"), F.lit("").alias("version"), F.lit(1).alias("page_from"), F.lit(3).alias("page_to"),
        F.when((k == 1) & (key % 3 == 0), F.array().cast("array<string>")).otherwise(F.array(text(k))).alias("chunks"), F.array().cast("array<string>").alias("nodes"), none.alias("rule"), F.lit("A").alias("status"))
    evidence = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("evidence"), pick(kinds, F.col("l_partkey") % 3).alias("source"), text(F.col("l_suppkey") % 10).alias("document"), none.alias("version"), F.col("l_linenumber").alias("page"),
        F.array(text(F.col("l_partkey") % 3), text(F.col("l_suppkey") % 3)).alias("chunks"), F.array(F.lit("n")).alias("nodes"), none.alias("rule"), F.col("l_returnflag").alias("status"))
    return answers.claim_sources(claims, evidence)


@query("""WITH g AS (SELECT p_partkey AS gold, 'c' || p_partkey % 40 AS component, CASE WHEN p_partkey % 3 = 0 THEN 'f' ELSE 'f' || p_size % 6 END AS fault, p_size % 5 AS document, CASE WHEN p_partkey % 4 > 0 THEN 'v' || p_size % 2 ELSE '' END AS version FROM part),
t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS path, 'c' || l_partkey % 40 AS component, 'f' || l_suppkey % 6 AS fault, l_linenumber % 5 AS document, 'v' || l_orderkey % 2 AS version, l_tax < 0.07 AS complete FROM lineitem WHERE l_orderkey % 60 = 1),
f AS (SELECT gold, path, complete, (t.fault = g.fault)::INT AS exact FROM g JOIN t ON g.component = t.component AND g.document = t.document AND (g.version = '' OR g.version = t.version) AND contains(t.fault, g.fault)),
b AS (SELECT * FROM (SELECT *, max(exact) OVER (PARTITION BY gold) AS top FROM f) WHERE exact = top), o AS (SELECT gold, count(*) AS n, min(path) AS path, bool_and(complete) AS complete FROM b GROUP BY gold),
i AS (SELECT gold, path, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN NOT complete THEN 'incomplete_provenance' ELSE '' END AS issue FROM g LEFT JOIN o USING (gold))
SELECT gold, CASE WHEN issue = '' THEN path END AS path, issue FROM i""")
def j22_refresh_gold(spark, d):
    key, name = F.col("p_partkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    golden = table(spark, d, "part").select(key.alias("gold"), name("c", key % 40).alias("component"), F.when(key % 3 == 0, "f").otherwise(name("F", F.col("p_size") % 6)).alias("fault"), (F.col("p_size") % 5).alias("document"), F.when(key % 4 > 0, name("v", F.col("p_size") % 2)).alias("version"), F.lit("").alias("device"))
    paths = table(spark, d, "lineitem").where("l_orderkey % 60 = 1").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("path"), name("c", F.col("l_partkey") % 40).alias("component"), name("f", F.col("l_suppkey") % 6).alias("fault"), (F.col("l_linenumber") % 5).alias("document"),
        name("v", F.col("l_orderkey") % 2).alias("version"), F.lit("d").alias("device"), (F.col("l_tax") < 0.07).alias("complete"))
    return answers.refresh_gold(golden, paths)


@query(ANSWER_SQL + """SELECT part, contains(lower(answer), z) AND k <> 4 AND k > 0 AS said, list_contains(regexp_extract_all(answer, '\\d+'), p_size::VARCHAR) AS numbers_met, contains(lower(answer), z) AND k <> 4 AND k > 0 AND list_contains(regexp_extract_all(answer, '\\d+'), p_size::VARCHAR) AS asserted FROM t""")
def c32_claims(spark, d):
    rows = given(spark, d).select(F.col("part").alias("claim"), F.array("z").alias("terms"), F.array(F.col("p_size").cast("string")).alias("numbers"), "answer")
    return answers.claim_state(rows).withColumnRenamed("claim", "part")


@query("""WITH k AS (SELECT o_orderkey AS "case", o_custkey % 50 AS x, o_orderkey % 4 > 0 AS has_source, 'd' || o_orderkey % 3 AS document, o_orderkey % 3 AS said FROM orders),
e AS (SELECT l_orderkey AS "case", l_quantity::INT AS x, 'd' || l_suppkey % 3 AS document, l_linenumber AS page FROM lineitem WHERE l_returnflag <> 'A'),
m AS (SELECT k."case", count(e.x) > 0 AS text_met, coalesce(bool_or(has_source AND e.document = k.document AND page <= 2), false) AS supported FROM k LEFT JOIN e ON e."case" = k."case" AND e.x = k.x GROUP BY k."case")
SELECT "case", supported, said = 0 AS asserted, said = 2 AS disclosed,
  concat_ws(',', CASE WHEN NOT text_met THEN 'evidence_pattern_missing' WHEN NOT has_source THEN 'allowed_sources_missing' WHEN NOT supported THEN 'allowed_source_missing' END,
    CASE WHEN supported AND said > 0 THEN 'answer_pattern_missing' WHEN NOT supported AND said = 0 THEN 'unsupported_completion' END) AS issues FROM k JOIN m USING ("case")""")
def c32_observed(spark, d):
    """C32 over orders: a claim about a quantity, the items as evidence, answers that say, deny or disclose."""
    key, x = F.col("o_orderkey"), F.concat(F.lit("Qty "), (F.col("o_custkey") % 50).cast("string"))
    none = F.array().cast("array<string>")
    blank = lambda kind="string": F.lit(None).cast(kind)
    document = lambda c: F.concat(F.lit("d"), (c % 3).cast("string"))
    source = F.struct(
        F.lit("manual").alias("source"), document(key).alias("document"), blank().alias("version"), F.array(F.lit(1), F.lit(2)).alias("pages"), none.alias("chunks"), none.alias("nodes"), none.alias("relations"), none.alias("paths"),
        blank().alias("rule"), blank().alias("status"))
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    made = orders.select(key.alias("case"), F.lit("k").alias("claim"), F.array(x).alias("answer_patterns"), F.array(x).alias("evidence_patterns"), F.array(F.lit("no data")).alias("disclosures"), none.alias("forbidden"),
                         F.filter(F.array(source), lambda s: key % 4 > 0).alias("sources"))
    said = orders.select(key.alias("case"), F.when(key % 3 == 0, F.concat(x, F.lit("."))).when(key % 3 == 1, F.concat(F.lit("not found "), x)).otherwise("no data").alias("answer"))
    given = items.select(
        F.col("l_orderkey").alias("case"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("evidence"), F.when(F.col("l_returnflag") == "A", "reference_only").otherwise("qualified").alias("qualification"), F.lit(True).alias("eligible"),
        F.lit(False).alias("bound"), F.concat(F.lit("total qty "), F.col("l_quantity").cast("int").cast("string")).alias("text"), F.lit("manual").alias("source"), document(F.col("l_suppkey")).alias("document"), blank().alias("version"),
        F.array(F.col("l_linenumber").cast("int")).alias("pages"), none.alias("chunks"), none.alias("nodes"), none.alias("relations"), none.alias("paths"), blank().alias("rule"), blank().alias("status"))
    out = claims.observe_claims(made, said, given)
    return out.select("case", "supported", "asserted", "disclosed", F.array_join("issues", ",").alias("issues"))


@query("""WITH e AS (SELECT l_orderkey AS "case", l_linenumber || '-' || l_partkey AS evidence, l_quantity::INT AS x, l_returnflag FROM lineitem),
a AS (SELECT o_orderkey AS "case", o_custkey % 50 AS x, o_orderkey % 2 = 0 AS disclosed FROM orders),
f AS (SELECT a."case", i, disclosed, min(evidence) AS low, max(evidence) AS high FROM a CROSS JOIN (VALUES (0), (1)) v(i) LEFT JOIN e ON e."case" = a."case" AND e.x BETWEEN 1 AND 50 AND (i = 0 AND l_returnflag = 'A' OR i = 1 AND l_returnflag <> 'A') GROUP BY ALL),
c AS (SELECT "case", count(low) AS n_found, coalesce(count(low) = 2 AND min(low) <> max(high), false) AS distinct_, any_value(disclosed) AS disclosed FROM f GROUP BY "case")
SELECT "case", n_found, distinct_ AS "distinct", distinct_ AND disclosed AS passed FROM c""")
def c32_conflicts(spark, d):
    """Two alternatives by return flag; every second answer discloses them and gives both."""
    key = F.col("o_orderkey")
    none, blank = F.array().cast("array<string>"), F.lit(None).cast("string")
    source = F.struct(
        F.lit("domain_rule").alias("source"), blank.alias("document"), blank.alias("version"), F.array().cast("array<int>").alias("pages"), none.alias("chunks"), none.alias("nodes"), none.alias("relations"), none.alias("paths"), blank.alias("rule"), blank.alias("status"))
    side = lambda word: F.struct(F.array(F.lit(word)).alias("values"), F.array(F.lit("qty")).alias("units"), F.array(source).alias("sources"))
    made = table(spark, d, "orders").select(key.alias("case"), F.lit("k").alias("conflict"), F.array(F.lit("conflict")).alias("disclosures"), F.array(side("flag a"), side("other")).alias("alternatives"))
    said = table(spark, d, "orders").select(key.alias("case"), F.when(key % 2 == 0, "Conflict: flag A qty, other qty").otherwise("flag a qty").alias("answer"))
    given = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("evidence"), F.lit("reference_only").alias("qualification"), F.lit(True).alias("eligible"), F.lit(False).alias("bound"),
        F.concat(F.when(F.col("l_returnflag") == "A", "flag A").otherwise("other"), F.lit(" qty")).alias("text"), F.lit("domain_rule").alias("source"), blank.alias("document"), blank.alias("version"), F.array().cast("array<int>").alias("pages"),
        none.alias("chunks"), none.alias("nodes"), none.alias("relations"), none.alias("paths"), blank.alias("rule"), blank.alias("status"))
    return claims.observe_conflicts(made, said, given).drop("conflict")
