"""Registered queries of candidates, names, sections and cross checks, each with the DuckDB SQL that says the same."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .operators import candidates
from .queries import query
from .sources.tables import in_parts, table
from .text_queries import HAN, LETTERS, PARTS_SQL, han, parts


def pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), n.cast("int"))


@query("""WITH q AS (SELECT o_orderkey AS query, ['', 'brand#1', 'Brand#2', 'STANDARD'][1 + o_orderkey % 4] AS n, ['', 'standard', 'PROMO', 'x'][1 + o_custkey % 4] AS c, ['', 'size 1', 'Size-3'][1 + o_orderkey % 3] AS m, o_orderstatus <> 'P' AS explicit, (o_orderkey % (SELECT count(*) FROM part)) AS p FROM orders),
d AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS n, CASE WHEN p_partkey % 3 = 0 THEN [p_type] ELSE [] END AS al, p_type AS c, CASE WHEN p_partkey % 2 = 0 THEN 'SIZE ' || p_size % 5 ELSE '' END AS m FROM part),
k AS (SELECT query, explicit, regexp_replace(lower(q.n), '[^a-z0-9]+', '', 'g') AS qn, regexp_replace(lower(q.c), '[^a-z0-9]+', '', 'g') AS qc, regexp_replace(lower(q.m), '[^a-z0-9]+', '', 'g') AS qm,
  list_filter(list_transform(list_concat([d.n], al), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS dn, lower(d.c) AS dc, regexp_replace(lower(d.m), '[^a-z0-9]+', '', 'g') AS dm FROM q JOIN d USING (p)),
r AS (SELECT *, qn <> '' AND list_contains(dn, qn) AS fits, concat_ws(',', CASE WHEN qn <> '' AND len(dn) > 0 AND NOT list_contains(dn, qn) AND qn <> qc THEN 'name' END, CASE WHEN qm <> '' AND dm <> '' AND qm <> dm THEN 'model' END) AS conflicts FROM k)
SELECT query, CASE WHEN NOT explicit THEN 'uncertain' WHEN conflicts <> '' THEN 'unmatched' WHEN fits AND qn <> qc OR qc <> '' AND qc = dc AND qm <> '' AND qm = dm THEN 'matched' ELSE 'uncertain' END AS relation, CASE WHEN explicit THEN conflicts ELSE '' END AS conflicts FROM r""")
def f5_identity(spark: SparkSession, d: str):
    key, n = F.col("o_orderkey"), table(spark, d, "part").count()
    asked = table(spark, d, "orders").select(
        key.alias("query"), pick(["", "brand#1", "Brand#2", "STANDARD"], key % 4).alias("q_name"), pick(["", "standard", "PROMO", "x"], F.col("o_custkey") % 4).alias("q_category"),
        pick(["", "size 1", "Size-3"], key % 3).alias("q_model"), (F.col("o_orderstatus") != "P").alias("q_explicit"), (key % n).alias("p"), F.lit(None).cast("string").alias("q_carrier"), F.lit("").alias("q_manufacturer"))
    part = F.col("p_partkey")
    known = table(spark, d, "part").select(
        part.alias("p"), F.when(part % 5 != 0, F.col("p_brand")).otherwise("").alias("d_name"), F.when(part % 3 == 0, F.array("p_type")).alias("d_aliases"), F.col("p_type").alias("d_category"),
        F.when(part % 2 == 0, F.concat(F.lit("SIZE "), (F.col("p_size") % 5).cast("string"))).alias("d_model"), F.lit("x").alias("d_carrier"), F.lit(None).cast("string").alias("d_manufacturer"))
    return candidates.identity(asked.join(known, "p")).select("query", "relation", F.array_join("conflicts", ",").alias("conflicts"))


@query("""WITH q AS (SELECT o_orderkey AS query, CASE WHEN o_orderkey % 7 = 0 THEN 's' || o_custkey % 150 END AS requested, CASE WHEN o_orderkey % 5 = 0 THEN 's' || o_custkey % 130 END AS session, o_orderstatus = 'O' AS explicit FROM orders),
cat AS (SELECT 's' || s_suppkey AS document, s_suppkey AS place FROM supplier), l AS (SELECT l_orderkey AS query, 's' || l_suppkey AS document, l_suppkey AS place, l_returnflag FROM lineitem WHERE l_linenumber <= 2),
i AS (SELECT query, string_agg(document, ',' ORDER BY place) AS ids, count(*) AS n FROM (SELECT DISTINCT query, document, place FROM l JOIN cat USING (document, place) WHERE l_returnflag = 'A') GROUP BY query),
s AS (SELECT query, string_agg(document, ',' ORDER BY place) AS ids, count(*) AS n FROM (SELECT DISTINCT query, document, place FROM l JOIN cat USING (document, place) WHERE l_returnflag = 'N') GROUP BY query),
r AS (SELECT q.*, coalesce(i.ids, '') AS ii, coalesce(i.n, 0) AS ni, coalesce(s.ids, '') AS si, coalesce(s.n, 0) AS ns, requested IN (SELECT document FROM cat) AS rk, session IN (SELECT document FROM cat) AS sk FROM q LEFT JOIN i USING (query) LEFT JOIN s USING (query)),
x AS (SELECT *, CASE WHEN requested IS NOT NULL THEN CASE WHEN NOT rk THEN 'requested_document_not_in_catalog' WHEN explicit AND NOT list_contains(string_split(ii, ','), requested) THEN 'explicit_identity_conflicts_with_requested_document' ELSE 'request_document' END
  WHEN explicit THEN CASE WHEN ni = 1 THEN 'unique_identity_match' WHEN ni > 1 THEN 'multiple_identity_matches' ELSE 'no_matching_device_document' END WHEN session IS NOT NULL AND sk THEN 'session_document' WHEN ns = 1 THEN 'unique_section_match' WHEN ns > 1 THEN 'multiple_section_matches' ELSE 'no_matching_document' END AS reason FROM r)
SELECT query, reason, CASE WHEN reason IN ('request_document', 'unique_identity_match', 'session_document', 'unique_section_match') THEN 'grounded' WHEN reason LIKE 'multiple%' THEN 'clarify' ELSE 'fallback' END AS state,
  CASE reason WHEN 'request_document' THEN requested WHEN 'session_document' THEN session WHEN 'unique_identity_match' THEN ii WHEN 'multiple_identity_matches' THEN ii WHEN 'unique_section_match' THEN si WHEN 'multiple_section_matches' THEN si ELSE '' END AS documents FROM x""")
def f11_resolve_document(spark, d):
    key, name = F.col("o_orderkey"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    asked = table(spark, d, "orders").select(key.alias("query"), F.when(key % 7 == 0, name(F.col("o_custkey") % 150)).alias("requested"), F.when(key % 5 == 0, name(F.col("o_custkey") % 130)).alias("session"), (F.col("o_orderstatus") == "O").alias("explicit"))
    hits = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("query"), name(F.col("l_suppkey")).alias("document"), F.when(F.col("l_returnflag") == "A", "matched").otherwise("uncertain").alias("relation"), "l_returnflag")
    catalog = table(spark, d, "supplier").select(name(F.col("s_suppkey")).alias("document"), F.col("s_suppkey").alias("place"))
    out = candidates.resolve_document(asked, hits, hits.where("l_returnflag = 'N'"), catalog)
    return out.select("query", "state", F.array_join("documents", ",").alias("documents"), "reason")


NAMES_SQL = f"SELECT p_partkey AS part, ['', 'ends。', 'a=b气', '气', p_name, 'PGN 气', '总成', '设备', translate(p_name, '{LETTERS}', '{HAN}'), 'AB12气'][1 + p_partkey % 10] AS t FROM part"


def odd_names(spark, d):
    names = [F.lit(x) for x in ("", "ends。", "a=b气", "气")] + [F.col("p_name")] + [F.lit(x) for x in ("PGN 气", "总成", "设备")] + [F.translate("p_name", LETTERS, HAN), F.lit("AB12气")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.get(F.array(*names), (F.col("p_partkey") % 10).cast("int")).alias("t"))


@query("WITH n AS (" + NAMES_SQL + r""")
SELECT part, CASE WHEN trim(t) = '' THEN 'empty' WHEN regexp_matches(t, '[。！？!?：:]$') THEN 'sentence' WHEN contains(t, '=') THEN 'formula' WHEN length(trim(t)) < 2 THEN 'short' WHEN length(trim(t)) > 12 THEN 'long' WHEN NOT regexp_matches(t, '[\x{4e00}-\x{9fff}]') THEN 'no_han'
  WHEN regexp_matches(t, '[A-Za-z]{2,}\s*\d{2,}|PGN') THEN 'protocol' WHEN t = '总成' THEN 'structure' WHEN t = '设备' THEN 'device' END AS reason FROM n""")
def f10_component_gate(spark, d):
    return odd_names(spark, d).select("part", candidates.component_gate(F.col("t"), F.lit(" 设备")).alias("reason"))


@query("WITH n AS (" + NAMES_SQL + r""")
SELECT DISTINCT part % 40 AS document, t AS part FROM n WHERE part % 10 IN (7, 8) AND part % 3 <> 0 AND length(trim(t)) BETWEEN 2 AND 12 AND regexp_matches(t, '[\x{4e00}-\x{9fff}]')""")
def a7_part_inventory(spark, d):
    label = F.when(F.col("part") % 3 != 0, "table_row").otherwise("step")
    return candidates.part_inventory(odd_names(spark, d).select((F.col("part") % 40).alias("document"), label.alias("label"), F.when((F.col("part") % 10).isin(7, 8), F.col("t")).otherwise(" ").alias("part_name")))


@query(f"""SELECT l_orderkey AS part, CASE k WHEN 0 THEN NULL WHEN 1 THEN '安装' WHEN 2 THEN '检查' WHEN 3 THEN '拆卸' END AS action, CASE WHEN k > 0 THEN t END AS target, CASE k WHEN 0 THEN NULL ELSE 'proc:' || left(sha1(CASE k WHEN 1 THEN '安装' WHEN 2 THEN '检查' ELSE '拆卸' END || '|' || t), 12) END AS scope
FROM (SELECT p_partkey AS l_orderkey, p_partkey % 4 AS k, translate(replace(p_name, ' ', ''), '{LETTERS}', '{HAN}') AS t FROM part)""")
def c28_procedure_scope(spark, d):
    name, k = F.translate("p_name", LETTERS, HAN), F.col("p_partkey") % 4
    heading = F.when(k == 0, F.concat(F.lit("安装"), name, F.lit("，然后检查"))).otherwise(F.concat(F.get(F.array(*map(F.lit, ["", "3.2 装配 ", "第4节 测量", "12拆除"])), k.cast("int")), name))
    s = candidates.procedure_scope(heading)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), s["scope"].alias("scope"), s["action"].alias("action"), s["target"].alias("target"))


@query("""WITH c AS (SELECT l_suppkey AS document, l_partkey % 5 AS section, l_partkey % 7 || '.' || l_linenumber || ' ' || p_name AS title, trim(p_name) AS core, p_name, l_returnflag, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS seq FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT document, section, arg_max(core, {'n': length(core), 's': -seq}) AS core, arg_max(title, {'n': length(core), 's': -seq}) AS title, count(*) FILTER (l_returnflag <> 'R') AS n_texts FROM c GROUP BY document, section""")
def a6_section_index(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    title = F.concat((F.col("l_partkey") % 7).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" "), "p_name")
    return candidates.section_index(rows.select(F.col("l_suppkey").alias("document"), (F.col("l_partkey") % 5).alias("section"), title.alias("title"), F.when(F.col("l_returnflag") != "R", "x").otherwise(" ").alias("text"),
                                                (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("seq")))


@query("""WITH q AS (SELECT item_id AS query, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM benchmark), s AS (SELECT DISTINCT regexp_replace(lower(left(text, 3 + doc_id % 4)), '[^\\p{L}\\p{N}]+', '', 'g') AS key, doc_id AS document FROM documents WHERE text IS NOT NULL),
k AS (SELECT * FROM s WHERE length(key) >= 2), f AS (SELECT query, key FROM q JOIN (SELECT DISTINCT key FROM k) ON contains(t, key)),
m AS (SELECT query, key FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.query = a.query AND b.key <> a.key AND contains(b.key, a.key)))
SELECT query, document, place FROM (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY length(key) DESC, document) AS place FROM m JOIN k USING (key)) WHERE place <= 3""")
def j11_section_titles(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document"), F.lit(0).alias("section"), F.left("text", (3 + F.col("doc_id") % 4).cast("int")).alias("core"))
    return candidates.sections_in(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), docs).drop("section")


@query("""WITH q AS (SELECT item_id AS query, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t, ['', 'economy', 'promo'][1 + item_id % 3] AS device FROM benchmark),
r AS (SELECT p_partkey AS rule, lower(p_type) AS own, list_transform(split(p_name, ' '), lambda x: left(x, 3)) AS s FROM part),
k AS (SELECT rule, own, len(s) AS n, unnest(s) AS symptom FROM r),
f AS (SELECT DISTINCT query, rule, n, symptom FROM k JOIN q ON contains(t, lower(symptom)) AND (device = '' OR device = own))
SELECT query, rule, string_agg(symptom, ',' ORDER BY symptom) AS symptoms, round(count(*) / n::DOUBLE, 6) AS ratio FROM f GROUP BY query, rule, n""")
def j10_rule_matches(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text", pick(["", "Economy", "PROMO"], F.col("item_id") % 3).alias("device"))
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_type").alias("device"), F.transform(F.split("p_name", " "), lambda x: F.left(x, F.lit(3))).alias("symptoms"))
    return candidates.rule_matches(asked, rules)


@query("""WITH c AS (SELECT p_partkey AS chunk, p_partkey // 20 AS document, p_partkey % 20 // 5 AS section, CASE WHEN p_partkey % 6 = 0 THEN 'image' ELSE 'text' END AS kind, p_size AS si, CASE WHEN p_partkey % 9 = 0 THEN 'session' END AS rt FROM part),
h AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, l_partkey AS source, (l_quantity / 50)::DOUBLE AS sc FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber, arg_min(l_quantity, (l_linenumber, l_quantity)) AS l_quantity FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1, 2)),
k AS (SELECT chunk, unnest([1, 2]) AS n, unnest([chunk + 1, chunk + 40]) AS ref, unnest(['next_chunk', 'related_step']) AS reason FROM c),
r0 AS (SELECT query, source, sc, ref AS chunk, reason, place, n FROM h JOIN k ON k.chunk = h.source WHERE (query, ref) NOT IN (SELECT (query, source) FROM h)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place, n) AS o FROM (SELECT *, row_number() OVER (PARTITION BY query, chunk ORDER BY place, n) AS d FROM r0) WHERE d = 1),
r AS (SELECT query, source, sc, chunk, reason, 0 AS tier, place, n AS n1, 0 AS n2, '' AS n3 FROM r1 JOIN (SELECT chunk FROM c WHERE rt IS NULL) USING (chunk) WHERE o <= 6),
p AS (SELECT query, document, section, min({'place': h.place, 'source': h.source, 'sc': h.sc}) AS s FROM h JOIN c ON c.chunk = h.source GROUP BY query, document, section),
nr AS (SELECT query, s.source AS source, s.sc AS sc, c.chunk, 'section_context' AS reason, 1 AS tier, s.place AS place, (kind = 'image')::INT AS n1, si * 100000 - 1 AS n2, c.chunk::VARCHAR AS n3 FROM p JOIN c USING (document, section)
  WHERE (query, c.chunk) NOT IN (SELECT (query, source) FROM h) AND (query, c.chunk) NOT IN (SELECT (query, chunk) FROM r)),
a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, place, n1, n2, n3) AS o FROM (SELECT * FROM r UNION ALL SELECT * FROM nr))
SELECT query, chunk, source, reason, round(greatest(0, sc - 0.05), 6) AS score, o AS place FROM a WHERE o <= 6""")
def j15_expand(spark, d):
    from pyspark.sql import Window

    key = F.col("p_partkey")
    chunks = table(spark, d, "part").select(key.alias("chunk"), F.floor(key / 20).alias("document"), F.floor(key % 20 / 5).alias("section"), F.when(key % 6 == 0, "image").otherwise("text").alias("kind"),
                                            F.col("p_size").alias("source_index"), F.lit(None).cast("int").alias("row_index"), F.when(key % 9 == 0, "session").alias("record_type"))
    lines = table(spark, d, "lineitem").where("l_orderkey % 20 = 0")  # the stated query set
    hits = lines.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_quantity")).alias("s"))
    order = Window.partitionBy("l_orderkey").orderBy("s.l_linenumber", "l_partkey")
    hits = hits.select(F.col("l_orderkey").alias("query"), F.row_number().over(order).alias("place"), F.col("l_partkey").alias("chunk"), (F.col("s.l_quantity") / 50).alias("score"))
    links = chunks.select("chunk", F.explode(F.array(F.struct(F.lit(1).alias("n"), (F.col("chunk") + 1).alias("ref"), F.lit("next_chunk").alias("reason")), F.struct(F.lit(2).alias("n"), (F.col("chunk") + 40).alias("ref"), F.lit("related_step").alias("reason")))).alias("l")).select("chunk", "l.*")
    return candidates.expand(hits, links, chunks)


SCORED_SQL = PARTS_SQL + """
, pr AS (SELECT a.part AS query, b.part AS chunk, a.terms AS q, a.low AS ql, b.low AS cl, b.terms AS ct FROM terms a JOIN terms b ON b.part BETWEEN a.part AND a.part + 3),
ft AS (SELECT query, chunk, len(list_filter(q, lambda x: contains(cl, x))) / greatest(len(q), 1)::DOUBLE AS cov, len(list_filter(q, lambda x: contains(left(cl, 4), x))) / greatest(len(q), 1)::DOUBLE AS tcov,
  len(list_intersect(regexp_extract_all(ql, '\\d+'), regexp_extract_all(cl, '\\d+'))) AS nums, contains(ql, left(cl, 4)) AS titled, length(regexp_replace(cl, '\\s+', '', 'g')) AS n,
  ['parameter', 'image_identification', 'procedure', 'diagnosis', 'outline', 'general'][1 + query % 6] AS intent, ['text', 'table', 'image', 'outline', 'step_raw'][1 + chunk % 5] AS kind, ['step', 'table_row', 'safety', 'general', 'image', 'outline', 'troubleshooting'][1 + chunk % 7] AS label, chunk % 3 AS r FROM pr),
sc AS (SELECT *, (chunk % 10) / 10.0::DOUBLE AS base, r > 0 AS fused, cov >= 0.18 OR nums > 0 AS st FROM ft)
"""


@query(SCORED_SQL + """SELECT query, chunk, round(greatest(0, least(1, base * CASE WHEN fused THEN 0.75 ELSE 0.62 END + least(0.3, cov * 0.36) + least(0.14, tcov * 0.2) + CASE WHEN r = 2 THEN 0.14 WHEN titled THEN 0.1 ELSE 0 END + least(0.1, nums * 0.05)
 + least(0.09, r * 0.035) + least(0.08, (1 + (r >= 1)::INT) * 0.02)
 + CASE intent WHEN 'parameter' THEN CASE WHEN kind = 'table' AND st THEN 0.045 ELSE 0 END + CASE WHEN label = 'table_row' AND st THEN 0.035 ELSE 0 END + CASE WHEN kind = 'text' AND cov >= 0.3 THEN 0.04 ELSE 0 END - CASE WHEN kind = 'table' AND cov < 0.1 AND nums = 0 THEN 0.07 ELSE 0 END + CASE WHEN chunk % 2 = 0 THEN 0.08 ELSE 0 END
   WHEN 'image_identification' THEN CASE WHEN kind = 'image' THEN 0.18 ELSE 0 END + CASE WHEN label = 'image' THEN 0.08 ELSE 0 END + CASE WHEN kind = 'image' AND tcov >= 0.6 THEN 0.14 WHEN kind = 'image' AND tcov >= 0.35 THEN 0.07 ELSE 0 END - CASE WHEN kind = 'text' AND cov < 0.25 THEN 0.08 WHEN kind = 'text' AND tcov < 0.6 THEN 0.03 ELSE 0 END
   WHEN 'procedure' THEN CASE WHEN r = 2 THEN 0.05 ELSE 0 END + CASE WHEN label = 'step' THEN 0.075 ELSE 0 END + CASE WHEN kind = 'text' AND cov >= 0.18 THEN 0.035 ELSE 0 END - CASE WHEN kind = 'table' AND cov < 0.2 THEN 0.06 ELSE 0 END
   WHEN 'diagnosis' THEN CASE WHEN label IN ('step', 'troubleshooting') THEN 0.06 ELSE 0 END - CASE WHEN kind = 'table' AND cov < 0.2 THEN 0.05 ELSE 0 END
   WHEN 'outline' THEN CASE WHEN kind = 'table' OR label = 'table_row' THEN 0.1 ELSE 0 END - CASE WHEN label = 'step' OR kind = 'step_raw' THEN 0.08 ELSE 0 END ELSE 0 END
 + CASE WHEN label = 'safety' AND cov >= 0.18 THEN 0.045 ELSE 0 END - CASE WHEN kind = 'outline' AND intent <> 'outline' THEN 0.22 ELSE 0 END - CASE WHEN chunk % 8 = 0 AND intent <> 'outline' THEN 0.16 ELSE 0 END
 + CASE WHEN r = 2 THEN 0 ELSE CASE WHEN n < 18 THEN CASE WHEN fused THEN -0.01 ELSE -0.045 END WHEN n BETWEEN 40 AND 900 THEN 0.025 ELSE 0 END - CASE WHEN label = 'outline' AND intent <> 'outline' THEN 0.025 ELSE 0 END + CASE WHEN chunk % 4 = 1 THEN 0.015 ELSE 0 END END
 - CASE WHEN chunk % 6 = 5 THEN 0.06 ELSE 0 END)), 6) AS score FROM sc""")
def k4_structural_score(spark, d):
    from .operators import chunking

    rows = parts(spark, d).select("part", chunking.normal(F.col("text")).alias("low")).withColumn("terms", chunking.query_terms(F.col("low")))
    asked = rows.select(F.col("part").alias("query"), F.col("terms").alias("q"), F.col("low").alias("ql"), F.explode(F.sequence("part", F.col("part") + 3)).alias("chunk"))
    pairs = asked.join(rows.select(F.col("part").alias("chunk"), F.col("low").alias("cl")), "chunk")
    title, r, chunk = F.left("cl", F.lit(4)), F.col("chunk") % 3, F.col("chunk")
    relaxed = F.when(chunk % 6 == 5, F.array(F.lit("semantic_relaxed"))).otherwise(F.array(F.lit("semantic")))
    routes = F.concat(relaxed, F.slice(F.array(F.lit("keyword"), F.lit("section_match")), 1, r.cast("int")))
    nums = chunking.overlap_count(chunking.numbers_of(F.col("ql")), chunking.numbers_of(F.col("cl")))
    score = candidates.structural_score({
        "intent": pick(["parameter", "image_identification", "procedure", "diagnosis", "outline", "general"], F.col("query") % 6), "base": chunk % 10 / 10, "fused": r > 0,
        "coverage": chunking.coverage(F.col("q"), F.col("cl")), "title_coverage": chunking.coverage(F.col("q"), title), "title_hits": chunking.coverage(F.col("q"), title), "units": F.lit(0), "numbers": nums,
        "titled": F.contains("ql", title), "routes": routes, "planned": F.when(chunk % 6 == 5, F.array(F.lit("semantic_relaxed"), F.lit("keyword"))).otherwise(F.array(F.lit("semantic"), F.lit("keyword"))),
        "type": pick(["text", "table", "image", "outline", "step_raw"], chunk % 5), "label": pick(["step", "table_row", "safety", "general", "image", "outline", "troubleshooting"], chunk % 7),
        "named": chunk % 2 == 0, "length": F.length(F.regexp_replace("cl", chunking.SPACE, "")), "navigation": chunk % 8 == 0, "linked": chunk % 4 == 1})
    return pairs.select("query", "chunk", score.alias("score"))


@query("SELECT l_orderkey AS query, l_linenumber AS line, l_partkey AS candidate, round(greatest(0, least(1, 0.30 * l_discount * 10 + 0.25 * l_tax * 10 + 0.20 * l_quantity / 50 + 0.15 * (l_partkey % 7) / 7 + 0.10 * (l_suppkey % 3) / 2)), 6) AS score FROM lineitem")
def c34_clarification_score(spark, d):
    score = candidates.clarification_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_partkey") % 7 / 7, F.col("l_suppkey") % 3 / 2)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("candidate"), score.alias("score"))


@query(PARTS_SQL + """, q AS (SELECT part AS query, part // 10 AS document, regexp_split_to_array(replace(p_name, ' ', '和'), '和') AS w FROM p WHERE part % 20 = 0),
pg AS (SELECT part // 10 AS document, part AS page, replace(p_name, ' ', '') AS t, CASE WHEN part % 3 = 0 THEN left(p_name, 3) ELSE '' END AS i FROM p WHERE part % 4 <> 3),
tm AS (SELECT DISTINCT query, document, substr(x, s, n) AS term FROM (SELECT query, document, x, s, unnest(range(2, least(8, length(x) - s + 1) + 1)) AS n FROM (SELECT query, document, x, unnest(range(1, length(x))) AS s FROM (SELECT query, document, unnest(w) AS x FROM q))) UNION SELECT query, document, unnest(w) FROM q),
h AS (SELECT query, tm.document, page, term, contains(t, term) AS a, i <> '' AND contains(i, term) AS b FROM tm JOIN pg USING (document) WHERE contains(t, term) OR i <> '' AND contains(i, term)),
df AS (SELECT query, term, count(*) AS df FROM h GROUP BY query, term), n AS (SELECT document, count(*) AS n FROM pg GROUP BY document)
SELECT query, page, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS place FROM (
  SELECT query, page, round(sum((ln((n + 1) / (df + 0.5)) + 1) * (0.2 + least(length(term), 8) * 0.28) * (a::INT + 1.5 * b::INT)), 6) AS score FROM h JOIN df USING (query, term) JOIN n USING (document) GROUP BY query, page)""")
def a30_rank_pages(spark, d):
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("page"), F.floor(key / 10).alias("document"), F.col("p_name").alias("text"), F.when(key % 3 == 0, F.left("p_name", F.lit(3))).alias("image_text"), (key % 4 != 3).cast("int").alias("n_images"))
    asked = rows.where("page % 20 = 0").select(F.col("page").alias("query"), "document", F.replace("text", F.lit(" "), F.lit("和")).alias("text"))  # the stated query set
    return candidates.rank_pages(asked, rows)


@query("""WITH q AS (SELECT p_partkey AS query, p_partkey // 10 AS document FROM part WHERE p_partkey % 20 = 0), pg AS (SELECT p_partkey // 10 AS document, p_partkey AS page FROM part WHERE p_partkey % 4 <> 3),
b AS (SELECT query, page, CASE WHEN page % 5 = 0 THEN NULL ELSE page % 3 END::DOUBLE AS score FROM q JOIN pg USING (document) WHERE page % 2 = 0)
SELECT query, page, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS place FROM b WHERE score > 0""")
def a30_base_scores(spark, d):
    """A30's base scores alone: questions without a term of two characters."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("page"), F.floor(key / 10).alias("document"), F.col("p_name").alias("text"), F.lit("").alias("image_text"), (key % 4 != 3).cast("int").alias("n_images"))
    asked = rows.where("page % 20 = 0").select(F.col("page").alias("query"), "document", F.lit("和 x").alias("text"))
    base = asked.select("query", "document").join(rows.select("document", "page"), "document").where("page % 2 = 0")
    return candidates.rank_pages(asked, rows, base.select("query", "page", F.when(F.col("page") % 5 != 0, F.col("page") % 3).alias("score")))


@query("""WITH c AS (SELECT l_orderkey AS query, l_returnflag AS a, (l_partkey % 3)::VARCHAR AS b, CASE WHEN l_quantity > 40 THEN '' ELSE l_linestatus END AS c FROM lineitem),
u AS (SELECT query, 0 AS tie, 'feature' AS dimension, a AS v FROM c UNION ALL SELECT query, 1, 'part', b FROM c UNION ALL SELECT query, 2, 'check', c FROM c),
g AS (SELECT query, tie, dimension, v, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT query, tie, dimension, sum(n) AS total, coalesce(sum(n) FILTER (v = ''), 0) AS open, count(*) FILTER (v <> '') AS n_values, sum(n * log2(n)) AS rest FROM g GROUP BY ALL),
r AS (SELECT *, round(1 - rest / total / log2(total), 6) AS gain FROM s WHERE n_values >= 2 AND open = 0)
SELECT query, dimension, gain, n_values FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, tie) AS p FROM r) WHERE p = 1""")
def a31_discriminator(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_returnflag").alias("feature"), (F.col("l_partkey") % 3).alias("part"), F.when(F.col("l_quantity") <= 40, F.col("l_linestatus")).alias("check"))
    return candidates.best_discriminator(rows, ["feature", "part", "check"])


@query("""WITH c AS (SELECT l_orderkey AS query, ['high', 'medium', 'low'][1 + l_orderkey % 3] AS risk, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE round(l_discount * 10, 2) END AS score, l_returnflag AS a, (l_partkey % 7)::VARCHAR AS b, CASE WHEN l_quantity > 40 THEN ' ' ELSE l_linestatus END AS c FROM lineitem),
w0 AS (SELECT *, greatest(coalesce(score, 0), 0.001) AS x FROM c), w AS (SELECT *, x / sum(x) OVER (PARTITION BY query) AS w FROM w0),
e AS (SELECT query, -sum(w * log2(w)) AS entropy FROM w GROUP BY query),
u AS (SELECT query, risk, w, 0 AS tie, 'component' AS dimension, a AS v FROM w UNION ALL SELECT query, risk, w, 1, 'symptom', b FROM w UNION ALL SELECT query, risk, w, 2, 'other', trim(c) FROM w),
g AS (SELECT query, risk, tie, dimension, v, sum(w) AS p, count(*) AS n, sum(w * log2(w)) AS wl FROM u WHERE v <> '' GROUP BY ALL),
d AS (SELECT query, risk, tie, dimension, count(*) AS n_values, sum(p * log2(p) - wl) AS rest, 1 - sum(p * p) AS evidence, coalesce(sum(p) FILTER (n = 1), 0) AS one_turn FROM g GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT d.*, CASE WHEN abs(entropy) < 1e-12 THEN 1 ELSE (entropy - rest) / entropy END AS gain, CASE WHEN dimension = 'component' AND risk <> 'low' OR dimension = 'symptom' AND risk = 'medium' THEN 1 ELSE 0.5 END AS reduction, CASE WHEN n_values <= 4 THEN 1 ELSE 0.6 END AS answerability, 0.03 * greatest(0, n_values - 2) AS cost FROM d JOIN e USING (query)),
s AS (SELECT *, round(0.45 * gain + 0.3 * reduction + 0.15 * answerability + 0.1 * evidence + 0.25 * one_turn * one_turn - cost, 6) AS score FROM f)
SELECT query, dimension, score, round(gain, 6) AS gain, reduction::DOUBLE AS reduction, answerability::DOUBLE AS answerability, round(evidence, 6) AS evidence, round(one_turn, 6) AS one_turn, cost::DOUBLE AS cost, n_values FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, tie) = 1""")
def a31_question(spark, d):
    """A31 with weights: an order's items as candidates of a diagnosis."""
    risk = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("l_orderkey") % 3).cast("int"))
    rows = in_parts(table(spark, d, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("query"), risk.alias("risk"), F.when(F.col("l_partkey") % 5 != 0, F.round(F.col("l_discount") * 10, 2)).alias("score"), F.col("l_returnflag").alias("component"), (F.col("l_partkey") % 7).alias("symptom"),
        F.when(F.col("l_quantity") > 40, " ").otherwise(F.col("l_linestatus")).alias("other"))
    return candidates.best_question(rows, ["component", "symptom", "other"])


@query("""WITH m AS (SELECT p_partkey AS evidence, p_partkey % 200 AS document, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'v' || p_size % 3 END AS version, p_partkey AS chunk, p_size % 4 AS section, p_size % 10 AS page FROM part),
g AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS path, l_partkey % 200 AS document, 'v' || l_linenumber % 3 AS version, l_partkey AS chunk, l_suppkey % 4 AS section, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R')
SELECT evidence, path, ['chunk', 'section', 'page'][min(CASE WHEN m.chunk = g.chunk THEN 1 WHEN m.section = g.section THEN 2 ELSE 3 END)] AS by FROM m JOIN g USING (document) WHERE (m.version = '' OR m.version = g.version) AND (m.chunk = g.chunk OR m.section = g.section OR m.page = g.page) GROUP BY evidence, path""")
def j19_corroborated(spark, d):
    key, one = F.col("p_partkey"), lambda c: F.array(c.cast("long"))
    manual = table(spark, d, "part").select(key.alias("evidence"), (key % 200).alias("document"), F.when(key % 3 != 0, F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string"))).alias("version"), one(key).alias("chunks"), one(F.col("p_size") % 4).alias("sections"), one(F.col("p_size") % 10).alias("pages"))
    graph = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("path"), (F.col("l_partkey") % 200).alias("document"), F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("version"),
        one(F.col("l_partkey")).alias("chunks"), one(F.col("l_suppkey") % 4).alias("sections"), one(F.col("l_linenumber")).alias("pages"))
    return candidates.corroborated(manual, graph)


@query("""WITH g AS (SELECT l_orderkey AS query, l_returnflag = 'A' AS component, l_linestatus = 'O' AS fault, l_suppkey::VARCHAR AS document, 'v' || l_linenumber % 2 AS version, CASE WHEN l_quantity > 20 THEN 's' ELSE '' END AS section, l_partkey % 3 AS chunks, l_tax < 0.06 AS q FROM lineitem),
m AS (SELECT l_orderkey AS query, l_suppkey::VARCHAR AS document, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'v1' END AS version FROM lineitem WHERE l_discount > 0.03 AND contains(['ECONOMY', 'replace', 'x'][1 + l_partkey % 3], 'replace')),
f AS (SELECT query, bool_or(component) AS component, bool_or(fault) AS fault, bool_or(section <> '' AND chunks > 0) AS complete FROM g WHERE q GROUP BY query),
s AS (SELECT DISTINCT g.query FROM g JOIN m ON m.query = g.query AND m.document = g.document AND (m.version = '' OR m.version = g.version) WHERE g.q)
SELECT DISTINCT a.query, coalesce(component, false) AS component, coalesce(fault, false) AS fault, s.query IS NOT NULL AS solution, coalesce(complete, false) AND s.query IS NOT NULL AS provenance FROM (SELECT DISTINCT query FROM g) a LEFT JOIN f USING (query) LEFT JOIN s ON s.query = a.query""")
def a38_graph_manual(spark, d):
    rows, key = table(spark, d, "lineitem"), F.col("l_orderkey").alias("query")
    graph = rows.select(key, F.col("l_linenumber").alias("path"), F.when(F.col("l_returnflag") == "A", "c").alias("component"), F.when(F.col("l_linestatus") == "O", "f").otherwise(" ").alias("fault"), F.col("l_suppkey").cast("string").alias("document"),
                        F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string")).alias("version"), F.when(F.col("l_quantity") > 20, "s").alias("section"), (F.col("l_partkey") % 3).alias("n_chunks"), F.lit(1).alias("n_pages"), (F.col("l_tax") < 0.06).alias("qualified"))
    manual = rows.select(key, F.col("l_suppkey").cast("string").alias("document"), F.when(F.col("l_partkey") % 2 != 0, "v1").alias("version"), pick(["ECONOMY", "replace", "x"], F.col("l_partkey") % 3).alias("text"), (F.col("l_discount") > 0.03).alias("qualified"))
    return candidates.graph_manual_coverage(graph, manual, "replace")


@query("SELECT item_id AS \"case\", 1.0::DOUBLE AS similarity FROM benchmark WHERE regexp_matches(lower(text), '[\\p{L}\\p{N}]')")
def j17_leaks(spark, d):
    """Items against themselves in capitals and without their last character, and against document starts: each is found whole."""
    items = table(spark, d, "benchmark")
    other = items.select(F.upper("text").alias("text")).unionByName(items.select(F.expr("left(text, length(text) - 1)").alias("text"))).unionByName(table(spark, d, "documents").select(F.left("text", F.lit(200)).alias("text")))
    return candidates.leaks(items.select(F.col("item_id").alias("case"), "text"), other)


def title_pairs(spark, d):
    """C33 on each part's name and the next one's; its ratio has no SQL, so a plain version tests it."""
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.left("p_name", F.lit(7)).alias("title"))
    return rows.join(other, "p_partkey")


@query()
def c33_title_similarity(spark, d):
    return title_pairs(spark, d).select(F.col("p_partkey").alias("part"), candidates.title_similarity(F.col("p_name"), F.col("title")).alias("similarity"))


@query()
def c12_component_names(spark, d):
    """C12 over part names with chapter numbers and action words around them; a fix point, which a plain version tests."""
    word = pick(["3.1 ", "第二章 ", "拆卸", ""], F.col("p_partkey") % 4)
    end = pick(["的检查", "主要参数", "部件清单", "（左）", "、维修和更换方法"], F.col("p_partkey") % 5)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), candidates.component_name(F.concat(word, han(F.col("p_name")), end)).alias("name"))


@query()
def u5_dedup_groups(spark, d):
    """U5 over each customer's orders as names; a fold in order, which a plain version tests."""
    names = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").cast("string").alias("name"))
    key = F.col("o_orderkey")
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.array_sort(F.collect_list(key)).alias("o"))
    groups = groups.select("user", F.posexplode("o").alias("seq", "keep"), "o").select("user", "seq", F.col("keep").cast("string").alias("keep"), F.transform(F.slice("o", F.col("seq") % 3 + 1, F.col("seq") % 4), lambda x: x.cast("string")).alias("drop"))
    return candidates.disjoint_groups(groups, names).select("user", "keep", F.array_join("drop", ",").alias("drop"))
