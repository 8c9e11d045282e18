"""Registered queries of pages, fusion, sync and promotion, each with the DuckDB SQL that says the same."""

from pyspark.sql import functions as F

from .candidate_queries import pick
from .operators import corpus, graph, pages, retrieval
from .queries import KNN_SQL, query, vectors
from .sources.tables import table


@query("""WITH c AS (SELECT l_orderkey AS document, l_suppkey % 3 AS page, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS seq, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS chunk, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS scope,
  (l_partkey % 6 * 50)::DOUBLE AS x0, (l_linenumber * 60)::DOUBLE AS y0, (l_partkey % 6 * 50 + 120)::DOUBLE AS x1, (l_linenumber * 60 + 30 + l_partkey % 40)::DOUBLE AS y1 FROM lineitem WHERE l_quantity <= 40),
i AS (SELECT l_orderkey AS document, l_suppkey % 3 AS page, l_linenumber || '-' || l_partkey AS image, (l_suppkey % 5 * 60)::DOUBLE AS a0, (l_linenumber * 70)::DOUBLE AS b0, (l_suppkey % 5 * 60 + 100)::DOUBLE AS a1, (l_linenumber * 70 + 45)::DOUBLE AS b1 FROM lineitem WHERE l_quantity > 40),
p AS (SELECT *, greatest(0, least(x1, a1) - greatest(x0, a0)) / greatest(1, least(x1 - x0, a1 - a0)) AS o FROM c JOIN i USING (document, page)),
s AS (SELECT *, CASE WHEN y1 < b0 THEN b0 - y1 WHEN y0 > b1 THEN y0 - b1 + 4 ELSE 0 END + (1 - o) * 24 AS score, least(y1, b1) > greatest(y0, b0) AS inside, CASE WHEN y1 <= b0 THEN 'before' WHEN y0 >= b1 THEN 'after' ELSE 'overlap' END AS side, CASE WHEN y1 <= b0 THEN b0 - y1 WHEN y0 >= b1 THEN y0 - b1 ELSE 0 END AS away FROM p WHERE o >= 0.15),
n AS (SELECT *, row_number() OVER (PARTITION BY document, page, image ORDER BY score, seq) AS n, bool_or(inside) OVER (PARTITION BY document, page, image) AS embedded FROM s),
a AS (SELECT *, max(scope) FILTER (n = 1) OVER w AS a_scope, max(side) FILTER (n = 1) OVER w AS a_side FROM n WINDOW w AS (PARTITION BY document, page, image)),
m AS (SELECT *, min(score) OVER (PARTITION BY document, chunk) AS best FROM a WHERE scope <> '' AND scope = a_scope AND CASE WHEN embedded THEN inside ELSE (a_side = 'overlap' OR side = a_side) AND away <= 180 END),
b AS (SELECT document, image, chunk, 0.95::DOUBLE AS confidence FROM a WHERE n = 1 UNION ALL SELECT document, image, chunk, 0.75 FROM m WHERE score <= best + greatest(8, least(36, y1 - y0)))
SELECT document, image, chunk, max(confidence) AS confidence FROM b GROUP BY document, image, chunk""")
def j13_bind_images(spark, d):
    rows, num = table(spark, d, "lineitem"), lambda *c: F.array(*[x.cast("double") for x in c])
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    key, page = F.col("l_orderkey").alias("document"), (supp % 3).alias("page")
    chunks = rows.where("l_quantity <= 40").select(key, page, (F.col("l_orderkey") * 100000 + n * 10000 + part).alias("seq"), F.concat_ws("-", "l_orderkey", n, part).alias("chunk"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("scope"),
                                                   num(part % 6 * 50, n * 60, part % 6 * 50 + 120, n * 60 + 30 + part % 40).alias("box"))
    images = rows.where("l_quantity > 40").select(key, page, F.concat_ws("-", n, part).alias("image"), num(supp % 5 * 60, n * 70, supp % 5 * 60 + 100, n * 70 + 45).alias("box"))
    return pages.bind_images(chunks, images)


@query("""WITH b AS (SELECT l_orderkey % 800 AS document, l_suppkey % 5 AS page, CASE l_partkey % 4 WHEN 0 THEN (l_suppkey % 5)::VARCHAR WHEN 1 THEN 'line  ' || l_linenumber ELSE 'text ' || l_orderkey || ' ' || l_linenumber || ' ' || l_partkey END AS t, (l_suppkey % 4 * 100)::DOUBLE AS x0, (l_partkey % 11 * 70)::DOUBLE AS y0 FROM lineitem),
n AS (SELECT *, regexp_replace(t, '\\s+', ' ', 'g') AS norm, y0 < 70 OR y0 + 20 > 792 - 70 AS o FROM b), r AS (SELECT document, norm FROM n WHERE o GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT n.* FROM n ANTI JOIN r USING (document, norm) WHERE NOT (o AND regexp_matches(t, '^\\d+$'))),
tb AS (SELECT DISTINCT o_orderkey % 800 AS document, o_custkey % 5 AS page, (o_custkey % 5 * 80)::DOUBLE AS a0, (o_orderkey % 9 * 70)::DOUBLE AS b0 FROM orders WHERE o_orderkey % 6 = 0),
f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.document = k.document AND tb.page = k.page AND greatest(0, least(x0 + 90, a0 + 150) - greatest(x0, a0)) * greatest(0, least(y0 + 20, b0 + 100) - greatest(y0, b0)) / 1800 >= 0.35))
SELECT document, page, row_number() OVER (PARTITION BY document, page ORDER BY y0, x0, norm) AS place, t AS text FROM f""")
def c16_page_lines(spark, d):
    n, part, supp = F.col("l_linenumber").cast("string"), F.col("l_partkey"), F.col("l_suppkey")
    text = F.when(part % 4 == 0, (supp % 5).cast("string")).when(part % 4 == 1, F.concat(F.lit("line  "), n)).otherwise(F.concat_ws(" ", F.lit("text"), "l_orderkey", n, part))
    box = lambda x, y, w, h: F.array(x.cast("double"), y.cast("double"), (x + w).cast("double"), (y + h).cast("double"))
    blocks = table(spark, d, "lineitem").select((F.col("l_orderkey") % 800).alias("document"), (supp % 5).alias("page"), F.lit(792).alias("height"), text.alias("text"), box(supp % 4 * 100, part % 11 * 70, 90, 20).alias("box"))
    on = table(spark, d, "orders").where("o_orderkey % 6 = 0").select((F.col("o_orderkey") % 800).alias("document"), (F.col("o_custkey") % 5).alias("page"), box(F.col("o_custkey") % 5 * 80, F.col("o_orderkey") % 9 * 70, 150, 100).alias("box"))
    return pages.page_lines(blocks, on)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'E') AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def f6_listing(spark, d):
    """the second page of ten, as the feature has it."""
    rows = pages.listing(table(spark, d, "orders"), " E ", ["o_orderpriority", "o_orderstatus"], {"o_orderstatus": "O", "o_custkey": None}, [F.desc("o_totalprice"), F.col("o_orderkey")], page=2)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(KNN_SQL + """SELECT query, doc AS node, CASE WHEN doc % 3 = 0 THEN 'CaseRecord' ELSE 'Fault' END AS label, relevance FROM knn WHERE relevance >= 0.7 AND CASE WHEN doc % 3 = 0 THEN doc % 2 = 0 ELSE doc % 5 <> 0 END""")
def k7_node_hits(spark, d):
    asked, rows = vectors(spark, d)
    key = F.col("id")
    status = F.when((key % 3 == 0) & (key % 2 == 0), "APPROVED").when(key % 5 == 0, "deprecated")
    nodes = rows.select(key.alias("node"), F.when(key % 3 == 0, "CaseRecord").otherwise("Fault").alias("label"), status.alias("status"))
    return pages.node_hits(retrieval.knn(asked, rows), nodes)


@query("""WITH df AS (SELECT p_partkey AS chunk, ['deleted', 'modified', 'added', 'same', 'same'][1 + p_partkey % 5] AS change FROM part), r AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS chunk FROM lineitem),
p AS (SELECT node, count(*) AS n, count(*) FILTER (change = 'deleted') AS gone, count(*) FILTER (change = 'modified') AS new FROM r LEFT JOIN df USING (chunk) GROUP BY node),
a AS (SELECT node::VARCHAR AS target, CASE WHEN gone > 0 AND gone = n THEN 'deprecate' WHEN new > 0 THEN 'review' WHEN gone > 0 THEN 'drop_reference' END AS action FROM p)
SELECT target, action FROM a WHERE action IS NOT NULL UNION ALL SELECT chunk::VARCHAR, 'extract' FROM df WHERE change = 'added'""")
def l7_upgrade_queue(spark, d):
    diff = table(spark, d, "part").select(F.col("p_partkey").alias("chunk"), pick(["deleted", "modified", "added", "same", "same"], F.col("p_partkey") % 5).alias("change"))
    nodes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_list("l_partkey").alias("chunks"))
    return pages.upgrade_queue(diff, nodes)


@query("""WITH t AS (SELECT o_orderkey AS k, 'd' || o_custkey % 50 AS d, 'c' || o_orderkey % 9 AS c, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'f' || o_custkey % 11 END AS f, 's' || o_orderkey % 13 AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 NOT IN (1, 2)),
e AS (SELECT d AS src, 'OWNS' AS type, c AS dst FROM t UNION ALL SELECT c, 'CAUSES', f FROM t WHERE f <> '' AND k % 2 = 1 UNION ALL SELECT d, 'HAS_FAULT', f FROM t WHERE f <> '' UNION ALL SELECT f, 'HAS_SOLUTION', s FROM t WHERE f <> '')
SELECT DISTINCT src, type, dst FROM e""")
def l11_promoted_edges(spark, d):
    key, name = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    comp, fault = name("c", key % 9), F.when(key % 4 == 0, " ").otherwise(name("f", F.col("o_custkey") % 11))
    made = F.struct(F.lit("").alias("deviceName"), F.array(F.struct(comp.alias("name")), F.struct(F.lit(" ").alias("name"))).alias("components"), F.array(F.struct(fault.alias("name"), F.when(key % 2 == 1, comp).otherwise("other").alias("relatedComponent"))).alias("faults"),
                    F.array(F.struct(name("s", key % 13).alias("title"), fault.alias("relatedFault"))).alias("solutions"))
    promoted = F.when(key % 7 == 1, "PROMOTED").when(key % 7 == 2, "SKIPPED")
    return pages.promoted_edges(table(spark, d, "orders").select(key.alias("task"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"), promoted.alias("promoted"), name("d", F.col("o_custkey") % 50).alias("device"), F.to_json(made).alias("extraction")))


@query("SELECT l_suppkey AS manual, max(l_orderkey) AS version, arg_max('d' || l_orderkey, l_orderkey) AS document FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def t6_active_versions(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("manual"), F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("document"), F.col("l_orderkey").alias("version"), F.when(F.col("l_returnflag") != "R", "PARSED").otherwise("FAILED").alias("status"))
    return pages.activate_versions(rows)


@query("""WITH r AS (SELECT p_partkey // 5 AS tab, p_partkey % 5 AS n, list_filter([trim(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, CASE WHEN p_size % 7 = 0 THEN repeat('long ', 20) ELSE '' END], x -> trim(x) <> '') AS f FROM part),
k AS (SELECT * FROM r WHERE len(f) > 0 AND NOT (tab % 6 = 0 AND n > 0)), s AS (SELECT tab, count(*) AS n, sum(len(f)) AS cells, count(*) FILTER (len(f) >= 2) AS several, count(*) FILTER (len(f) = 1 AND length(trim(f[1])) >= 80) AS long FROM k GROUP BY tab)
SELECT t.tab AS "table", CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_rows' WHEN cells < 4 THEN 'too_few_non_empty_cells' WHEN cells < 0.25 * n * 3 THEN 'too_sparse' WHEN several < greatest(2, n // 2) THEN 'unstable_columns' WHEN long >= 0.5 * n THEN 'paragraph_like_rows' ELSE '' END AS reason
FROM (SELECT DISTINCT tab FROM r) t LEFT JOIN s USING (tab)""".replace("x -> ", "lambda x: "))
def c15_table_rejection(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    cells = F.array(F.when(size % 4 != 0, F.col("p_name")), F.when(key % 3 != 0, F.col("p_brand")).otherwise(" "), F.when(size % 7 == 0, F.repeat(F.lit("long "), 20)).otherwise(""))
    tab = F.floor(key / 5)
    rows = table(spark, d, "part").select(tab.alias("table"), F.when((tab % 6 == 0) & (key % 5 > 0), F.array(F.lit(" "))).otherwise(cells).alias("cells"))
    return rows.groupBy("table").agg(corpus.table_rejection(F.collect_list("cells")).alias("reason"))


@query("""WITH p AS (SELECT l_orderkey AS query, l_linenumber || '-' || l_partkey AS path, p_name AS fault, p_brand AS component, o_orderpriority, l_discount::DOUBLE AS score, CASE l_orderkey % 3 WHEN 0 THEN 'Small, ' WHEN 1 THEN 'a red-widget!' ELSE '' END AS af, CASE WHEN l_orderkey % 2 = 0 THEN 'BRAND #1' ELSE ' ' END AS ac
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT *, regexp_replace(lower(fault), '[^a-z0-9]+', '', 'g') AS f, regexp_replace(lower(component), '[^a-z0-9]+', '', 'g') AS c, regexp_replace(lower(af), '[^a-z0-9]+', '', 'g') AS qf, regexp_replace(lower(ac), '[^a-z0-9]+', '', 'g') AS qc FROM p),
s AS (SELECT query, path, score, CASE WHEN qf <> '' AND (contains(qf, f) OR contains(f, qf)) THEN 4 ELSE 0 END + CASE WHEN qc <> '' AND (contains(qc, c) OR contains(c, qc)) THEN 2 ELSE 0 END AS strength FROM k)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY strength DESC, score DESC, path) AS place FROM s) WHERE place <= 3""")
def k6_rerank_paths(spark, d):
    key = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        key.alias("query"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("path"), F.col("p_name").alias("fault"), F.col("p_brand").alias("component"), pick(["Small, ", "a red-widget!", ""], key % 3).alias("asked_fault"),
        F.when(key % 2 == 0, "BRAND #1").otherwise(" ").alias("asked_component"), F.col("l_discount").alias("score"))
    return graph.rerank_paths(rows, top=3).select("query", "path", "score", "strength", "place")


@query()
def u4_fused_candidates(spark, d):
    """U4 over the lines of each order as candidates; a fold in order, which a plain version tests."""
    part, name = F.col("l_partkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_linenumber") * 1000000 + part).alias("seq"), F.concat_ws("-", "l_linenumber", part).alias("candidate"), F.when(part % 2 == 0, "graph").otherwise("section").alias("kind"), name("d", F.col("l_suppkey") % 2).alias("document"),
        F.when(part % 5 > 0, name("s", part % 3)).alias("section"), F.array(name("u", part % 4)).alias("chunks"), F.when(part % 2 == 0, F.array(name("p", part % 3))).alias("paths"))
    return pages.fuse_candidates(rows).select("query", "place", F.array_join("members", ",").alias("members"))
