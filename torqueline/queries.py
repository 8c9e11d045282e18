"""Registered queries of the operators over the given tables, each with the DuckDB SQL that says the same.

Roles of the tables: customer = user, orders = task, part = device, supplier = manual, nation = site, events = heartbeats and
writes, embeddings = vector records, documents = manuals, labels = judged runs, conversations = messages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, evaluation, gold, graph, knowledge, lifecycle, nearest, retrieval, usage
from .sources import cache, scratch
from .sources.tables import in_parts, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Recall, fusion and grading over embeddings -------------------------------------------------------------------------

KNN_SQL = """
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS doc, round(least(1, greatest(0, list_cosine_similarity(v, embedding::DOUBLE[]))), 6) AS relevance FROM q, embeddings),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, doc) AS rank FROM s) WHERE rank <= 10),
near AS (SELECT query, vec_id AS doc, row_number() OVER (PARTITION BY query ORDER BY abs(vec_id - query), vec_id) AS rank
  FROM q JOIN embeddings ON vec_id BETWEEN query - 10 AND query + 10 AND vec_id <> query),
lists AS (SELECT query, 'cosine' AS route, doc, rank, relevance FROM knn UNION ALL SELECT query, 'near' AS route, doc, rank, 1.0 / rank FROM near),
n AS (SELECT query, count(DISTINCT route) AS n_lists FROM lists GROUP BY query),
raw AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS raw, max(relevance) AS best, min(rank) AS min_rank, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM lists GROUP BY query, doc),
fused AS (SELECT query, doc, round(raw, 6) AS rrf, round(greatest(raw / (n_lists / 61.0::DOUBLE), least(1.0, 0.85 * best)), 6) AS relevance, best, min_rank, routes FROM raw JOIN n USING (query)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, best DESC, min_rank, doc) AS place FROM fused)
"""


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    corpus_ = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return corpus_.where("id % 20 = 0"), corpus_  # the stated query set


def routes(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = vectors(spark, d)
    near = retrieval.knn(asked, rows).withColumn("route", F.lit("cosine"))
    return near.unionByName(retrieval.neighbours(asked, rows).withColumn("route", F.lit("near")))


def typed(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("type"))
    return retrieval.fuse(routes(spark, d)).join(labels, "doc")


@query(KNN_SQL + "SELECT query, doc, relevance, rank FROM knn")
def k1_knn(spark, d):
    return retrieval.knn(*vectors(spark, d))


@query(KNN_SQL + "SELECT query, doc, relevance, rank FROM knn")
def k1_knn_by_cells(spark, d):
    """K1 by its index; on these vectors, which point in all directions, few cells can be left out."""
    return nearest.knn_by_cells(*vectors(spark, d))[0]


@query(KNN_SQL + "SELECT query, doc, rrf, relevance, min_rank, routes, place FROM placed WHERE place <= 10")
def k3_rrf(spark, d):
    return retrieval.fuse(routes(spark, d)).where("place <= 10").drop("best")


@query(KNN_SQL + ", m AS (SELECT query, doc, route, relevance, rank, row_number() OVER (PARTITION BY query, doc ORDER BY relevance DESC, rank, route DESC) AS n FROM lists) SELECT query, doc, (SELECT string_agg(DISTINCT route, ',' ORDER BY route) FROM lists l WHERE l.query = m.query AND l.doc = m.doc) AS routes, round(relevance, 6) AS relevance, route AS best_route FROM m WHERE n = 1")
def u1_merge_routes(spark, d):
    return retrieval.merge_routes(routes(spark, d)).withColumn("relevance", F.round("relevance", 6))


@query("""WITH c AS (SELECT l_orderkey AS query, l_linenumber * 100000000000000 + l_partkey * 100 + l_suppkey % 100 AS seq, 'd' || l_linenumber % 2 || ':ims:' || l_linenumber % 2 AS doc, l_returnflag AS route, l_quantity AS relevance,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 's' || l_suppkey END AS note, CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey END AS part, 'v' || l_partkey % 3 AS variant FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey % 100) AS same FROM lineitem) WHERE same = 1),
r AS (SELECT *, relevance > max(relevance) OVER (PARTITION BY query, doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS better FROM c),
g AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY query, doc ORDER BY seq) AS run FROM r),
l AS (SELECT *, run = max(run) OVER (PARTITION BY query, doc) AS last FROM g),
m AS (SELECT query, doc, min(seq) AS seq, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, max(relevance) AS relevance,
  coalesce(arg_max(note, seq) FILTER (last AND note <> ''), arg_min(note, seq) FILTER (last)) AS note, arg_max(part, seq) FILTER (last AND part IS NOT NULL) AS part, string_agg(variant, ',' ORDER BY seq) AS vs FROM l GROUP BY query, doc)
SELECT query, replace(doc, ':ims:', ':img:') AS doc, row_number() OVER (PARTITION BY query ORDER BY seq)::INTEGER AS place, routes, relevance, note, part, array_to_string(list_filter(string_split(vs, ','), lambda x, i: list_position(string_split(vs, ','), x) = i), ',') AS variants FROM m""")
def u1_merge_candidates(spark, d):
    """U1 with metadata: an order's items as hits, with an image's summary standing for the image."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    text = lambda c: c.cast("string")
    seq = line.cast("long") * 100_000_000_000_000 + part * 100 + F.col("l_suppkey") % 100  # no part reaches into the line's digits
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), seq.alias("seq"), F.concat(F.lit("d"), text(line % 2), F.lit(":ims:"), text(line % 2)).alias("doc"), F.array("l_returnflag").alias("routes"), F.col("l_quantity").alias("relevance"),
        F.map_filter(F.create_map(F.lit("note"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), text(F.col("l_suppkey")))), F.lit("part"), F.when(part % 2 == 0, F.concat(F.lit("p"), text(part))), F.lit("chunk_type"), F.lit("image_summary")), lambda k, v: v.isNotNull()).alias("metadata"),
        F.array(F.concat(F.lit("v"), text(part % 3))).alias("variants"))
    once = rows.groupBy("query", "seq").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    out = retrieval.merge_candidates(rows.join(once, ["query", "seq"]))
    return out.select("query", "doc", "place", F.array_join("routes", ",").alias("routes"), "relevance", F.col("metadata")["note"].alias("note"), F.col("metadata")["part"].alias("part"), F.array_join("variants", ",").alias("variants"))


@query(KNN_SQL + """, t AS (SELECT p.query, p.doc, p.relevance, e.label AS type FROM placed p JOIN embeddings e ON e.vec_id = p.doc),
f AS (SELECT *, row_number() OVER (PARTITION BY query, type ORDER BY relevance DESC, doc) = 1 AND relevance >= greatest(0.45, max(relevance) OVER (PARTITION BY query) - 0.25) AS first_of_type FROM t),
g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first_of_type DESC, relevance DESC, doc) AS place FROM f)
SELECT query, doc, type, relevance, first_of_type, place FROM g WHERE place <= 5""")
def w16_diversify(spark, d):
    return retrieval.diversify(typed(spark, d).select("query", "doc", "type", "relevance"))


@query(KNN_SQL + """, t AS (SELECT p.query, p.relevance, e.label AS type FROM placed p JOIN embeddings e ON e.vec_id = p.doc),
a AS (SELECT query, max(relevance) AS best, string_agg(DISTINCT type::VARCHAR, ',' ORDER BY type::VARCHAR) AS types, bool_or(type <= 2) AS hit FROM t GROUP BY query)
SELECT query, best, types, CASE WHEN hit AND best >= 0.9 THEN 'high' WHEN hit AND best >= 0.65 THEN 'medium' ELSE 'low' END AS level FROM a""")
def a32_confidence(spark, d):
    return retrieval.confidence(typed(spark, d), F.col("type") <= 2)


@query(KNN_SQL + """, t AS (SELECT p.query, p.relevance, p.place, p.doc, e.label::VARCHAR AS type, e.label % 3 AS document, p.doc % 4 AS section FROM placed p JOIN embeddings e ON e.vec_id = p.doc WHERE p.place <= 5),
a AS (SELECT query, count(*) AS n, max(relevance) FILTER (place = 1) AS best, max(relevance) FILTER (place = 2) AS second, max(relevance) FILTER (place <= 4) - min(relevance) FILTER (place <= 4) AS width,
  count(DISTINCT document) FILTER (place <= 3) AS d3, count(DISTINCT section) FILTER (place <= 3) AS s3, count(DISTINCT document) FILTER (place <= 4) AS d4, count(DISTINCT section) FILTER (place <= 4) AS s4,
  string_agg(DISTINCT type, ',' ORDER BY type) AS types, CASE WHEN query % 40 = 0 THEN '1' END AS required, coalesce(bool_or(type = CASE WHEN query % 40 = 0 THEN '1' END), true) AS met FROM t GROUP BY query),
r AS (SELECT *, CASE WHEN best < 0.55 THEN 'weak_top_score' END AS r1, CASE WHEN best >= 0.55 AND best < 0.72 THEN 'medium_top_score' END AS r2, CASE WHEN NOT met THEN 'missing_required_type:' || required END AS r3,
  CASE WHEN n < 2 THEN 'too_few_candidates' END AS r4, CASE WHEN n >= 2 AND round(best - second, 9) <= 0.03 AND (d3 > 1 OR s3 > 1) THEN 'ambiguous_close_scores' END AS r5,
  CASE WHEN n >= 3 AND round(width, 9) <= 0.08 AND (d4 > 2 OR s4 > 2) THEN 'dispersed_sources' END AS r6 FROM a)
SELECT query, round(best, 6) AS best, types, concat_ws(',', r1, r2, r3, r4, r5, r6) AS reasons,
  CASE WHEN r1 IS NOT NULL THEN 'low' WHEN coalesce(r2, r3, r4, r5, r6) IS NOT NULL THEN 'medium' WHEN best >= 0.8 THEN 'high' ELSE 'medium' END AS grade FROM r""")
def a33_quality(spark, d):
    rows = typed(spark, d).withColumn("document", F.col("type") % 3).withColumn("section", F.col("doc") % 4)
    return retrieval.quality(rows, F.when(F.col("query") % 40 == 0, "1"))


IR_SQL = KNN_SQL + """, rel AS (SELECT q.query, e.vec_id AS doc, CASE WHEN e.vec_id = q.query THEN 2 ELSE 1 END AS grade FROM q JOIN embeddings s ON s.vec_id = q.query JOIN embeddings e ON e.label = s.label),
hits AS (SELECT p.query, count(*) AS hits, min(place) AS best_rank, sum((2.0 ** grade - 1) / log2(place + 1)) AS dcg FROM placed p JOIN rel USING (query, doc) WHERE place <= 10 GROUP BY p.query),
ideal AS (SELECT query, count(*) AS positives, sum((2.0 ** grade - 1) / log2(r + 1)) FILTER (r <= 10) AS ideal FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS r FROM rel) GROUP BY query),
ir AS (SELECT query, round(coalesce(hits / positives, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / best_rank, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM ideal LEFT JOIN hits USING (query))
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Grades by label: rows of a query's label are 1, the query's own row 2."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label")
    found = asked.join(rows.withColumnRenamed("vec_id", "doc"), "label")
    return found.select("query", "doc", F.when(F.col("doc") == F.col("query"), 2).otherwise(1).alias("grade"))


@query(IR_SQL + "SELECT * FROM ir")
def a14_ranking_metrics(spark, d):
    runs = retrieval.fuse(routes(spark, d)).select("query", F.col("place").alias("rank"), "doc")
    return evaluation.ranking_metrics(runs, judged(spark, d))


@query(KNN_SQL + """, sec AS (SELECT p.query, e.label::VARCHAR AS document, (p.doc % 3)::VARCHAR AS section, p.place AS rank FROM placed p JOIN embeddings e ON e.vec_id = p.doc)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY first_rank, document, section) AS place FROM (
SELECT query, document, section, count(*) AS hits, min(rank) AS first_rank, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks FROM sec GROUP BY query, document, section)""")
def a4_chapter_groups(spark, d):
    hits = typed(spark, d).select("query", F.col("type").cast("string").alias("document"), (F.col("doc") % 3).cast("string").alias("section"), F.col("place").alias("rank"))
    return retrieval.chapter_groups(hits)


TOKENS_SQL = """
WITH tok AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))), ' ')) AS term FROM documents),
post AS (SELECT term, doc, count(*) AS tf FROM tok WHERE term <> '' GROUP BY term, doc),
bt AS (SELECT DISTINCT item_id AS query, unnest(list_slice(regexp_split_to_array(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))), ' '), 1, 2)) AS term FROM benchmark),
"""


#: Texts of a part in which words are counted.
TEXT_ROWS = 5_000


def terms_of(text):
    return F.split(F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z]+", " "))), " ")


@query(TOKENS_SQL + """n AS (SELECT query, count(*) AS n FROM bt WHERE term <> '' GROUP BY query),
f AS (SELECT query, doc, sum(tf)::BIGINT AS tf, count(*) AS c FROM bt JOIN post USING (term) GROUP BY query, doc)
SELECT query, doc, rank, 1.0::DOUBLE / rank AS relevance FROM (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY tf DESC, doc) AS rank FROM f JOIN n USING (query) WHERE c = n) WHERE rank <= 10""")
def k2_keyword_all(spark, d):
    docs = in_parts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", size=TEXT_ROWS).select(F.col("doc_id").alias("doc"), F.explode(terms_of(F.col("text"))).alias("term"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.slice(terms_of(F.col("text")), 1, 2)).alias("term"))
    return retrieval.keyword_all(asked.where("term <> ''").distinct(), docs.where("term <> ''"))


@query("""
WITH tok AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))), ' ')) AS term FROM documents),
bt AS (SELECT DISTINCT item_id AS query, unnest(regexp_split_to_array(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))), ' ')) AS term FROM benchmark),
post AS (SELECT term, doc, count(*) AS tf FROM tok WHERE term <> '' GROUP BY term, doc),
n AS (SELECT query, count(*) AS n FROM bt WHERE term <> '' GROUP BY query),
f AS (SELECT query, doc, sum(tf)::BIGINT AS tf, count(*) AS c FROM bt JOIN post USING (term) GROUP BY query, doc)
SELECT query, doc, rank, 1.0::DOUBLE / rank AS relevance FROM (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY tf DESC, doc) AS rank FROM f JOIN n USING (query) WHERE c = n) WHERE rank <= 10""")
def k2_keyword_every_word(spark, d):
    """K2 over all distinct words of each item; ``k2_keyword_all`` takes the first two, as its SQL does."""
    return every_word(table(spark, d, "benchmark"), table(spark, d, "documents"))


def every_word(items: DataFrame, documents: DataFrame) -> DataFrame:
    words = in_parts(documents.select("doc_id", "text"), "doc_id", size=TEXT_ROWS).select(F.col("doc_id").alias("doc"), F.explode(terms_of(F.col("text"))).alias("term"))
    asked = items.select(F.col("item_id").alias("query"), F.explode(terms_of(F.col("text"))).alias("term"))
    return retrieval.keyword_all(asked.where("term <> ''").distinct(), words.where("term <> ''"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')")
def f1_scope_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return retrieval.scope_filter(rows, {"lang": "en", "source": ""}, {"source": ["src0", "src1"]})


@query("""WITH s AS (SELECT doc_id, doc_id % 3 = 1 AS strict, doc_id % 11 = 0 AS locked, (doc_id % 10) / 20.0::DOUBLE AS cov,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'EN ' END AS al, CASE WHEN doc_id % 7 <> 0 THEN 'src0' END AS ao, lower(trim(coalesce(lang, ''))) AS fl, lower(trim(coalesce(source, ''))) AS fo,
  (contains(lower(coalesce(text, '')), 'the'))::INT + (contains(lower(coalesce(text, '')), 'ing'))::INT + (contains(lower(coalesce(text, '')), 'zuung'))::INT AS met FROM documents),
x AS (SELECT *, CASE WHEN al = '' OR fl = '' THEN 'unknown' WHEN fl = 'en' THEN 'matched' ELSE 'mismatch' END AS language, CASE WHEN ao IS NULL OR fo = '' THEN 'unknown' WHEN fo = 'src0' THEN 'matched' ELSE 'mismatch' END AS origin,
  CASE WHEN met = 0 AND cov < 0.15 THEN 'conflict' WHEN cov >= 0.35 OR met / 3.0 >= 0.5 THEN 'matched' ELSE 'weak' END AS topic FROM s),
y AS (SELECT *, concat_ws(',', CASE WHEN language = 'mismatch' THEN 'language_mismatch' END, CASE WHEN origin = 'mismatch' THEN 'origin_mismatch' END, CASE WHEN topic = 'conflict' AND NOT locked THEN 'topic_conflict' END) AS bad,
  (al <> '' AND language = 'unknown') OR (ao IS NOT NULL AND origin = 'unknown') AS unknown FROM x),
z AS (SELECT *, concat_ws(',', CASE WHEN topic = 'weak' THEN 'weak_topic_match' END, CASE WHEN unknown THEN 'identity_not_confirmed' END) AS soft, (al = '' AND ao IS NULL) OR unknown OR NOT (topic = 'matched' OR locked) AS open FROM y)
SELECT doc_id, CASE WHEN bad <> '' THEN 'excluded' WHEN open THEN 'reference_only' ELSE 'qualified' END AS state,
  CASE WHEN bad <> '' THEN bad WHEN open AND soft = '' THEN CASE WHEN strict THEN 'strict_evidence_not_confirmed' ELSE 'reference_only' END ELSE soft END AS reasons FROM z""")
def f4_qualify(spark, d):
    key = F.col("doc_id")
    asked = {"language": (F.when(key % 4 == 0, "").otherwise("EN "), F.col("lang")), "origin": (F.when(key % 7 != 0, F.lit("src0")), F.col("source"))}
    topic = retrieval.topic_state(F.lit("The a/ing zuung"), F.col("text"), key % 10 / 20, F.lit(0.0))
    return retrieval.qualify(table(spark, d, "documents"), asked, topic, key % 3 == 1, key % 11 == 0).select("doc_id", "state", "reasons")


@query("""WITH m AS (SELECT l_orderkey AS evidence, lower(l_returnflag) AS field, lower(l_linestatus) AS unit, (l_partkey % 50)::VARCHAR AS scope, l_linenumber::VARCHAR AS v FROM lineitem)
SELECT * FROM (SELECT field, unit, scope, count(DISTINCT v) AS n_values, count(DISTINCT evidence) AS n_evidence, min(v) AS low, max(v) AS high FROM m GROUP BY field, unit, scope) WHERE n_values >= 2 AND n_evidence >= 2""")
def a8_conflicts(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("evidence"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("unit"),
        (F.col("l_partkey") % 50).cast("string").alias("scope"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("value"),
    )
    return retrieval.conflicts(rows)


# Usage --------------------------------------------------------------------------------------------------------------

DWELL_SQL = """
WITH b AS (SELECT user_id AS session, user_id AS "user", abs(event_id) % 50 AS manual, ts FROM events),
dw AS (SELECT session, "user", manual, ts, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, "user", manual)) / 1000000.0) AS s FROM b),
beats AS (SELECT session, "user", manual, ts, (CASE WHEN s IS NULL OR s > 300 THEN 0 ELSE least(s, 30) END)::BIGINT AS seconds FROM dw)
"""


def dwelled(spark: SparkSession, d: str) -> DataFrame:
    beats = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "user_id", (F.abs("event_id") % 50).alias("manual_id"), "ts")
    return usage.dwell(beats)


@query(DWELL_SQL + "SELECT session, manual, epoch_us(ts) AS at_us, seconds FROM beats")
def w13_dwell(spark, d):
    return dwelled(spark, d).select("session", "manual", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "seconds")


@query(DWELL_SQL + """SELECT "user", manual, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, sum(seconds)::BIGINT AS seconds, sum(seconds) >= 60 AS counted FROM beats GROUP BY 1, 2, 3""")
def t2_daily_reads(spark, d):
    return usage.daily_reads(dwelled(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


POPULAR_SQL = """
WITH r AS (SELECT {key} AS period, user_id AS item, count(*) AS reads FROM events GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY reads DESC, item) AS position FROM r)
SELECT item, period, reads, position FROM c WHERE position <= 10 AND item IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
"""
LOCAL = "(ts + INTERVAL 8 HOUR)"


def popular(spark: SparkSession, d: str, kind: str) -> DataFrame:
    live = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return usage.popularity(table(spark, d, "events"), live, "user_id", "ts", kind)


@query(POPULAR_SQL.format(key=f"strftime({LOCAL}, '%Y%m%d')"))
def k8_popularity_day(spark, d):
    return popular(spark, d, "day")


@query(POPULAR_SQL.format(key=f"strftime({LOCAL}, '%G-%V')"))
def k8_popularity_week(spark, d):
    return popular(spark, d, "week")


@query(POPULAR_SQL.format(key=f"strftime({LOCAL}, '%Y%m')"))
def k8_popularity_month(spark, d):
    return popular(spark, d, "month")


@query(POPULAR_SQL.format(key="'all'"))
def k8_popularity_total(spark, d):
    return popular(spark, d, "total")


@query("""SELECT o_custkey AS owner, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n,
floor(count(*) FILTER (o_orderstatus = 'F') * 1000.0 / count(*) + 0.5) / 10 AS completion_rate FROM orders GROUP BY o_custkey""")
def a1_status_by_user(spark, d):
    return usage.status_distribution(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"], "F", "o_custkey")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n,
floor(count(*) FILTER (o_orderstatus = 'F') * 1000.0 / count(*) + 0.5) / 10 AS completion_rate FROM orders""")
def a1_status_total(spark, d):
    return usage.status_distribution(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"], "F")


@query("SELECT 'users' AS name, count(*) AS n FROM customer UNION ALL SELECT 'devices', count(*) FROM part UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'O'")
def a2_totals(spark, d):
    return usage.totals(users=table(spark, d, "customer"), devices=table(spark, d, "part"), pending=table(spark, d, "orders").where("o_orderstatus = 'O'"))


SHOP_SQL = """
WITH last AS (SELECT max(o_orderdate) AS t FROM orders),
task AS (SELECT o_custkey AS "user", l_partkey AS device, o_orderdate AS created FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
link AS (SELECT DISTINCT l_partkey AS device, l_suppkey AS manual FROM lineitem),
live AS (SELECT s_suppkey AS manual, s_acctbal FROM supplier WHERE s_acctbal > 0),
own AS (SELECT DISTINCT "user", device FROM task, last WHERE created >= t - INTERVAL 6 MONTH),
j2 AS (SELECT DISTINCT "user", manual FROM own JOIN link USING (device) WHERE manual IN (SELECT manual FROM live)),
site AS (SELECT DISTINCT p_partkey AS device, p_partkey // 20 AS site FROM part),
near AS (SELECT DISTINCT o."user", s2.device FROM own o JOIN site s1 USING (device) JOIN site s2 ON s1.site = s2.site),
j3 AS (SELECT DISTINCT n."user", manual FROM near n JOIN link USING (device) WHERE NOT EXISTS (FROM own o WHERE o."user" = n."user" AND o.device = n.device)
  AND NOT EXISTS (FROM j2 WHERE j2."user" = n."user" AND j2.manual = link.manual) AND manual IN (SELECT manual FROM live))
"""


def shop(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    tasks = orders.join(items.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    tasks = tasks.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("device"), F.col("o_orderdate").alias("created"))
    since, now = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 6 MONTHS")).alias("t"), F.max("o_orderdate").alias("n")).first()
    links = in_parts(items.select(F.col("l_partkey").alias("device"), F.col("l_suppkey").alias("manual")), "device")
    live = table(spark, d, "supplier").where("s_acctbal > 0")
    live = live.select(F.col("s_suppkey").alias("manual"), F.timestamp_seconds(F.floor("s_acctbal")).alias("created"))
    owned = tasks.where(F.col("created") >= F.lit(since)).select("user", "device").distinct()
    sites = table(spark, d, "part").select(F.col("p_partkey").alias("device"), F.floor(F.col("p_partkey") / 20).alias("site"))
    return {"tasks": tasks, "since": F.lit(since), "now": F.lit(now), "links": links, "live": live, "owned": owned, "sites": sites, "users": orders.select(F.col("o_custkey").alias("user"))}


@query(SHOP_SQL + """SELECT "user", manual, 3.0::DOUBLE AS score FROM j2""")
def j2_own_devices(spark, d):
    s = shop(spark, d)
    return usage.own_device_scores(s["tasks"], s["links"], s["live"], s["since"])


@query(SHOP_SQL + """SELECT "user", manual, 1.5::DOUBLE AS score FROM j3""")
def j3_same_site(spark, d):
    s = shop(spark, d)
    own = usage.own_device_scores(s["tasks"], s["links"], s["live"], s["since"])
    return usage.same_site_scores(s["owned"], s["sites"], s["links"], s["live"], own)


@query(SHOP_SQL + """, fr AS (SELECT s_suppkey AS manual, s_suppkey % 4 = 0 AS fresh FROM supplier),
sc AS (SELECT "user", manual, 3.0::DOUBLE + fresh::INT AS score, '检修设备' || CASE WHEN fresh THEN '、近期更新' ELSE '' END AS reason FROM j2 JOIN fr USING (manual) UNION ALL SELECT "user", manual, 1.5 + fresh::INT, '同区域设备' || CASE WHEN fresh THEN '、近期更新' ELSE '' END FROM j3 JOIN fr USING (manual)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, manual) AS p FROM sc) WHERE p <= 5),
fresh AS (SELECT manual, floor(s_acctbal) AS created FROM live ORDER BY floor(s_acctbal) DESC, manual LIMIT 10),
fill AS (SELECT u."user", manual, 0.0::DOUBLE AS score, '最新手册' AS reason, created FROM (SELECT DISTINCT o_custkey AS "user" FROM orders) u, fresh f WHERE NOT EXISTS (FROM rk WHERE rk."user" = u."user" AND rk.manual = f.manual)),
every AS (SELECT "user", manual, score, reason, NULL AS created FROM rk UNION ALL FROM fill)
SELECT * FROM (SELECT "user", manual, score, reason, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, created DESC NULLS LAST, manual) AS place FROM every) WHERE place <= 5""")
def k9_recommend(spark, d):
    s = shop(spark, d)
    own = scratch.written(usage.own_device_scores(s["tasks"], s["links"], s["live"], s["since"]), "own")
    # Those updated lately and the others each in their own order, as the bonus ranks one above the other.
    lately = F.col("manual") % 4 == 0
    near = usage.same_site_scores(s["owned"], s["sites"], s["links"], s["live"].withColumn("apart", lately), own, top=5)
    updated = F.when(lately, s["now"] - F.expr("INTERVAL 3 DAYS")).otherwise(s["now"] - F.expr("INTERVAL 30 DAYS"))
    return usage.recommend(own, near, s["users"], s["live"].withColumn("updated", updated), s["now"])


@query("""SELECT p_partkey AS device, count(DISTINCT l_suppkey) AS components, count(DISTINCT s_nationkey) AS faults FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey""")
def a3_device_overview(spark, d):
    owns = in_parts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("device"), F.col("l_suppkey").alias("component")), "device")
    faults = table(spark, d, "supplier").select(F.col("s_suppkey").alias("component"), F.col("s_nationkey").alias("fault"))
    return usage.device_overview(table(spark, d, "part").select(F.col("p_partkey").alias("device")), owns, faults)


QUIZ_SQL = """
WITH an AS (SELECT user_id AS "user", CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS topic, value > 50 AS correct, ts FROM events),
ms AS (SELECT "user", topic, count(*) FILTER (correct) AS correct, count(*) AS total, max(ts) AS last_at, floor(count(*) FILTER (correct) * 100.0 / count(*) + 0.5) / 100 AS rate FROM an WHERE trim(topic) <> '' GROUP BY "user", topic)
"""


def mastered(spark: SparkSession, d: str) -> DataFrame:
    topic = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return usage.mastery(table(spark, d, "events").select(F.col("user_id").alias("user"), topic.alias("topic"), (F.col("value") > 50).alias("correct"), F.col("ts").alias("at")))


@query(QUIZ_SQL + """SELECT "user", topic, correct, total, rate FROM ms""")
def a10_mastery(spark, d):
    return mastered(spark, d).drop("last_at")


@query(QUIZ_SQL + """, tp AS (SELECT DISTINCT c_custkey AS "user", event_type AS topic, length(event_type) AS position FROM customer, (SELECT DISTINCT event_type FROM events)),
w AS (SELECT tp."user", tp.topic, coalesce(rate, -1) AS rate, row_number() OVER (PARTITION BY tp."user" ORDER BY coalesce(rate, -1), position, tp.topic) AS place FROM tp LEFT JOIN ms ON ms."user" = tp."user" AND ms.topic = tp.topic)
SELECT * FROM w WHERE place <= 3""")
def w11_weakest_topics(spark, d):
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # topics, a few
    topics = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.explode(F.array(*map(F.lit, kinds))).alias("topic"))
    return usage.weakest_topics(topics.withColumn("position", F.length("topic")), mastered(spark, d))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'multiple' ELSE 'single' END AS kind, 'A,' || upper(left(event_type, 1)) AS expected, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'a, ' || left(event_type, 1) ELSE left(event_type, 1) || ',a' END AS given FROM events),
s AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(string_split(given, ','), lambda x: upper(trim(x))), lambda x: x <> ''))) AS g, list_sort(list_distinct(list_transform(string_split(expected, ','), lambda x: upper(trim(x))))) AS e FROM a)
SELECT event_id, CASE WHEN kind = 'multiple' THEN len(g) > 0 AND g = e ELSE trim(given) <> '' AND lower(trim(given)) = lower(trim(expected)) END AS correct FROM s""")
def a11_grade(spark, d):
    n, first = F.col("event_id"), F.left("event_type", F.lit(1))
    rows = table(spark, d, "events").select(
        "event_id", F.when(n % 2 == 0, "multiple").otherwise("single").alias("kind"), F.concat(F.lit("A,"), F.upper(first)).alias("expected"),
        F.when(n % 5 == 0, "").when(n % 3 == 0, F.concat(F.lit("a, "), first)).otherwise(F.concat(first, F.lit(",a"))).alias("given"),
    )
    return usage.grade(rows).select("event_id", "correct")


@query("""SELECT user_id AS "user", event_id % 50 AS manual, epoch_us(max(ts)) AS last_us FROM events WHERE event_id % 50 IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2""")
def k11_latest_reads(spark, d):
    reads = table(spark, d, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 50).alias("manual"), "ts")
    out = usage.latest_reads(reads, table(spark, d, "supplier").select(F.col("s_suppkey").alias("manual")))
    return out.select("user", "manual", F.unix_micros(F.col("last_read").cast("timestamp")).alias("last_us"))


# Lifecycle ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_orderkey + 1 AS next_version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def w6_latest_version(spark, d):
    return lifecycle.latest_version(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH o AS (SELECT doc_id AS uid, text FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id AS uid, CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0)
SELECT uid, CASE WHEN n.text IS NULL THEN 'deleted' WHEN o.text IS NULL THEN 'added' ELSE 'modified' END AS change, sha1(o.text) AS old_hash, sha1(n.text) AS new_hash FROM o FULL JOIN n USING (uid) WHERE o.text IS DISTINCT FROM n.text""")
def j4_version_diff(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "text", F.lit(0).alias("position"))
    new = docs.withColumn("text", F.when(F.col("uid") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return lifecycle.diff(docs.where("uid % 11 <> 0"), new.where("uid % 13 <> 0"))


WRITES = """SELECT user_id AS "user", event_type AS name, event_id::VARCHAR AS content, CASE WHEN event_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status,
CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id // 10 END AS turn_ts, CASE event_id % 4 WHEN 0 THEN 'agent_explicit' WHEN 1 THEN 'consolidation' WHEN 2 THEN 'capture_fallback' END AS source, event_id AS arrival FROM events"""


def writes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    source = F.when(n % 4 == 0, "agent_explicit").when(n % 4 == 1, "consolidation").when(n % 4 == 2, "capture_fallback")
    return table(spark, d, "events").select(
        F.col("user_id").alias("user"), F.col("event_type").alias("name"), n.cast("string").alias("content"), F.when(n % 17 == 0, "deleted").otherwise("active").alias("status"),
        F.when(n % 19 != 0, F.floor(n / 10)).cast("long").alias("turn_ts"), source.alias("source"), n.alias("arrival"),
    )


@query(f"""WITH w AS ({WRITES}), r AS (SELECT *, row(coalesce(turn_ts, -1), CASE source WHEN 'capture_fallback' THEN 1 WHEN 'consolidation' THEN 2 WHEN 'agent_explicit' THEN 3 ELSE 4 END, arrival) AS rank FROM w),
g AS (SELECT *, max(CASE WHEN status = 'deleted' THEN rank END) OVER (PARTITION BY "user", name) AS gone FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY "user", name ORDER BY rank DESC) AS n FROM g WHERE NOT coalesce(source = 'consolidation' AND status <> 'deleted' AND rank > gone, false))
SELECT "user", name, content, status, source, arrival FROM k WHERE n = 1""")
def w9_arbitrate(spark, d):
    return lifecycle.arbitrate(writes(spark, d))


@query("""WITH v AS (SELECT user_id AS "user", event_type AS type, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT "user", type, id, version, CASE WHEN version = n THEN 'active' ELSE 'archived' END AS status FROM v""")
def w10_reflections(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("type"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return lifecycle.number_reflections(rows).drop("at")


@query("""WITH b AS (SELECT conv_id AS session, turn AS round, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT session, round, row_number() OVER (PARTITION BY session ORDER BY round) AS place FROM b WHERE back <= 4""")
def w7_recent_rounds(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("round"), F.col("turn").alias("id"))
    return lifecycle.recent_rounds(rows, rows=4).drop("id")


FACTS = """SELECT user_id AS "user", event_id AS id, ['user', 'unresolved', 'preference', 'device', 'task'][1 + event_id % 5] AS type, CASE WHEN event_id % 6 = 0 THEN 'superseded' ELSE 'active' END AS status,
(1 + event_id % 10)::INTEGER AS importance, (event_id % 100) / 100.0::DOUBLE AS confidence, ts AS created, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 DAY END AS last_used FROM events"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ("user", "unresolved", "preference", "device", "task")))
    return table(spark, d, "events").select(
        F.col("user_id").alias("user"), n.alias("id"), F.get(kinds, (n % 5).cast("int")).alias("type"), F.when(n % 6 == 0, "superseded").otherwise("active").alias("status"),
        (1 + n % 10).cast("int").alias("importance"), ((n % 100) / 100.0).alias("confidence"), F.col("ts").alias("created"), F.when(n % 3 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("last_used"),
    )


def late(spark: SparkSession, d: str, days: int):
    return F.lit(table(spark, d, "events").agg(F.max("ts") + F.make_interval(days=F.lit(days))).first()[0])


@query(f"""WITH f AS ({FACTS}), n AS (SELECT max(ts) + INTERVAL 80 DAY AS now FROM events)
SELECT id, CASE WHEN status = 'active' AND importance <= 3 AND confidence < 0.6 AND (last_used IS NULL OR last_used < now - INTERVAL 90 DAY) THEN 'archived' ELSE status END AS status FROM f, n""")
def l1_archive(spark, d):
    return lifecycle.archive(facts(spark, d), late(spark, d, 80)).select("id", "status")


@query(f"""WITH f AS ({FACTS}), n AS (SELECT max(ts) + INTERVAL 170 DAY AS now FROM events)
SELECT id, CASE WHEN status = 'active' AND importance < 8 AND type NOT IN ('user', 'unresolved') AND coalesce(last_used, created) < now - INTERVAL 180 DAY THEN 'archived' ELSE status END AS status FROM f, n""")
def l2_decay(spark, d):
    return lifecycle.decay(facts(spark, d), late(spark, d, 170)).select("id", "status")


@query(f"""WITH f AS ({FACTS}), n AS (SELECT max(ts) + INTERVAL 170 DAY AS now FROM events)
SELECT id FROM f, n WHERE NOT (status = 'superseded' AND coalesce(last_used, created) < now - INTERVAL 180 DAY)""")
def l3_purge(spark, d):
    return lifecycle.purge(facts(spark, d), late(spark, d, 170)).select("id")


@query(f"""WITH f AS ({FACTS}), s AS (SELECT c_custkey AS "user", (SELECT min(ts) FROM events) + INTERVAL 3 DAY AS t FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM (SELECT f."user", count(*) AS n_new FROM f LEFT JOIN s ON s."user" = f."user" WHERE status = 'active' AND type NOT IN ('user', 'unresolved') AND (t IS NULL OR created > t) GROUP BY f."user") WHERE n_new > 20""")
def a12_due_for_dedup(spark, d):
    first = table(spark, d, "events").agg(F.min("ts") + F.expr("INTERVAL 3 DAYS")).first()[0]
    state = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user"), F.lit(first).alias("deduped_at"))
    return lifecycle.due_for_dedup(facts(spark, d), state)


@query(f"""WITH f AS ({FACTS}), r AS (SELECT user_id AS "user", max(ts) AS done FROM events WHERE event_type = 'click' GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT * FROM (SELECT "user", count(*) AS n_facts FROM f WHERE status = 'active' AND type <> 'preference' GROUP BY "user") WHERE n_facts >= 10 AND "user" NOT IN (SELECT "user" FROM r, n WHERE done >= now - INTERVAL 24 HOUR)""")
def a13_due_for_reflection(spark, d):
    done = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("user")).agg(F.max("ts").alias("at"))
    return lifecycle.due_for_reflection(facts(spark, d), done, late(spark, d, 0))


@query(f"""WITH f AS ({FACTS}), t AS (SELECT *, CASE type WHEN 'device' THEN 3 WHEN 'task' THEN 2 WHEN 'preference' THEN 1 ELSE 0 END AS tier FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY importance DESC, created DESC, id) AS place FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY "user", tier ORDER BY place) AS n FROM p WHERE place <= 200)
SELECT "user", id, tier, row_number() OVER (PARTITION BY "user" ORDER BY tier DESC, place) AS position FROM q WHERE tier > 0 OR n <= 30""")
def w8_memory_index(spark, d):
    tier = F.when(F.col("type") == "device", 3).when(F.col("type") == "task", 2).when(F.col("type") == "preference", 1).otherwise(0)
    return lifecycle.memory_index(facts(spark, d), tier).select("user", "id", "tier", "position")


@query("""WITH f AS (SELECT conv_id * 100 + turn AS fact, conv_id AS session, turn, conv_id % 3 AS k FROM conversations),
s AS (SELECT fact, session, turn - 1 AS lo, turn AS hi FROM f UNION ALL SELECT fact, session, 0, 0 FROM f WHERE k = 0 UNION ALL SELECT fact, session, 3, 999999999 FROM f WHERE k = 1)
SELECT DISTINCT fact, c.conv_id AS session, c.turn AS round, c.turn AS id FROM s JOIN conversations c ON c.conv_id = s.session AND c.turn BETWEEN lo AND hi""")
def j9_recall_rounds(spark, d):
    rows, n = table(spark, d, "conversations"), F.col("turn").cast("string")
    tail = F.get(F.array(F.lit(",0,x,5"), F.lit(",3-999999999"), F.lit(",7-6-5,1")), (F.col("conv_id") % 3).cast("int"))
    begin = F.when(F.col("turn") > 0, F.concat((F.col("turn") - 1).cast("string"), F.lit(" - "), n)).otherwise("0")
    made = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("fact"), F.col("conv_id").alias("session"), F.concat(begin, tail).alias("ranges"))
    return lifecycle.recall_rounds(made, rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("round"), F.col("turn").alias("id")))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def t7_insert_once(spark, d):
    queue = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return lifecycle.insert_once(queue, table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


# Graph --------------------------------------------------------------------------------------------------------------

EDGES_SQL = """
WITH owns AS (SELECT DISTINCT l_partkey AS device, l_suppkey AS component FROM lineitem WHERE l_returnflag = 'R'),
causes AS (SELECT s_suppkey AS component, s_nationkey AS fault FROM supplier WHERE s_acctbal > 0),
solves AS (SELECT n_nationkey AS fault, n_regionkey AS solution FROM nation WHERE n_nationkey % 2 = 0)
"""


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    owns = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("device"), F.col("l_suppkey").alias("component")).distinct()
    causes = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("component"), F.col("s_nationkey").alias("fault"))
    solves = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("fault"), F.col("n_regionkey").alias("solution"))
    return owns, causes, solves


@query(EDGES_SQL + "SELECT device, a.component, c.fault, solution FROM (SELECT component FROM owns UNION SELECT component FROM causes) a LEFT JOIN owns o ON o.component = a.component LEFT JOIN causes c ON c.component = a.component LEFT JOIN solves s ON s.fault = c.fault")
def j5_diagnosis_paths(spark, d):
    return graph.diagnosis_paths(*edges(spark, d))


@query(EDGES_SQL + """SELECT component, fault FROM causes WHERE component IN (SELECT component FROM owns WHERE device % 20 = 0)""")
def j7_isolated(spark, d):
    owns, causes, _ = edges(spark, d)
    return graph.isolated(causes, owns, owns.where("device % 20 = 0"))


@query(EDGES_SQL + "SELECT component, device FROM owns WHERE component IN (SELECT component FROM causes)")
def j8_owners(spark, d):
    owns, causes, _ = edges(spark, d)
    return graph.owners(causes, owns)


@query(EDGES_SQL + """, p AS (SELECT device, o.component, fault FROM owns o JOIN causes USING (component))
SELECT device, component, fault, greatest((component % 97) / 97.0::DOUBLE, (fault % 7) / 7.0::DOUBLE) AS score,
CASE WHEN greatest((component % 97) / 97.0::DOUBLE, (fault % 7) / 7.0::DOUBLE) < 0.7 THEN 'low' WHEN greatest((component % 97) / 97.0::DOUBLE, (fault % 7) / 7.0::DOUBLE) >= 0.85 AND device % 2 = 0 THEN 'high' ELSE 'medium' END AS tier FROM p""")
def j6_scored_paths(spark, d):
    owns, causes, _ = edges(spark, d)
    cs = causes.select("component").distinct().withColumn("score", (F.col("component") % 97) / 97.0)
    fs = causes.select("fault").distinct().withColumn("score", (F.col("fault") % 7) / 7.0)
    out = graph.scored_paths(owns.join(causes, "component"), cs, fs).select("device", "component", "fault", "score")
    return out.withColumn("tier", graph.path_tier(F.col("score"), F.lit(False), F.col("device") % 2 == 0))


@query("""SELECT p_partkey AS node, sha256(lower(trim(p_name)) || chr(31) || lower(trim(p_brand))) AS stable_id FROM part""")
def c11_stable_id(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), graph.stable_id(F.col("p_name"), F.col("p_brand")).alias("stable_id"))


@query(EDGES_SQL + """, c AS (SELECT 'nodes' AS metric, count(*)::DOUBLE AS actual FROM supplier UNION ALL SELECT 'orphans', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT component FROM owns) UNION ALL SELECT 'edges', count(*) FROM owns)
SELECT metric, actual, CASE WHEN metric = 'nodes' AND actual < 1000000 THEN 'nodes_low' WHEN metric = 'orphans' AND actual > 0 THEN 'orphans_high' WHEN metric = 'edges' AND actual < 1 THEN 'edges_low' END AS violation FROM c""")
def a26_readiness(spark, d):
    owns, _, _ = edges(spark, d)
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("component"))
    found = usage.totals(nodes=nodes, orphans=graph.orphans(nodes, owns, "component"), edges=owns).select(F.col("name").alias("metric"), F.col("n").cast("double").alias("actual"))
    policy = spark.sql("SELECT * FROM VALUES ('nodes', 1e6, NULL), ('orphans', NULL, 0D), ('edges', 1D, NULL) AS p(metric, minimum, maximum)")
    return graph.readiness(found, policy).select("metric", "actual", "violation")


@query("""WITH nodes AS (SELECT 'd' || s_suppkey AS id, 'Device' AS label, NULL AS document, NULL AS section, NULL AS chunk, 0 AS nv FROM supplier UNION ALL SELECT 'c' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Component' ELSE 'Fault' END, CASE WHEN p_partkey % 3 > 0 THEN 'x' END, CASE WHEN p_size > 5 THEN 's' ELSE ' ' END, 'k' || p_partkey % 90, p_size % 2 FROM part),
edges AS (SELECT 'd' || l_suppkey AS src, 'c' || l_partkey AS dst, 'OWNS' AS type FROM lineitem WHERE l_partkey % 2 = 0 AND l_linenumber = 1 UNION ALL SELECT 'c' || l_partkey - l_partkey % 2, 'c' || (l_partkey - l_partkey % 2 + 1), 'CAUSES' FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'A'),
p AS (SELECT c.id AS component, f.* FROM edges o JOIN nodes dv ON dv.id = o.src AND dv.label = 'Device' JOIN nodes c ON c.id = o.dst AND c.label = 'Component' JOIN edges e ON e.src = c.id AND e.type = 'CAUSES' JOIN nodes f ON f.id = e.dst AND f.label = 'Fault' WHERE o.type = 'OWNS'),
n AS (SELECT count(*) FILTER (label = 'Device') AS d, count(*) FILTER (label = 'Component') AS c, count(*) FILTER (label = 'Fault') AS f, count(*) FILTER (label = 'Component' AND nv > 0) AS cv, count(*) FILTER (label = 'Fault' AND nv > 0) AS fv FROM nodes),
k AS (SELECT count(DISTINCT chunk) AS a, count(DISTINCT chunk) FILTER (substr(chunk, 2)::INT < 60) AS b FROM p),
x AS (SELECT count(*) AS n, count(*) FILTER (document = 'x' AND section = 's') AS s FROM p)
SELECT metric, round(actual::DOUBLE, 6) AS actual FROM (
SELECT 'device_count' AS metric, d AS actual FROM n UNION ALL SELECT 'component_count', c FROM n UNION ALL SELECT 'fault_count', f FROM n UNION ALL SELECT 'solution_count', 0 UNION ALL SELECT 'component_embedding_count', cv FROM n UNION ALL SELECT 'fault_embedding_count', fv FROM n
UNION ALL SELECT 'owns_count', count(*) FROM edges WHERE type = 'OWNS' UNION ALL SELECT 'causes_count', count(*) FROM edges WHERE type = 'CAUSES' UNION ALL SELECT 'has_solution_count', 0
UNION ALL SELECT 'orphan_fault_count', count(*) FROM nodes WHERE label = 'Fault' AND id NOT IN (SELECT dst FROM edges WHERE type = 'CAUSES' AND src IN (SELECT id FROM nodes WHERE label = 'Component')) UNION ALL SELECT 'orphan_solution_count', 0
UNION ALL SELECT 'complete_path_count', n FROM x UNION ALL SELECT 'graph_source_chunk_count', a FROM k UNION ALL SELECT 'resolved_source_chunk_count', b FROM k
UNION ALL SELECT 'component_embedding_coverage', cv / c FROM n UNION ALL SELECT 'fault_embedding_coverage', fv / f FROM n UNION ALL SELECT 'path_identity_coverage', CASE WHEN n > 0 THEN 1 ELSE 0 END FROM x
UNION ALL SELECT 'path_provenance_coverage', CASE WHEN n > 0 THEN s / n ELSE 0 END FROM x UNION ALL SELECT 'chunk_round_trip_coverage', CASE WHEN a > 0 THEN b / a ELSE 0 END FROM k)""")
def a26_graph_metrics(spark, d):
    """A26's counts and coverages over suppliers as devices and parts as components and faults."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    null, part = F.lit(None).cast("string"), F.col("p_partkey")
    devices = table(spark, d, "supplier").select(text("d", F.col("s_suppkey")).alias("id"), F.lit("Device").alias("label"), null.alias("document"), null.alias("version"), null.alias("section"), F.array().cast("array<string>").alias("chunks"), F.lit(0).alias("n_vector"))
    parts = table(spark, d, "part").select(
        text("c", part).alias("id"), F.when(part % 2 == 0, "Component").otherwise("Fault").alias("label"), F.when(part % 3 > 0, "x").alias("document"), F.lit("1").alias("version"), F.when(F.col("p_size") > 5, "s").otherwise(" ").alias("section"),
        F.array(text("k", part % 90), F.lit(" ")).alias("chunks"), (F.col("p_size") % 2).alias("n_vector"))
    items, key = table(spark, d, "lineitem"), F.col("l_partkey")
    owns = items.where("l_partkey % 2 = 0 AND l_linenumber = 1").select(text("d", F.col("l_suppkey")).alias("src"), text("c", key).alias("dst"), F.lit("OWNS").alias("type"))
    causes = items.where("l_linenumber = 2 AND l_returnflag = 'A'").select(text("c", key - key % 2).alias("src"), text("c", key - key % 2 + 1).alias("dst"), F.lit("CAUSES").alias("type"))
    known = spark.range(60).select(text("k", F.col("id")).alias("chunk"))
    return graph.graph_metrics(devices.unionByName(parts), owns.unionByName(causes), known)


@query("""WITH t AS (SELECT l_partkey AS key, CASE WHEN l_linenumber > 1 THEN l_returnflag END AS name, l_suppkey AS manual, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem)
SELECT key, arg_min(name, arrival) FILTER (name IS NOT NULL) AS name, string_agg(DISTINCT manual::VARCHAR, ',' ORDER BY manual::VARCHAR) AS manuals, min(page) AS min_page, max(page) AS max_page, count(*) AS n FROM t GROUP BY key""")
def l4_merge_nodes(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("key"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("name"), F.col("l_suppkey").alias("manual"),
        F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
    )
    return graph.merge_nodes(rows)


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey % 3 AS a, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS b, o_orderkey % 9 = 0 AS verified, CASE WHEN o_orderstatus = 'P' THEN 1 END AS task FROM orders),
e AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders UNION ALL SELECT o_orderkey, o_orderkey * 2 FROM orders),
c AS (SELECT id FROM n WHERE (a = 0 OR b = 0) AND coalesce(b, 0) = 0 AND a = 0 AND NOT verified AND task IS NULL),
r AS (SELECT id, id AS node, 0 AS h FROM c UNION SELECT r.id, e.dst, h + 1 FROM r JOIN e ON e.src = r.node WHERE h < 3)
SELECT id FROM c WHERE id NOT IN (SELECT r.id FROM r JOIN n ON n.id = r.node WHERE h > 0 AND (verified OR task IS NOT NULL))""")
def l5_removable(spark, d):
    orders = table(spark, d, "orders")
    manuals = F.array_compact(F.array(F.col("o_custkey") % 3, F.when(F.col("o_orderkey") % 5 == 0, 1)))
    nodes = orders.select(F.col("o_orderkey").alias("id"), manuals.alias("manuals"), (F.col("o_orderkey") % 9 == 0).alias("verified"), F.when(F.col("o_orderstatus") == "P", 1).alias("task"))
    out = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")).unionByName(orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") * 2).alias("dst")))
    return graph.removable(nodes, out, 0)


@query("""WITH c AS (SELECT DISTINCT l_partkey AS device, l_suppkey AS fault FROM lineitem), s AS (SELECT s_suppkey AS fault, s_nationkey AS solution FROM supplier)
SELECT DISTINCT device, solution FROM c JOIN s USING (fault) JOIN nation ON n_nationkey = solution WHERE n_regionkey <> 2 AND solution NOT IN (1, 5, 9) AND fault % 7 <> 3""")
def l6_expiring(spark, d):
    causes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("device"), F.col("l_suppkey").alias("fault"))
    solves = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fault"), F.col("s_nationkey").alias("solution"))
    nation = table(spark, d, "nation")
    solutions = nation.select(F.col("n_nationkey").alias("solution"), F.when(F.col("n_regionkey") == 2, "deprecated").alias("status"))
    faults = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fault"), F.when(F.col("s_suppkey") % 7 == 3, "deprecated").alias("status"))
    return graph.expiring(causes, solves, solutions, nation.where("n_nationkey IN (1, 5, 9)").select(F.col("n_nationkey").alias("solution")), faults)


@query("""WITH v AS (SELECT o_custkey AS solution, ['REPLACE', 'KEEP', 'UNRELATED'][1 + o_orderkey % 3] AS verdict, (o_orderkey % 101) / 101.0::DOUBLE AS confidence FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY solution ORDER BY confidence DESC, verdict DESC) AS n FROM v WHERE verdict <> 'UNRELATED')
SELECT solution, verdict, confidence, CASE WHEN verdict = 'REPLACE' AND confidence >= 0.7 THEN 'deprecate' ELSE 'review' END AS action FROM b WHERE n = 1""")
def k12_route_verdicts(spark, d):
    verdict = F.get(F.array(F.lit("REPLACE"), F.lit("KEEP"), F.lit("UNRELATED")), (F.col("o_orderkey") % 3).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("solution"), verdict.alias("verdict"), ((F.col("o_orderkey") % 101) / 101.0).alias("confidence"))
    return graph.route_verdicts(rows)


@query("""WITH t AS (SELECT DISTINCT item_id AS query, left(unnest(regexp_split_to_array(lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))), ' ')), 3) AS term FROM benchmark),
n AS (SELECT query, count(*) AS n FROM t WHERE term <> '' GROUP BY query), h AS (SELECT query, p_partkey AS id, count(*) AS hits FROM t JOIN part ON term <> '' AND contains(p_name, term) GROUP BY 1, 2)
SELECT * FROM (SELECT query, id, hits, round(hits / n::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id) AS place FROM h JOIN n USING (query)) WHERE place <= 10""")
def k5_lexical_hits(spark, d):
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.transform(terms_of(F.col("text")), lambda t: F.left(t, F.lit(3)))).alias("term"))
    return graph.lexical_hits(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), terms)


# Evaluation ---------------------------------------------------------------------------------------------------------

RUNS_SQL = """
WITH base AS (SELECT doc_id AS "case", quality = 1 AS passed, doc_id % 100 + 10 AS latency FROM labels WHERE doc_id % 9 <> 0),
cand AS (SELECT doc_id AS "case", (quality = 1) <> (doc_id % 6 = 0) AS passed, doc_id % 70 + 20 AS latency FROM labels WHERE doc_id % 8 <> 0),
al AS (SELECT "case", b.passed AS base_passed, b.latency AS base_latency, c.passed AS cand_passed, c.latency AS cand_latency, CASE WHEN b.passed IS NOT NULL AND c.passed IS NOT NULL THEN 'both' WHEN b.passed IS NOT NULL THEN 'base_only' ELSE 'candidate_only' END AS side FROM base b FULL JOIN cand c USING ("case"))
"""


def runs_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, good = table(spark, d, "labels"), F.col("quality") == 1
    base = rows.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("case"), good.alias("passed"), (F.col("doc_id") % 100 + 10).alias("latency"))
    cand = rows.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("case"), (good != (F.col("doc_id") % 6 == 0)).alias("passed"), (F.col("doc_id") % 70 + 20).alias("latency"))
    return base, cand


@query(RUNS_SQL + "SELECT * FROM al")
def j16_align(spark, d):
    return evaluation.align(*runs_of(spark, d))


@query(RUNS_SQL + """SELECT CASE WHEN base_passed THEN 'pass' ELSE 'fail' END AS base, CASE WHEN cand_passed THEN 'pass' ELSE 'fail' END AS candidate, count(*) AS n, count(*) FILTER (cand_latency > 1.2 * base_latency) AS n_slower FROM al WHERE side = 'both' GROUP BY 1, 2""")
def a24_transitions(spark, d):
    return evaluation.transitions(evaluation.align(*runs_of(spark, d)))


@query(RUNS_SQL + """, m AS (SELECT count(*) FILTER (base_passed AND NOT cand_passed) AS lost, count(*) FILTER (NOT base_passed AND cand_passed) AS won FROM al WHERE side = 'both')
SELECT lost, won, CASE WHEN lost + won = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(lost + won + 1) - lgamma(i + 1) - lgamma(lost + won - i + 1) - (lost + won) * ln(2))) FROM range(0, 1000000) t(i) WHERE i <= least(lost, won))), 6) END AS p_value FROM m""")
def a23_mcnemar(spark, d):
    return evaluation.mcnemar(evaluation.align(*runs_of(spark, d)))


@query()
def a22_bootstrap(spark, d):
    rows = evaluation.align(*runs_of(spark, d)).where("side = 'both'")
    return evaluation.bootstrap(rows.select((F.col("cand_passed").cast("double") - F.col("base_passed").cast("double")).alias("delta")))


@query("""WITH r AS (SELECT 'v' || (doc_id % 3) AS variant, quality = 1 AS passed, toxic = 0 AS answerable, (doc_id % 1000)::DOUBLE AS latency_ms FROM labels)
SELECT variant, count(*) AS n, round(avg(passed::INT), 6) AS pass_rate, round(coalesce(avg(passed::INT) FILTER (answerable), 0), 6) AS answerable_pass_rate, round(coalesce(avg(passed::INT) FILTER (NOT answerable), 0), 6) AS refusal_pass_rate,
round(avg(latency_ms), 2) AS latency_mean, round(quantile_cont(latency_ms, 0.5), 2) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 2) AS latency_p95 FROM r GROUP BY variant""")
def a16_run_summary(spark, d):
    rows = table(spark, d, "labels").select(F.concat(F.lit("v"), F.col("doc_id") % 3).alias("variant"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("answerable"), (F.col("doc_id") % 1000).cast("double").alias("latency_ms"))
    return evaluation.run_summary(rows)


@query("""WITH r AS (SELECT 'v' || doc_id % 3 AS variant, CASE WHEN doc_id % 11 > 0 THEN quality = 1 END AS p, toxic = 0 AS q, doc_id % 4 > 0 AS answerable, CASE WHEN doc_id % 5 = 0 THEN 'a；b' ELSE ' ' END AS steps, doc_id % 6 = 0 AS image, CASE WHEN doc_id % 7 > 0 THEN doc_id % 10 / 10.0 END AS share, CASE WHEN doc_id % 9 > 0 THEN doc_id % 1000 END AS latency FROM labels)
SELECT variant, count(*) AS case_count, count_if(answerable) AS answerable_case_count, round(avg(coalesce(p, false)::INT), 6) AS final_pass_rate, round(avg(q::INT), 6) AS grounding_pass_rate, round(coalesce(avg(coalesce(share, 0)) FILTER (answerable), 0), 6) AS avg_required_nugget_recall,
  count_if(trim(steps) <> '') AS procedure_case_count, round(coalesce(avg(q::INT) FILTER (trim(steps) <> ''), 0), 6) AS procedure_order_pass_rate, count_if(image) AS image_case_count, round(coalesce(avg(coalesce(p, false)::INT) FILTER (image), 0), 6) AS image_pass_rate,
  round(coalesce(avg(coalesce(share, 0)) FILTER (image), 0), 6) AS avg_image_recall, count_if(NOT answerable) AS no_answer_case_count, round(coalesce(avg(q::INT) FILTER (NOT answerable), 0), 6) AS no_answer_correct_rate,
  round(coalesce(avg(latency), 0), 2) AS avg_latency_ms, round(coalesce(quantile_cont(latency::DOUBLE, 0.5), 0), 2) AS p50_latency_ms, round(coalesce(quantile_cont(latency::DOUBLE, 0.95), 0), 2) AS p95_latency_ms FROM r GROUP BY variant""")
def a16_full_summary(spark, d):
    """A16 over all subsets; some of its columns."""
    n, p, q = F.col("doc_id"), F.when(F.col("doc_id") % 11 > 0, F.col("quality") == 1), F.col("toxic") == 0
    share = F.when(n % 7 > 0, n % 10 / 10.0)
    passes = {**dict.fromkeys(evaluation.ALL_PASSES, q), **dict.fromkeys(evaluation.IMAGE_PASSES, p), "final_pass": p, "refusal_pass": q, "procedure_order_pass": q}
    rows = table(spark, d, "labels").select(
        F.concat(F.lit("v"), (n % 3).cast("string")).alias("variant"), *[v.alias(c) for c, v in passes.items()], (n % 4 > 0).alias("answerable"), F.when(n % 5 == 0, "a；b").otherwise(" ").alias("expected_step_order"), (n % 6 == 0).alias("image_eval_required"),
        *[share.alias(c) for c in ("required_nugget_recall", "image_recall", "image_precision")], F.when(n % 9 > 0, n % 1000).alias("latency_ms"))
    return evaluation.full_summary(rows, ["variant"]).select(
        "variant", "case_count", "answerable_case_count", "final_pass_rate", "grounding_pass_rate", "avg_required_nugget_recall", "procedure_case_count", "procedure_order_pass_rate", "image_case_count", "image_pass_rate", "avg_image_recall",
        "no_answer_case_count", "no_answer_correct_rate", "avg_latency_ms", "p50_latency_ms", "p95_latency_ms")


@query("""SELECT 'quality' AS metric, count(*) FILTER (quality = 1) AS numerator, count(*) FILTER (quality IS NOT NULL) AS denominator, round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IS NOT NULL), 0)::DOUBLE, 6) AS rate FROM labels
UNION ALL SELECT 'clean', count(*) FILTER (toxic = 0 AND quality = 1), count(*) FILTER (quality = 1), round(count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE, 6) FROM labels""")
def a17_metric_counts(spark, d):
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return evaluation.metric_counts(table(spark, d, "labels"), {"quality": (good, F.lit(True)), "clean": (clean, good)})


@query("""SELECT conv_id AS "case", count(*) AS turns, sum(length(text))::BIGINT AS latency, md5(string_agg(text, ' | ' ORDER BY turn)) AS queries, bool_and(length(text) > 40) AS passed FROM conversations GROUP BY conv_id""")
def a18_case_rollup(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("case"), "turn", F.col("text").alias("query"), F.length("text").alias("latency"), (F.length("text") > 40).alias("passed"))
    return evaluation.case_rollup(rows).withColumn("queries", F.md5(F.encode("queries", "UTF-8")))


@query("""WITH r AS (SELECT 'v' || (l_linenumber % 2) AS variant, l_partkey AS "case", l_discount > 0.05 AS passed, l_quantity AS score FROM lineitem)
SELECT variant, "case", 2 * count(*) FILTER (passed) >= count(*) AS passed, round(avg(score), 6) AS score, count(*) AS repetitions FROM r GROUP BY variant, "case" """)
def a19_majority(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_linenumber") % 2).alias("variant"), F.col("l_partkey").alias("case"), (F.col("l_discount") > 0.05).alias("passed"), F.col("l_quantity").alias("score"))
    return evaluation.majority(rows)


@query("""WITH r AS (SELECT DISTINCT 'v' || l_linenumber AS variant, l_partkey AS "case" FROM lineitem)
SELECT v.variant, c."case" FROM (SELECT DISTINCT variant FROM r) v, (SELECT DISTINCT "case" FROM r) c WHERE NOT EXISTS (FROM r WHERE r.variant = v.variant AND r."case" = c."case")""")
def a19_missing_cases(spark, d):
    return evaluation.missing_cases(table(spark, d, "lineitem").select(F.concat(F.lit("v"), "l_linenumber").alias("variant"), F.col("l_partkey").alias("case")))


@query("""WITH x AS (SELECT d.lang AS type, (quality = 1)::INT AS b, (toxic = 0)::INT AS c FROM labels l JOIN documents d USING (doc_id))
SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE coalesce(type, 'unspecified') END AS type, round(avg(b), 6) AS base_rate, round(avg(c), 6) AS candidate_rate, round(round(avg(c), 6) - round(avg(b), 6), 6) AS delta FROM x GROUP BY ROLLUP (type)""")
def a20_by_type(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("type")), "doc_id")
    return evaluation.by_type(rows.select("type", (F.col("quality") == 1).alias("hit")), rows.select("type", (F.col("toxic") == 0).alias("hit")))


@query("""WITH x AS (SELECT lang, source, (quality = 1)::INT - (toxic = 1)::INT AS delta FROM labels JOIN documents USING (doc_id))
SELECT 'lang' AS dimension, coalesce(nullif(trim(lang), ''), 'unspecified') AS value, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM x GROUP BY 2
UNION ALL SELECT 'source', coalesce(nullif(trim(source), ''), 'unspecified'), count(*), round(avg(delta), 6) FROM x GROUP BY 2""")
def a21_ablation(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    delta = (F.col("quality") == 1).cast("int") - (F.col("toxic") == 1).cast("int")
    return evaluation.ablation(rows.select("lang", "source", delta.alias("delta")), ["lang", "source"])


@query("""WITH f AS (SELECT p_brand AS metric, count(*) FILTER (p_size > 25) AS base_n, count(*) AS base_of, count(*) FILTER (p_retailprice > 1400) AS cand_n, count(*) FILTER (p_retailprice > 1000) AS cand_of FROM part GROUP BY p_brand)
SELECT *, CASE WHEN base_of = 0 OR cand_of = 0 THEN 'not_applicable' WHEN cand_n * base_of > base_n * cand_of THEN 'improved' WHEN cand_n * base_of < base_n * cand_of THEN 'declined' ELSE 'equal' END AS verdict FROM f""")
def a25_compare_fractions(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("metric")).agg(
        F.count_if(F.col("p_size") > 25).alias("base_n"), F.count("*").alias("base_of"), F.count_if(F.col("p_retailprice") > 1400).alias("cand_n"), F.count_if(F.col("p_retailprice") > 1000).alias("cand_of"),
    )
    return evaluation.compare_fractions(rows)


@query("""WITH c AS (SELECT doc_id % 20 + 1 AS rank, doc_id FROM labels WHERE toxic = 0 AND doc_id % 13 <> 0), r AS (SELECT CASE WHEN rank <= 6 THEN rank END AS rank, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) / 4.0::DOUBLE END AS ir, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3) / 2.0::DOUBLE END AS ip FROM c)
SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit_3, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS hit_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr,
  round(coalesce(avg(ir), 0), 6) AS image_recall, round(coalesce(avg(ip), 0), 6) AS image_precision FROM r""")
def a15_hit_summary(spark, d):
    key = F.col("doc_id")
    rank, even = key % 20 + 1, key % 2 == 0
    return evaluation.hit_summary(table(spark, d, "labels").select(
        (F.col("toxic") == 0).alias("answerable"), F.when(key % 13 == 0, True).alias("skipped"), F.when(rank <= 6, rank).alias("rank"), F.when(even, key % 5 / 4).alias("image_recall"), F.when(even, key % 3 / 2).alias("image_precision")))


@query("""SELECT l_orderkey AS "case", round(coalesce(sum(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_quantity END) FILTER (l_returnflag = 'A'), 0) / sum(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE l_quantity END), 6) AS coverage FROM lineitem GROUP BY 1""")
def a17_nugget_coverage(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).alias("weight"), (F.col("l_returnflag") == "A").alias("covered"))
    return evaluation.nugget_coverage(rows)


@query("""SELECT p_partkey AS record, s_suppkey AS document, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE s_name END AS device_type, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'nation ' || s_nationkey END AS tags FROM part JOIN supplier ON s_suppkey = p_partkey % 100""")
def l8_backfill_scope(spark, d):
    key = F.col("p_partkey")
    records = table(spark, d, "part").select(key.alias("record"), (key % 100).alias("document"), F.when(key % 3 == 0, F.col("p_brand")).otherwise(" ").alias("device_type"), F.when(key % 4 == 0, F.col("p_type")).alias("tags"))
    documents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document"), F.col("s_name").alias("device_type"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("tags"))
    return corpus.backfill_scope(records.join(documents.select("document"), "document", "left_semi"), documents, ["device_type", "tags"])


@query("""WITH x AS (SELECT doc_id AS "case", CASE WHEN doc_id % 10 > 1 THEN doc_id % 10 END AS b, CASE WHEN doc_id % 7 > 1 THEN doc_id % 7 END AS c FROM labels)
SELECT "case", coalesce(b, 999) AS base_rank, coalesce(c, 999) AS cand_rank FROM x WHERE coalesce(c, 999) > coalesce(b, 999)""")
def w14_rank_regressions(spark, d):
    ranks = lambda m: table(spark, d, "labels").select(F.col("doc_id").alias("case"), F.when(F.col("doc_id") % m > 1, F.col("doc_id") % m).alias("rank"))
    return evaluation.rank_regressions(ranks(10), ranks(7))


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
e AS (SELECT doc * 100000 + page AS id, doc, page + (doc % 3) AS page, left(line, 12) AS text FROM l WHERE trim(line) <> '')
SELECT id, EXISTS (FROM l WHERE l.doc = e.doc AND l.page BETWEEN e.page - 1 AND e.page + 1 AND contains(l.line, e.text)) AS found FROM e""")
def j14_near_pages(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc", (F.col("p") + 1).cast("long").alias("page"), "text")
    kept = pages.where(F.trim("text") != "")
    evidence = kept.select((F.col("doc") * 100000 + F.col("page")).alias("id"), "doc", (F.col("page") + F.col("doc") % 3).alias("page"), F.left("text", F.lit(12)).alias("text"))
    return evaluation.near_pages(evidence, pages)


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
e AS (SELECT doc * 100000 + page AS id, doc, page + (doc % 3) AS page, line AS text FROM l WHERE trim(line) <> '')
SELECT id, EXISTS (FROM l WHERE l.doc = e.doc AND l.page BETWEEN e.page - 1 AND e.page + 1 AND contains(l.line, e.text)) AS found FROM e""")
def j14_near_pages_whole(spark, d):
    """J14 with whole lines as evidence; ``j14_near_pages`` takes their first 12 characters, as its SQL does."""
    return whole_lines(table(spark, d, "documents"))


def whole_lines(documents: DataFrame) -> DataFrame:
    pages = documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc", (F.col("p") + 1).cast("long").alias("page"), "text")
    kept = pages.where(F.trim("text") != "")
    evidence = kept.select((F.col("doc") * 100000 + F.col("page")).alias("id"), "doc", (F.col("page") + F.col("doc") % 3).alias("page"), "text")
    return evaluation.near_pages(evidence, pages)


@query("""WITH c AS (SELECT doc_id // 2 AS "case", CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'q' END AS question, toxic = 0 AS answerable, [doc_id % 30, 3] AS pages, 20 AS n_pages, CASE WHEN quality = 1 THEN ['n'] ELSE [] END AS nuggets FROM labels),
d AS (SELECT *, count(*) OVER (PARTITION BY "case") AS k FROM c)
SELECT "case", unnest(list_filter([CASE WHEN k > 1 THEN 'duplicate_case' END, CASE WHEN trim(question) = '' THEN 'missing_question' END, CASE WHEN pages[1] < 1 OR pages[1] > n_pages THEN 'page_out_of_range' END, CASE WHEN answerable AND len(nuggets) = 0 THEN 'missing_nuggets' END], lambda x: x IS NOT NULL)) AS code FROM d""")
def a28_dataset_issues(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "labels").select(
        F.floor(n / 2).alias("case"), F.when(n % 5 == 0, " ").otherwise("q").alias("question"), (F.col("toxic") == 0).alias("answerable"), F.array(n % 30, F.lit(3)).alias("pages"),
        F.lit(20).alias("n_pages"), F.when(F.col("quality") == 1, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("nuggets"),
    )
    return evaluation.dataset_issues(rows)


_PLAIN = r"""regexp_replace(translate(lower({}), '～—–×', '---x'), '[\s，。；：、,.;:()\[\]（）【】“”"''`|=]+', '', 'g')"""
GOLD_SQL = """WITH l AS (SELECT doc_id AS document, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL),
n AS (SELECT document, max(page) AS n_pages FROM l GROUP BY document),
c AS (SELECT d.doc_id AS seq, 'c' || d.doc_id % 900 AS "case", d.doc_id AS document, d.doc_id % 4 AS target, left(b.body, 12) AS text, 1 + d.doc_id % 2 AS ep, left(b.body, 5) AS nugget, d.doc_id % 7 = 0 AS bare, coalesce(n_pages, 0) AS n_pages
  FROM documents d LEFT JOIN n ON n.document = d.doc_id LEFT JOIN l b ON b.document = d.doc_id AND b.page = 1),
f AS (SELECT c.*, trim(coalesce(c.text, '')) AS said, {plain} AS key, {plain_body} AS page_key, {plain_nugget} AS nugget_key FROM c LEFT JOIN l b ON b.document = c.document AND b.page = c.ep),
i AS (SELECT "case", 'duplicate_case_id' AS code, NULL AS page FROM (SELECT "case", row_number() OVER (PARTITION BY "case" ORDER BY seq) AS k FROM c) WHERE k > 1
  UNION ALL SELECT "case", 'target_pages_out_of_range', target FROM c WHERE target < 1 OR target > n_pages
  UNION ALL SELECT "case", 'missing_required_nuggets', NULL FROM c WHERE trim(coalesce(nugget, '')) = ''
  UNION ALL SELECT "case", 'missing_gold_evidence', NULL FROM c WHERE bare
  UNION ALL SELECT "case", 'gold_evidence_page_out_of_range', ep FROM f WHERE NOT bare AND ep > n_pages
  UNION ALL SELECT "case", 'empty_gold_evidence_text', ep FROM f WHERE NOT bare AND ep <= n_pages AND said = ''
  UNION ALL SELECT "case", 'evidence_text_not_found', ep FROM f WHERE NOT bare AND ep <= n_pages AND said <> '' AND NOT (key <> '' AND contains(page_key, key))
  UNION ALL SELECT "case", 'required_nugget_not_supported', NULL FROM f WHERE NOT bare AND trim(coalesce(nugget, '')) <> '' AND NOT (ep <= n_pages AND said <> '' AND contains(key, nugget_key)))
SELECT "case", code, page::INTEGER AS page, count(*) AS n FROM i GROUP BY ALL""".replace("{plain}", _PLAIN.format("trim(coalesce(c.text, ''))")).replace("{plain_body}", _PLAIN.format("coalesce(b.body, '')")).replace("{plain_nugget}", _PLAIN.format("trim(coalesce(nugget, ''))"))


@query(GOLD_SQL)
def a28_gold_issues(spark, d):
    """Cases about documents whose lines are pages; half of them cite the second line for a text of the first."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("document", (F.col("p") + 1).alias("page"), "text")
    n, first = F.col("doc_id"), F.get(F.split("text", "\n"), F.lit(0))
    none = lambda kind="int": F.array().cast(f"array<{kind}>")
    cited = F.struct((n % 2 + 1).cast("int").alias("page"), F.left(first, F.lit(12)).alias("text"), none("string").alias("supports"))
    cases = docs.select(
        n.alias("seq"), F.concat(F.lit("c"), (n % 900).cast("string")).alias("case"), n.alias("document"), F.array((n % 4).cast("int")).alias("target_pages"), F.lit("").alias("target_section"), F.lit(None).cast("boolean").alias("answerable"),
        F.array_compact(F.array(F.left(first, F.lit(5)))).alias("nuggets"), F.filter(F.array(cited), lambda e: n % 7 != 0).alias("evidence"), none().alias("expected_images"), none().alias("forbidden_images"), none().alias("step_image_mapping"),
        none().alias("expected_image_order"), none("string").alias("forbidden_claims"), F.lit(0).alias("n_forbidden_evidence"))
    return gold.gold_issues(cases, lines).groupBy("case", "code", "page").agg(F.count("*").alias("n"))


# Corpus -------------------------------------------------------------------------------------------------------------

LINES_SQL = r"""
WITH l AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line, source FROM documents),
k AS (SELECT * FROM l WHERE trim(line) <> '')
"""


@query(LINES_SQL + r"SELECT doc, trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g')) AS line, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 2")
def a9_repeated_lines(spark, d):
    return corpus.repeated_lines(corpus.lines(table(spark, d, "documents")))


@query(LINES_SQL + r"""SELECT doc, pos, sec AS section_id, sec || ':text:' || h AS chunk_uid, sec || '|text|' || label || '|' || page || '|' || h AS source_anchor,
  sha1(CASE WHEN t <> '' THEN 'Section: ' || t || chr(10) ELSE '' END || 'Page: ' || page || chr(10) || 'Type: ' || CASE WHEN label <> '' THEN label ELSE 'text' END || chr(10) || 'Content: ' || trim(line)) AS context_hash
FROM (SELECT doc, pos, line, CASE WHEN t <> '' THEN 'sec:' || left(sha1(regexp_replace(lower(t), '[ \t\r\n]+', '', 'g')), 10) ELSE 'sec:' || lpad((doc % 100)::VARCHAR, 4, '0') END AS sec,
  left(sha1(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'))), 12) AS h, t, page, label
  FROM (SELECT *, CASE WHEN doc % 5 = 0 THEN '' ELSE 'Part ' || source END AS t, (pos // 10)::VARCHAR AS page, CASE WHEN pos % 3 = 0 THEN '' ELSE 'general' END AS label FROM k))""")
def c9_chunk_ids(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    section = F.when(F.col("doc") % 5 == 0, " ").otherwise(F.concat(F.lit("Part "), "source"))
    rows = rows.withColumn("section", section).withColumn("section_index", F.col("doc") % 100).withColumn("page", F.floor(F.col("pos") / 10))
    return corpus.chunk_ids(rows.withColumn("chunk_type", F.lit("text")).withColumn("label", F.when(F.col("pos") % 3 == 0, "").otherwise("general")))


@query(LINES_SQL + "SELECT doc, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)")
def w2_chunk_neighbours(spark, d):
    return corpus.chunk_neighbours(corpus.lines(table(spark, d, "documents")))


@query(LINES_SQL + "SELECT doc, pos, md5(right(lag(line) OVER w, 300)) AS before, md5(left(lead(line) OVER w, 300)) AS after FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos)")
def w3_step_context(spark, d):
    out = corpus.step_context(corpus.lines(table(spark, d, "documents")))
    return out.select("doc", "pos", *[F.md5(F.encode(c, "UTF-8")).alias(c) for c in ("before", "after")])


@query(LINES_SQL + """, p AS (SELECT doc, left(line, 8) AS title, count(*) AS n, bool_or(length(line) > 30) AS clean FROM k GROUP BY 1, 2),
g AS (SELECT doc, count(*) AS titles, count(*) FILTER (clean) AS clean_titles, sum(CASE WHEN clean THEN n ELSE 0 END) / sum(n) AS share FROM p GROUP BY doc)
SELECT doc, titles, clean_titles, round(share, 6) AS share, CASE WHEN titles < 4 THEN 'few_titles' WHEN clean_titles < 3 THEN 'few_clean_titles' WHEN share < 0.3 THEN 'low_clean_share' ELSE 'ok' END AS reason FROM g""")
def a5_section_gate(spark, d):
    rows = corpus.lines(table(spark, d, "documents"))
    return corpus.section_gate(rows.withColumn("title", F.left("line", F.lit(8))), F.length("line") > 30)


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def l8_distinct_for_model(spark, d):
    return corpus.distinct_for_model(table(spark, d, "documents"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(text) END AS size, CASE WHEN text IS NOT NULL THEN length(text) - length(replace(text, ' ', '')) END AS blanks FROM documents""")
def l8_embedding_cache(spark, d):
    """Vectors of all documents after those of every second one are in the table; the model counts characters and blanks."""
    path, rows = scratch.folder(spark, "vectors"), table(spark, d, "documents").select("doc_id", "text")
    counts = lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    cache.with_vectors(rows.where("doc_id % 2 = 0"), "text", path, counts, 2)
    out = cache.with_vectors(rows, "text", path, counts, 2)
    return out.select("doc_id", F.col("vec")[0].cast("long").alias("size"), F.col("vec")[1].cast("long").alias("blanks"))


# Manuals, procedures, rules -----------------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS manual, s_name AS name, p_partkey AS document, p_name AS file, p_type AS status FROM supplier JOIN part ON p_partkey = s_suppkey * 7 WHERE p_type = 'ECONOMY'""")
def j1_inventory(spark, d):
    manuals = table(spark, d, "supplier").select(F.col("s_suppkey").alias("manual"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 7).alias("active_document"))
    documents = table(spark, d, "part").select(F.col("p_partkey").alias("document"), F.col("p_name").alias("file"), F.col("p_type").alias("status"))
    return knowledge.inventory(manuals, documents, "ECONOMY")


@query("""WITH p AS (SELECT s_suppkey AS procedure, substr(s_name, 17, 2) AS type, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 3)::VARCHAR END AS lvl, s_suppkey % 5 AS version FROM supplier WHERE s_suppkey % 4 <> 0),
m AS (SELECT p_partkey AS device, procedure, coalesce(lvl = (p_size % 3)::VARCHAR, false) AS exact, lvl, version FROM part JOIN p ON contains(p_brand, type))
SELECT device, procedure, exact FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY exact DESC, version DESC, procedure) AS n FROM m WHERE exact OR lvl IS NULL) WHERE n = 1""")
def j12_match_procedure(spark, d):
    key = F.col("s_suppkey")
    level = F.when(key % 3 != 0, (key % 3).cast("string"))
    procedures = table(spark, d, "supplier").select(
        key.alias("procedure"), F.substring("s_name", 17, 2).alias("type"), level.alias("level"), (key % 5).alias("version"), F.when(key % 4 == 0, "DRAFT").otherwise("PUBLISHED").alias("status")
    )
    devices = table(spark, d, "part").select(F.col("p_partkey").alias("device"), F.col("p_brand").alias("name"), (F.col("p_size") % 3).cast("string").alias("level"))
    return knowledge.match_procedure(devices, procedures)


@query("SELECT count(*) AS referenced, count(*) FILTER (chunk IN (SELECT doc_id FROM documents)) AS resolved FROM (SELECT DISTINCT doc_id + 20 AS chunk FROM labels)")
def j18_round_trip(spark, d):
    references = table(spark, d, "labels").select((F.col("doc_id") + 20).alias("chunk"))
    return knowledge.round_trip(references, table(spark, d, "documents").select(F.col("doc_id").alias("chunk")))


@query("""WITH a AS (SELECT DISTINCT conv_id AS session, conv_id % 10 AS "user", turn AS answer, turn - 1 AS question, conv_id::VARCHAR AS scope FROM conversations WHERE role = 'assistant'),
m AS (SELECT DISTINCT conv_id AS session, turn AS question, text AS question_text FROM conversations WHERE role = 'user')
SELECT session, "user", question, answer, scope, question_text FROM a LEFT JOIN m USING (session, question)""")
def j20_pair_feedback(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), (F.col("conv_id") % 10).alias("user"), "turn", "role", "text").distinct()
    direct, nested = F.concat(F.lit('{"scope":"'), "session", F.lit('"}')), F.concat(F.lit('{"meta":{"scope":"'), "session", F.lit('"}}'))
    response = F.when(F.col("session") % 2 == 0, direct).otherwise(nested)
    answers = rows.where("role = 'assistant'").select(F.col("turn").alias("answer"), "session", "user", (F.col("turn") - 1).alias("question"), response.alias("response")).distinct()
    return knowledge.pair_feedback(answers, rows.withColumnRenamed("turn", "message"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS query, l_suppkey AS id FROM lineitem), v AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS id FROM lineitem)
SELECT query, id, 'g' || id AS name, 'graph' AS route FROM g UNION ALL SELECT query, id, 'v' || id, 'vector' FROM v WHERE (query, id) NOT IN (SELECT query, id FROM g)""")
def u2_prefer_graph(spark, d):
    rows, key = table(spark, d, "lineitem"), F.col("id").cast("string")
    found = lambda column, prefix: rows.select(F.col("l_orderkey").alias("query"), F.col(column).alias("id")).withColumn("name", F.concat(F.lit(prefix), key))
    return knowledge.prefer_graph(found("l_suppkey", "g"), found("l_partkey", "v"))


@query("""WITH b AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), c AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id, 'left' AS side FROM b WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, 'right' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM b)""")
def u3_in_one_only(spark, d):
    return knowledge.in_one_only(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels"), "doc_id")


@query("""WITH r AS (SELECT o_custkey AS "user", o_orderkey AS id, o_orderdate AS "at", CASE o_orderstatus WHEN 'F' THEN 'maintenance_task' ELSE 'approved_case' END AS kind FROM orders WHERE o_orderstatus IN ('F', 'O')),
t AS (SELECT *, row_number() OVER (PARTITION BY "user", kind ORDER BY "at" DESC, id DESC) AS n FROM r)
SELECT * FROM (SELECT "user", id, kind, row_number() OVER (PARTITION BY "user" ORDER BY kind DESC, n) AS place FROM t WHERE n <= 10) WHERE place <= 10""")
def u6_history(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    of = lambda status: rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
    return knowledge.history(of("F"), of("O"))


@query("""WITH e AS (SELECT user_id AS document, event_id AS pos, event_id * 7 % 11 % 4 + 1 AS level, event_type AS title FROM events),
s AS (SELECT *, [max(pos) FILTER (level = 1) OVER w, max(pos) FILTER (level = 2) OVER w, max(pos) FILTER (level = 3) OVER w] AS l FROM e
  WINDOW w AS (PARTITION BY document ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT document, pos, title, level > 1 AND l[1] IS NOT NULL AS a, level > 2 AND l[2] > coalesce(l[1], -1) AS b, level > 3 AND l[3] > greatest(coalesce(l[1], -1), coalesce(l[2], -1)) AS c, l FROM s)
SELECT o.document, o.pos, concat_ws('/', CASE WHEN a THEN x.title END, CASE WHEN b THEN y.title END, CASE WHEN c THEN z.title END, o.title) AS path
FROM o LEFT JOIN e x ON x.document = o.document AND x.pos = l[1] LEFT JOIN e y ON y.document = o.document AND y.pos = l[2] LEFT JOIN e z ON z.document = o.document AND z.pos = l[3]""")
def w5_toc_paths(spark, d):
    level = F.col("event_id") * 7 % 11 % 4 + 1
    entries = table(spark, d, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("pos"), level.alias("level"), F.col("event_type").alias("title"))
    return knowledge.toc_paths(entries, 4).withColumn("path", F.array_join("path", "/"))


@query("""WITH r AS (SELECT user_id AS document, event_id AS seq, CASE WHEN event_id % 10 > 0 THEN (event_id * 13 % 997)::VARCHAR END AS chunk, (event_type = 'click')::INT AS raw,
  CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS page, CASE WHEN event_id % 4 > 0 THEN event_id % 9 END AS section FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY raw DESC, 1 + (page IS NOT NULL)::INT + (section IS NOT NULL)::INT DESC, seq) AS n FROM r)
SELECT document, chunk, seq, row_number() OVER (PARTITION BY document ORDER BY section NULLS LAST, page NULLS LAST, coalesce(chunk, ''), seq) AS place FROM k WHERE n = 1 OR chunk IS NULL""")
def w12_dedupe_records(spark, d):
    n = F.col("event_id")
    uid = F.when(n % 10 > 0, (n * 13 % 997).cast("string"))
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("document"), n.alias("seq"), F.when(n % 2 == 0, uid).otherwise("").alias("source_chunk_id"), uid.alias("chunk_uid"),
        F.when(F.col("event_type") == "click", "step_raw").alias("chunk_type"), F.when(n % 3 > 0, n % 50).alias("page"), F.when(n % 4 > 0, n % 9).alias("section"),
    )
    return knowledge.dedupe_records(rows, ["source_chunk_id", "chunk_uid"], ["document", "section", "page"], ["section", "page"])


@query("SELECT source AS kind, count(*) AS n FROM documents GROUP BY source")
def a29_storage_stats(spark, d):
    return knowledge.storage_stats(table(spark, d, "documents").select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("key")))


@query("""WITH t AS (SELECT o_orderstatus AS variant, o_custkey AS "case", o_orderkey % 2 AS repetition, o_orderkey % 3 AS turn, max_by(o_orderpriority, o_orderkey) AS sig FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY ALL)
SELECT "case", repetition, turn, concat_ws(',', CASE WHEN NOT bool_or(variant = 'F') THEN 'F' END, CASE WHEN NOT bool_or(variant = 'O') THEN 'O' END, CASE WHEN NOT bool_or(variant = 'P') THEN 'P' END) AS missing, count(DISTINCT sig) AS n_signatures
FROM t GROUP BY 1, 2, 3 HAVING count(DISTINCT variant) < 3 OR count(DISTINCT sig) > 1""")
def a37_signature_violations(spark, d):
    key = F.col("o_orderkey")
    signature = F.when(F.col("o_orderpriority").startswith("5"), " ").otherwise(F.col("o_orderpriority"))
    turns = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("variant"), F.col("o_custkey").alias("case"), (key % 2).alias("repetition"), (key % 3).alias("turn"), signature.alias("signature"), key.alias("seq")
    )
    return knowledge.signature_violations(turns, ["F", "O", "P"])


@query("""WITH h AS (SELECT doc_id AS query, doc_id % 2 AS device, regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', '', 'g') AS t, p_partkey AS rule, (doc_id + p_partkey) % 10 / 10.0::DOUBLE AS relevance, split(p_name, ' ') AS keys
  FROM documents JOIN part ON p_partkey BETWEEN doc_id % 50 AND doc_id % 50 + 4 WHERE p_partkey % 3 = 0 OR p_partkey % 3 - 1 = doc_id % 2),
r AS (SELECT *, len(list_filter(keys, lambda k: contains(t, k[1:2]))) / len(keys) AS ratio FROM h),
s AS (SELECT query, rule, round(relevance * 0.7 + ratio * 0.3, 6) AS score, round(ratio, 6) AS ratio FROM r WHERE ratio > 0 AND (relevance >= 0.5 OR ratio >= 0.5))
SELECT query, rule, score, ratio FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rule) AS n FROM s) WHERE n = 1""")
def k10_best_rule(spark, d):
    docs, key = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    near = F.explode(F.sequence(key % 50, key % 50 + 4))
    hits = docs.select(key.alias("query"), "text", (key % 2).cast("string").alias("device"), near.alias("rule")).withColumn("rank", F.col("rule")).withColumn("relevance", (F.col("query") + F.col("rule")) % 10 / 10)
    own = F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 3 - 1).cast("string"))
    keys = F.transform(F.split("p_name", " "), lambda k: F.substring(k, 1, 2))
    return knowledge.best_rule(hits, table(spark, d, "part").select(F.col("p_partkey").alias("rule"), own.alias("rule_device"), keys.alias("keys")))


@query("SELECT l_orderkey AS task, count(*) AS total_steps, 1 AS version, 'DRAFT' AS status FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag <> 'R')")
def l12_promote_tasks(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "COMPLETED").when(F.col("l_returnflag") == "N", "SKIPPED").otherwise("PENDING")
    return knowledge.promote_tasks(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), status.alias("status")))


@query(r"""WITH c AS (SELECT doc_id AS chunk, ['text', 'step', 'figure', 'error_code', 'table', 'safety'][1 + doc_id % 6] AS label, CASE WHEN doc_id % 4 > 0 THEN 'table' ELSE '' END AS kind, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, regexp_matches(t, 'and|ist') AND regexp_matches(t, 'the|der') AS pair FROM c),
r AS (SELECT chunk, CASE WHEN label = 'error_code' THEN 'explicit_diagnostic_label'
  WHEN label IN ('step', 'safety') THEN CASE WHEN pair AND regexp_matches(t, 'ion') THEN 'conditional_diagnostic_signal_pair' ELSE 'excluded_chunk_label' END
  WHEN label = 'figure' THEN 'excluded_chunk_label' WHEN (label = 'text' OR kind = 'table') AND pair THEN 'diagnostic_signal_pair' ELSE 'no_diagnostic_signal_pair' END AS reason FROM p)
SELECT chunk, reason, reason NOT IN ('excluded_chunk_label', 'no_diagnostic_signal_pair') AS selected FROM r""")
def f7_diagnostic_chunks(spark, d):
    n = F.col("doc_id")
    label = F.get(F.array(*map(F.lit, ["text", "step", "figure", "error_code", "table", "safety"])), (n % 6).cast("int"))
    chunks = table(spark, d, "documents").select(n.alias("chunk"), label.alias("label"), F.when(n % 4 > 0, "table").otherwise("").alias("chunk_type"), "text")
    return knowledge.diagnostic_chunks(chunks, "and|ist", "the|der", "ion")


@query("""WITH a AS (SELECT o_orderkey AS query, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'N') AS ok,
  coalesce(array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR) FILTER (l_returnflag <> 'N')), ','), '') AS missing, o_orderstatus AS s, o_custkey AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT query, missing, CASE WHEN s = 'P' THEN 'out_of_scope' WHEN n = 0 THEN 'no_valid_aspects' WHEN query % 7 = 0 THEN 'unresolved_conflict' WHEN query % 5 = 0 THEN 'zero_qualified_evidence'
  WHEN ok = 0 THEN 'zero_supported_aspects' WHEN ok = n THEN 'all_aspects_supported' ELSE 'missing_aspects' END AS reason FROM a)
SELECT query, reason, missing, CASE reason WHEN 'unresolved_conflict' THEN 'conflict' WHEN 'all_aspects_supported' THEN 'complete' WHEN 'missing_aspects' THEN 'partial' ELSE 'unsupported' END AS status FROM r""")
def a34_coverage(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.when(F.col("o_orderstatus") == "P", "out_of_scope").otherwise("in_scope").alias("scope"))
    aspects = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("aspect"), (F.col("l_returnflag") == "N").alias("supported"))
    return knowledge.coverage(asked, aspects, asked.where("query % 7 = 0"), asked.where("query % 5 <> 0"))


@query("""WITH f AS (SELECT l_orderkey AS "case", list(DISTINCT l_suppkey::VARCHAR) AS gc, list(DISTINCT l_partkey::VARCHAR) AS gs FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
c AS (SELECT l_orderkey AS "case", ['isolation', 'negative', 'recall_device', 'recall_free'][1 + l_orderkey % 4] AS case_type, list(DISTINCT l_suppkey::VARCHAR) AS components, list(DISTINCT l_partkey::VARCHAR) AS solutions FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
h AS (SELECT case_type, gc IS NULL AS empty, len(list_intersect(components, coalesce(gc, []))) AS ch, len(list_intersect(solutions, coalesce(gs, []))) AS sh, len(components) AS nc, len(solutions) AS ns FROM c LEFT JOIN f USING ("case"))
SELECT case_type, count(*) AS total, count(*) FILTER (CASE case_type WHEN 'isolation' THEN empty WHEN 'negative' THEN true ELSE ch = nc END) AS passed,
  round(avg(CASE WHEN case_type LIKE 'recall%' THEN (ch + sh) / (nc + ns) END), 6) AS recall FROM h GROUP BY case_type""")
def a27_graph_recall(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").cast("string").alias("component"), F.col("l_partkey").cast("string").alias("solution"), "l_quantity")
    kind = F.get(F.array(*map(F.lit, ["isolation", "negative", "recall_device", "recall_free"])), (F.col("case") % 4).cast("int"))
    cases = rows.where("l_quantity > 5").groupBy("case").agg(F.collect_set("component").alias("components"), F.collect_set("solution").alias("solutions"))
    return evaluation.graph_recall(cases.withColumn("case_type", kind).withColumn("should_be_empty", F.col("case_type") == "isolation"), rows.where("l_quantity > 10"))
