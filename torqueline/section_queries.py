"""Registered queries of section resolution, with the DuckDB SQL that says the same of all tiers but the ordered one."""

from pyspark.sql import functions as F

from .operators import sections
from .queries import query
from .sources.tables import table

#: The given texts have no Han characters; each letter becomes one, so that titles and questions are as varied as the texts.
ABC, HAN = "abcdefghijklmnopqrstuvwxyz", "气缸头活塞环曲轴箱盖传动主副磁电机转子离合器单向阀泵"


def headings(spark, d):
    """``doc_id, w, title``: the letters of each document as Han characters, and a title of their first 4 to 12."""
    w = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", ""), ABC, HAN)
    n = F.col("doc_id")
    before = F.when(n % 5 == 2, "安装").when(n % 17 == 4, "右").when(n % 17 == 5, "左").otherwise("")
    return table(spark, d, "documents").select("doc_id", w.alias("w")).withColumn("title", F.concat(before, F.substr("w", F.lit(1), (4 + n % 9).cast("int"))))


def given(spark, d):
    rows, n = headings(spark, d), F.col("doc_id")
    known = rows.select((n % 7).alias("document"), n.alias("section"), F.col("title").alias("core"))
    part = lambda a, b: F.substr("w", F.lit(a), b.cast("int") if not isinstance(b, int) else F.lit(b))
    size = 4 + n % 9
    text = (
        F.when(n % 6 == 0, F.concat(F.lit("给我看 "), "title", F.lit(" 的图 1"))).when(n % 6 == 1, F.concat(part(1, size), F.lit("怎么检查")))
        .when(n % 5 == 2, F.concat(part(1, size), F.lit("装配步骤"))).when(n % 6 == 3, F.concat(part(1, 3), F.lit("与"), part(4, size)))
        .when(n % 6 == 4, F.concat(F.lit("如何看右"), part(2, 3))).otherwise(F.concat(part(30, 3), F.lit("x"), part(50, 4)))
    )
    return rows.select(n.alias("query"), text.alias("text")), known


PLAIN_SQL = f"""
WITH h AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g'), '{ABC}', '{HAN}') AS w FROM documents),
t AS (SELECT *, CASE WHEN doc_id % 5 = 2 THEN '安装' WHEN doc_id % 17 = 4 THEN '右' WHEN doc_id % 17 = 5 THEN '左' ELSE '' END || substr(w, 1, 4 + doc_id % 9) AS title FROM h),
q0 AS (SELECT doc_id AS query, CASE WHEN doc_id % 6 = 0 THEN '给我看 ' || title || ' 的图 1' WHEN doc_id % 6 = 1 THEN substr(w, 1, 4 + doc_id % 9) || '怎么检查' WHEN doc_id % 5 = 2 THEN substr(w, 1, 4 + doc_id % 9) || '装配步骤'
  WHEN doc_id % 6 = 3 THEN substr(w, 1, 3) || '与' || substr(w, 4, 4 + doc_id % 9) WHEN doc_id % 6 = 4 THEN '如何看右' || substr(w, 2, 3) ELSE substr(w, 30, 3) || 'x' || substr(w, 50, 4) END AS text FROM t),
q AS (SELECT query, text, asked, CASE WHEN s = '' THEN asked ELSE s END AS stem FROM (
  SELECT *, regexp_replace(asked, '{sections.REQUEST}', '') AS s FROM (SELECT *, regexp_replace(text, '[^一-鿿]+', '', 'g') AS asked FROM q0 WHERE regexp_matches(text, '[一-鿿]{{2}}')))),
c AS (SELECT doc_id % 7 AS document, doc_id AS section, title AS core, regexp_replace(title, '[^一-鿿]+', '', 'g') AS key FROM t WHERE length(title) >= 2),
k AS (SELECT DISTINCT key FROM c WHERE length(key) >= 2),
held AS (SELECT query, key FROM q JOIN k ON contains(asked, key)),
longest AS (SELECT query, max(length(key)) AS longest FROM held GROUP BY query),
shared AS (SELECT query, key, len(list_filter(range(1, least(length(key), length(stem)) + 1), lambda i: left(key, i) = left(stem, i))) AS p, length(key) AS a, length(stem) AS b FROM q JOIN k ON left(key, 6) = left(stem, 6) WHERE length(key) >= 6 AND length(stem) >= 6),
stems AS (SELECT query, key, p, 4000 + 20 * p + floor(100 * (p / greatest(a, b))) AS score FROM shared WHERE p / greatest(a, b) >= 0.6),
embedded AS (SELECT query, key, 3 * length(key) AS score FROM held h JOIN longest USING (query) LEFT JOIN (SELECT query, max(p) AS beyond FROM stems GROUP BY query) USING (query)
  WHERE coalesce(beyond <= longest, true) AND NOT EXISTS (SELECT 1 FROM held o WHERE o.query = h.query AND o.key <> h.key AND contains(o.key, h.key))),
actions AS (SELECT unnest(range(1, 7)) AS i, unnest(['安装', '拆卸', '检查', '测量', '更换', '调整']) AS action, unnest([['安装', '装配', '装上'], ['拆卸', '拆除', '拆下'], ['检查', '检修', '查看'], ['测量', '检测', '测试'], ['更换', '替换'], ['调整', '调节', '校正']]) AS words, unnest(['装', '拆', '看', '测', '换', '']) AS one),
objects AS (SELECT key, words, one, substr(key, 3) AS obj FROM k JOIN actions ON starts_with(key, action) WHERE length(key) >= 4),
action AS (SELECT query, key, 2002 + 3 * length(obj) AS score FROM q JOIN objects ON contains(asked, obj) WHERE len(list_filter(words, lambda w: contains(asked, w))) > 0 OR one <> '' AND contains(replace(asked, obj, ''), one)),
sides AS (SELECT query, CASE WHEN contains(text, '右') AND NOT contains(text, '左') THEN '右' WHEN contains(text, '左') AND NOT contains(text, '右') THEN '左' END AS side FROM q),
direction AS (SELECT query, document, section, 3010 AS score FROM sides JOIN c ON contains(key, side) AND NOT contains(key, CASE side WHEN '右' THEN '左' ELSE '右' END)),
runs AS (SELECT document, section, unnest(regexp_extract_all(core, '[一-鿿]+')) AS r FROM c), own AS (SELECT DISTINCT document, section, unnest(list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), list_transform(range(1, greatest(length(r) - 1, 1)), lambda i: substr(r, i, 3)))) AS gram FROM runs),
qruns AS (SELECT query, unnest(regexp_extract_all(text, '[一-鿿]+')) AS r FROM q), said AS (SELECT DISTINCT query, unnest(list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), list_transform(range(1, greatest(length(r) - 1, 1)), lambda i: substr(r, i, 3)))) AS gram FROM qruns),
quiet AS (SELECT gram FROM own GROUP BY gram HAVING count(*) <= 5),
grams AS (SELECT query, document, section, max(length(gram)) AS score, count(*) OVER (PARTITION BY query) AS n FROM said JOIN own USING (gram) JOIN quiet USING (gram) GROUP BY query, document, section),
hits AS (SELECT query, document, section, 'embedded' AS tier, 1 AS i, score FROM embedded JOIN c USING (key) UNION ALL SELECT query, document, section, 'stem', 2, score FROM stems JOIN c USING (key)
  UNION ALL SELECT query, document, section, 'direction', 3, score FROM direction UNION ALL SELECT query, document, section, 'action', 4, score FROM action JOIN c USING (key) UNION ALL SELECT query, document, section, 'gram', 6, score FROM grams WHERE n <= 5),
first AS (SELECT * FROM hits QUALIFY i = min(i) OVER (PARTITION BY query)),
near AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM first)
SELECT query, document, section, tier, score::BIGINT AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, document, section)::INTEGER AS place
FROM near WHERE tier NOT IN ('stem', 'action') OR score >= best - 50 QUALIFY place <= 3
"""


@query(PLAIN_SQL)
def k13_sections_plain(spark, d):
    """The cascade without its ordered tier, which SQL has no function for."""
    return sections.resolve_sections(*given(spark, d), order_tier=False)


@query()
def k13_sections(spark, d):
    """The whole cascade; tests/test_sections.py compares it with a plain version."""
    return sections.resolve_sections(*given(spark, d))
