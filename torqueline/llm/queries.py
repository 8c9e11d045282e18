"""The registered queries of the operators, and their SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, html_extract, lang_id, license, near_dedup, negatives, secrets, token_store, vector_dedup, whitening
from .common import workspace

#: Where the vocabulary files of public tokenizers lie, by package; a parameter of each query that reads one.
TOKENIZERS = "public_tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).path(name)


def pattern() -> str:
    import importlib

    return importlib.import_module(TOKENIZERS).PATTERN


def hexdigest(text):
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"'\\### Assistant: </turn> ok'"
    own = spark.sql(f"SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES (0, 'user', {hard}), (1, 'assistant', {hard}) AS t(turn, role, text)")
    back = chat.read_back(chat.format_conversations(rows.unionByName(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hexdigest(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), hexdigest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), hexdigest(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("passages")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        hexdigest(items).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def fold_of(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(fold_of(F.col("doc_id")) != 1).select("text", "lang"))
    found = lang_id.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold_of(F.col("id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    return digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern(), decoded=True))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        hexdigest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = workspace(spark, "token-store")
    token_store.write(docs, folder, vocabulary("word_bpe_49k.json"), end_id=2)
    rows = token_store.checksums(token_store.read(token_store.lookup(docs, folder, "doc_id"), folder))
    key = F.when(F.col("key") != token_store.NULL_KEY, F.col("key"))
    return rows.select(key.alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=moved, anchors=vec_id % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_secrets, op3_licenses, op4_exact_dedup, op5_decontaminate, op6_near_dedup, op7_html_extract, op8_lang_id, op9_bpe, op10_token_store,
    op11_embedding_dedup, op12_whitening, op13_hard_negatives,
)}

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, contains(text, '###') OR contains(text, '</turn>') AS escaped,
    length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS escaped_chars,
    length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS role_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + 8 + CASE WHEN escaped THEN escaped_chars + 1 ELSE length(text) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text, doc_id) AS copy FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(text) AS text_sha256 FROM g
"""

LEAK_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, places.n, item_id FROM places JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Every pair of vectors with equal labels; components by the smallest id, step by step. No other route to the rows than the definition.
VECTOR_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
good AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND list_count(v) = len(v)
    AND len(list_filter(v, lambda c: NOT isfinite(c))) = 0 AND list_sum(list_transform(v, lambda c: abs(c))) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(r, least) AS (
  SELECT r, vec_id FROM e
  UNION
  SELECT l.b, p.least FROM reach p JOIN links l ON l.a = p.r),
root AS (SELECT r, min(least) AS component_id FROM reach GROUP BY r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN root USING (r)
"""

NEGATIVE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
positive AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

ORACLE_SQL = {"op1_chat_format": CHAT_SQL, "op4_exact_dedup": EXACT_SQL, "op5_decontaminate": LEAK_SQL, "op11_embedding_dedup": VECTOR_SQL, "op13_hard_negatives": NEGATIVE_SQL}
