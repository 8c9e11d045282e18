"""Registered queries of sources and sinks: each writes a table as a source has it, and reads it back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .queries import query
from .sources import tables
from .sources.scratch import folder
from .sources.tables import table
from .streaming import jobs


@query("""SELECT o_orderkey AS "case", o_orderpriority AS question, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'a' ELSE 'a|b' END AS tags, o_orderkey % 2 = 0 AS flag FROM orders""")
def s2_csv_cases(spark, d):
    """Cases from CSV files that begin with a byte order mark."""
    place, key = folder(spark, "s2"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("case"), F.col("o_orderpriority").alias("question"), F.when(key % 3 == 0, " ;").when(key % 3 == 1, "a").otherwise("a; |b").alias("tags"), F.when(key % 2 == 0, "Yes").alias("flag"))
    rows.write.option("header", True).csv(place)
    schema = StructType.fromDDL("case long, question string, tags string, flag string")
    return tables.csv_cases(spark, place, schema, lists=("tags",), flags=("flag",)).withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT 'case' AS kind, count(*) AS n, sum(doc_id)::BIGINT AS total FROM labels UNION ALL SELECT 'broken', count(*), NULL FROM labels WHERE doc_id % 7 = 0""")
def s3_jsonl_cases(spark, d):
    """S3: cases from JSON lines among blank lines, remarks and broken ones."""
    place, n = folder(spark, "s3"), F.col("doc_id")
    lines = F.array_compact(F.array(F.to_json(F.struct(n.alias("case"))), F.when(n % 5 == 0, " "), F.when(n % 3 == 0, " // a remark"), F.when(n % 7 == 0, '{"case": ')))
    table(spark, d, "labels").select(F.explode(lines).alias("value")).write.text(place)
    good, broken = tables.jsonl_cases(spark, place, StructType.fromDDL("case long"))
    sums = lambda df, kind, total: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), total.alias("total"))
    return sums(good, "case", F.sum("case")).unionByName(sums(broken, "broken", F.max(F.lit(None).cast("long"))))


@query("""SELECT 'v' || doc_id % 3 AS variant, count(*) AS n, (SELECT count(*) FROM labels) AS of_all FROM labels GROUP BY 1""")
def s4_write_results(spark, d):
    """Rows by variant and the summary beside them, read back."""
    place = folder(spark, "s4")
    rows = table(spark, d, "labels").select(F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("variant"), "doc_id")
    tables.write_results(rows, place, ["variant"], rows.agg(F.count("*").alias("of_all")))
    summary = spark.read.schema("of_all long").json(f"{place}/summary")
    return spark.read.schema("variant string, doc_id long").parquet(f"{place}/rows").groupBy("variant").agg(F.count("*").alias("n")).crossJoin(F.broadcast(summary))  # a row


STORE_SQL = """WITH old AS (SELECT p_partkey AS doc_id, 'd' || p_partkey % 9 AS document_id, p_name AS body, 0 AS written FROM part),
new AS (SELECT l_partkey AS doc_id, 'd' || l_suppkey % 9 AS document_id, l_returnflag || l_orderkey AS body, l_orderkey * 10 + l_linenumber AS written FROM lineitem WHERE l_partkey % 4 = 0),
last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY written DESC) = 1),
now AS (SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM last) UNION ALL SELECT * FROM last)
"""


def store_rows(spark, d):
    item, text = table(spark, d, "lineitem").where("l_partkey % 4 = 0"), lambda c: F.concat(F.lit("d"), (c % 9).cast("string"))
    kept = [F.lit("manual").alias("record_type"), F.lit("ready").alias("status")]
    old = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("body"), *kept, F.lit(0).cast("long").alias("written"), text(F.col("p_partkey")).alias("document_id"))
    new = item.select(
        F.col("l_partkey").alias("doc_id"), F.concat("l_returnflag", F.col("l_orderkey").cast("string")).alias("body"), *[F.lit(None).cast("string").alias(c) for c in ("record_type", "status")],
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("written"), text(F.col("l_suppkey")).alias("document_id"))
    return old, new


@query(STORE_SQL + "SELECT doc_id, document_id, body, 'manual' AS record_type, 'ready' AS status FROM now")
def s5_upsert(spark, d):
    """The last write of each record over a store of documents; keys move between documents."""
    place = folder(spark, "s5") + "/store"
    old, new = store_rows(spark, d)
    old.write.partitionBy("document_id").parquet(place)
    tables.upsert_into(spark, place, new, "document_id")
    return spark.read.parquet(place).select("doc_id", F.col("document_id").cast("string").alias("document_id"), "body", "record_type", "status")


@query(STORE_SQL + "SELECT document_id, count(*) AS n FROM old WHERE document_id <> 'd3' GROUP BY document_id")
def s6_delete(spark, d):
    """The store without the records of one document."""
    old, _ = store_rows(spark, d)
    gone = spark.createDataFrame([("d3",)], "document_id string")
    return tables.delete(old, gone).groupBy("document_id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT user_id::VARCHAR AS message_id, 'echo' AS type, true AS success, upper('u' || user_id) AS data FROM events""")
def s7_answer_messages(spark, d):
    """Each message is answered once, whatever came twice."""
    place = folder(spark, "s7")
    user = F.col("user_id").cast("string")
    rows = table(spark, d, "events").select(user.alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), user).alias("text"))
    rows.write.parquet(f"{place}/in")
    handle = lambda m: m.select("message_id", F.lit("echo").alias("type"), F.lit(True).alias("success"), F.upper("text").alias("data"))
    stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    jobs.answer_messages(stream, handle, f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("message_id string, type string, success boolean, data string").parquet(f"{place}/out/batch=*")
