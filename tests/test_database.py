"""S1 over the database that Spark brings along."""

from pyspark.sql import functions as F

from torqueline.sources.database import database_table, key_ranges

URL = "jdbc:derby:memory:tables;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_a_table_is_read_in_even_parts(spark):
    # Half of the keys lie side by side, the others far apart; one key has many rows, some have none.
    ids = spark.range(500).select(F.col("id").alias("K")).unionByName(spark.range(500).select((F.col("id") * 1_000_003 - 250_000_000).alias("K")))
    ids = ids.unionByName(spark.range(300).select(F.lit(77).cast("long").alias("K"))).unionByName(spark.range(5).select(F.lit(None).cast("long").alias("K")))
    rows = ids.withColumn("V", F.concat(F.lit("v"), F.coalesce(F.col("K"), F.lit(-1)).cast("string")))
    rows.coalesce(1).write.jdbc(URL, "TASKS", mode="overwrite", properties=DRIVER)
    df = database_table(spark, URL, "TASKS", "K", rows=100, properties=DRIVER)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, rows.collect()))
    sizes = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 301 and sum(n > 100 for n in sizes) == 1 and len(sizes) >= 10
    found = df.where("K = 77").select("V")
    assert found.count() == 301 and "PushedFilters" in (plan := found._jdf.queryExecution().toString()) and "EqualTo(K,77)" in plan
    assert key_ranges(spark, URL, "(SELECT K FROM TASKS WHERE K > 10000000000) T", "K", 10, DRIVER) == []
    assert database_table(spark, URL, "(SELECT K FROM TASKS WHERE K > 10000000000) T", "K", properties=DRIVER).count() == 0
