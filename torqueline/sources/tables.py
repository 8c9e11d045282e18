"""Sources and sinks."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import gone, written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a part of a large table.
PART_ROWS = 400_000


def in_parts(rows: DataFrame, *keys: str, size=PART_ROWS) -> DataFrame:
    """``rows`` by their keys in parts of about ``size`` rows, so that what a task sorts or groups by these keys does not grow with the
    table. For tables that are counted without being computed; never fewer parts than shuffles have."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // size))
    return rows.repartition(parts, *keys)


def csv_cases(spark: SparkSession, path: str, schema: StructType, lists=(), flags=(), separator="[;|]") -> DataFrame:
    """Cases from CSV with or without a byte order mark; ``lists`` are split, ``flags`` default to false."""
    rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")
    for name in lists:
        parts = F.transform(F.split(F.coalesce(name, F.lit("")), separator), lambda part: F.trim(part))
        rows = rows.withColumn(name, F.filter(parts, lambda p: p != ""))
    for name in flags:
        rows = rows.withColumn(name, F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))).isin("true", "1", "yes"))
    return rows


def jsonl_cases(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """S3: cases from JSON lines and the rows that are no cases; blank lines and those that start with // are skipped."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    parsed = rows.withColumn("case", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json("value").isNull()
    return parsed.where(~broken).select("case.*"), parsed.where(broken).select("value")


def write_results(rows: DataFrame, path: str, by: list[str], summary: DataFrame | None = None) -> None:
    """Result rows, partitioned by run and variant, and a summary of one row as JSON beside them."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/rows")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def upsert(store: DataFrame, rows: DataFrame, key="doc_id", order="written") -> DataFrame:
    """Last write per key wins; missing ``record_type`` and ``status`` get their defaults."""
    new = rows.withColumn("record_type", F.coalesce("record_type", F.lit("manual"))).withColumn("status", F.coalesce("status", F.lit("ready")))
    last = new.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("place = 1").drop("place")
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def delete(store: DataFrame, ids: DataFrame, key="document_id") -> DataFrame:
    """The store without the records of some documents."""
    return store.join(ids.select(key), key, "left_anti")


def rewrite_partitions(spark: SparkSession, path: str, touched: DataFrame, by: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``change`` to those partitions of the store at ``path`` that ``touched`` names, and writes no others.

    The new partitions are written beside the store first, as a table that is read cannot be overwritten; a run that ends in
    between leaves the store as it was and can be repeated. Partitions without rows are removed, and so is what was written beside."""
    store = spark.read.parquet(path)
    touched = touched.select(by).distinct()
    part = store.join(touched, by, "left_semi")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    change(part).write.partitionBy(by).parquet(staged)
    new = spark.read.schema(store.schema).parquet(staged)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm = spark._jvm
    for row in touched.where(F.col(by).isNotNull()).join(new.select(by).distinct(), by, "left_anti").collect():  # names of emptied partitions
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, str(row[0]))
        gone(spark, f"{path}/{name}")
    gone(spark, staged)


def upsert_into(spark: SparkSession, path: str, rows: DataFrame, by: str, key="doc_id", order="written") -> None:
    """``upsert`` into the store at ``path``, whose partitions are named by ``by``. A key that moves to another partition leaves its old one: besides the
    partitions of ``rows`` those are rewritten that hold one of their keys."""
    store = spark.read.parquet(path)
    old = store.join(rows.select(key).distinct(), key, "left_semi").select(by)
    touched = written(rows.select(by).unionByName(old).distinct(), "touched")  # the store changes meanwhile
    rewrite_partitions(spark, path, touched, by, lambda part: upsert(part, rows, key, order).select(store.columns))
