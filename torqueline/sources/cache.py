"""Vectors of texts, computed once and kept in a table."""

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import there

KEPT = "key string, vec array<double>, at timestamp"


def text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def known(rows: DataFrame, path: str, dim: int, now: Column, days: int) -> DataFrame:
    """``key, vec`` of the table at ``path``: the newest vector of each text, of those with ``dim`` entries and at most ``days`` old."""
    spark = rows.sparkSession
    if not there(spark, path):
        return spark.createDataFrame([], "key string, vec array<double>")
    kept = spark.read.schema(KEPT).option("recursiveFileLookup", "true").parquet(path)
    fine = kept.where((F.size("vec") == dim) & (F.col("at") >= now - F.make_dt_interval(days=F.lit(days))))
    return fine.groupBy("key").agg(F.max_by("vec", "at").alias("vec"))


def with_vectors(rows: DataFrame, text: str, path: str, model: Callable[[list[str]], list[list[float]]], dim: int, now: Column | None = None, days=30, batch=64) -> DataFrame:
    """``rows`` with ``vec``. Texts that the table at ``path`` does not know are given to ``model``, each once and ``batch`` at a time,
    and their vectors are put into the table before they are used.

    A task that is repeated calls the model again, but only what its job commits is in the table; a job that fails leaves nothing, and
    two jobs at once at most compute a text twice, of which the newer vector is read. A null text has no vector. ``model`` must
    give ``dim`` numbers a text."""
    now = F.current_timestamp() if now is None else now
    spark = rows.sparkSession
    texts = rows.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    missing = texts.groupBy("key").agg(F.first("text").alias("text")).join(known(rows, path, dim, now, days).select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.slice(at, batch)
                made = model(part.column("text").to_pylist())
                if len(made) != len(part) or any(len(v) != dim for v in made):
                    raise ValueError(f"the model must give {dim} numbers for each of {len(part)} texts")
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made, pa.list_(pa.float64()))], ["key", "vec"])

    new = missing.mapInArrow(run, "key string, vec array<double>").withColumn("at", now)
    new.write.parquet(f"{path}/{uuid.uuid4().hex}")
    vectors = known(rows, path, dim, now, days).withColumnRenamed("key", "__key")
    return rows.join(vectors, text_key(F.col(text)) == F.col("__key"), "left").drop("__key")
