"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the word-based operators, after A-Z have been lower-cased: runs of a-z, 0-9 and anything outside ASCII.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Over UTF-8 bytes: A-Z become a-z, a-z, 0-9 and bytes from 0x80 stay, all else becomes a space.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, where one machine runs everything, may leave that setting out."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/torqueline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` to ``path`` and reads it again: later plans start from files that any executor can read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate tables that no result reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns what this Python worker has freed to the machine: workers live on, and the next stage runs beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def text_or_empty(column):
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def folded_words(text):
    """Column of words as an array, in the JVM. A text without words has an empty array."""
    folded = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), WORD_SEPARATORS, " "))
    return F.when(F.length(folded) == 0, F.array().cast("array<string>")).otherwise(F.split(folded, " "))
