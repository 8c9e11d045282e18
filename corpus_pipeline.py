"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of ``docs``. Null texts and texts without a letter have no language, so language ID rejects them; exact dedup and near dedup
keep one row of each class, with rows without words all kept; decontamination keeps rows without a benchmark window.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.llm import bpe, decontaminate, exact_dedup, lang_id, near_dedup
from torqueline.llm.common import remove, stored, workspace
from torqueline.llm.queries import digests, fold_of, pattern, table, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows outside the held-out third."""
    model = lang_id.train(docs.where(fold_of(F.col("doc_id")) != 1).select("text", "lang"))
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # no column clashes with those that are added
    found = lang_id.predicted(plain, model, f"c{columns.index('text')}")
    return found.where(~F.col("rejected")).select(*plain.columns).toDF(*columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("row", F.struct("*"))
    text = plain["row"][f"c{columns.index('text')}"]
    found = decontaminate.scan(plain.select("row", text.alias("text")), table(spark, sf_dir, "benchmark"), id_col="row")
    return found.where(F.size("hits") == 0).select("id.*").toDF(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    return digests(bpe.encode(docs, path, pattern(), decoded=True))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: No SQL says what the classifier and the signatures do; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
