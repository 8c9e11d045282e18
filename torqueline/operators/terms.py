"""Which texts contain which terms, without trying pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters by which a term and a text meet; a longer term is then looked for as a whole.
KEY = 32


def pieces(text: Column, lengths: list[int]) -> Column:
    """The distinct substrings of ``text`` that have one of the lengths."""
    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*map(of, lengths))))


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``text, term``: each distinct text with the distinct terms that stand in it. Empty terms stand in none.

    A term is looked up by its first ``KEY`` characters. Only lengths that occur are cut from a text, ``KEY`` of them at most, and
    what is cut meets the terms before anything else moves. Texts and terms are columns of those names."""
    wanted = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct().withColumn("piece", F.left("term", F.lit(KEY)))
    lengths = sorted(r[0] for r in wanted.select(F.length("piece")).distinct().collect())  # KEY at most
    given = texts.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    if not lengths:
        return given.crossJoin(wanted.select("term")).limit(0)
    cut = given.select("text", F.explode(pieces(F.col("text"), lengths)).alias("piece"))
    met = cut.join(wanted.hint("merge"), "piece")  # terms grow too, and are larger than their size on disk says
    return met.where((F.length("term") <= KEY) | F.contains("text", F.col("term"))).select("text", "term")
