"""Manual ingest: blocks, sections and chunks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The non-blank lines of each document with their position from 0."""
    out = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    return out.where(F.trim("line") != "")


def normal(text: Column) -> Column:
    """C1 without NFKC, which Spark has not: lower case and single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def repeated_lines(rows: DataFrame, at_least=2) -> DataFrame:
    """Lines that occur ``at_least`` times in one document. rows: doc, line. Keyed by both, so no common line is hot."""
    return rows.groupBy("doc", normal(F.col("line")).alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def chunk_ids(rows: DataFrame) -> DataFrame:
    """Ids and context of chunks, none of which depends on the chunk's position.

    The section id is a hash of the title in lower case without blanks (its number without a title), the anchor ends in a hash of
    the text with single blanks. rows: doc, pos, line, section, section_index, page, chunk_type, label."""
    blank, text = r"[ \t\r\n]+", lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sha = lambda t, n: F.left(F.sha1(F.encode(t, "UTF-8")), F.lit(n))
    title, body = F.trim(text("section")), F.trim(F.regexp_replace(text("line"), blank, " "))
    known = F.concat(F.lit("sec:"), sha(F.regexp_replace(F.lower(title), blank, ""), 10))
    section = F.when(title != "", known).otherwise(F.concat(F.lit("sec:"), F.lpad(F.col("section_index").cast("string"), 4, "0")))
    short = lambda t: F.rtrim(F.left(F.trim(F.regexp_replace(t, blank, " ")), F.lit(240)))
    kind = F.when(text("label") != "", text("label")).otherwise(text("chunk_type"))
    named = [F.when(v != "", F.concat(F.lit(f"{name}: "), v)) for name, v in (("Section", short(title)), ("Page", short(text("page"))), ("Type", kind))]
    context = F.concat_ws("\n", *named, F.concat(F.lit("Content: "), F.trim(text("line"))))
    anchor = F.concat_ws("|", section, text("chunk_type"), text("label"), text("page"), sha(body, 12))
    uid = F.concat_ws(":", section, text("chunk_type"), sha(body, 12))
    return rows.select("doc", "pos", section.alias("section_id"), uid.alias("chunk_uid"), anchor.alias("source_anchor"), F.sha1(F.encode(context, "UTF-8")).alias("context_hash"))


def chunk_neighbours(rows: DataFrame) -> DataFrame:
    """Previous and next chunk of the same document. rows: doc, pos."""
    order = Window.partitionBy("doc").orderBy("pos")
    return rows.select("doc", "pos", F.lag("pos").over(order).alias("prev_pos"), F.lead("pos").over(order).alias("next_pos"))


def step_context(rows: DataFrame, size=300) -> DataFrame:
    """The last characters of the step before and the first of the step after. rows: doc, pos, line."""
    order = Window.partitionBy("doc").orderBy("pos")
    before, after = F.lag("line").over(order), F.lead("line").over(order)
    return rows.select("doc", "pos", F.right(before, F.lit(size)).alias("before"), F.left(after, F.lit(size)).alias("after"))


def section_gate(rows: DataFrame, clean: Column, titles=4, clean_titles=3, share=0.3) -> DataFrame:
    """A5: whether sections of a document are fit for use, with the first rule that fails. rows: doc, title; a row per chunk."""
    per = rows.withColumn("clean", clean).groupBy("doc", "title").agg(F.count("*").alias("n"), F.max("clean").alias("clean"))
    out = per.groupBy("doc").agg(F.count("*").alias("titles"), F.count_if("clean").alias("clean_titles"), (F.sum(F.when(F.col("clean"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    reason = F.when(F.col("titles") < titles, "few_titles").when(F.col("clean_titles") < clean_titles, "few_clean_titles").when(F.col("share") < share, "low_clean_share").otherwise("ok")
    return out.select("doc", "titles", "clean_titles", F.round("share", 6).alias("share"), reason.alias("reason"))


def table_rejection(rows: Column) -> Column:
    """Why an array of rows of cells is no table, the first rule that fails; empty if it is one.

    Rows without text do not count. Rules: two rows and columns, four filled cells, a quarter filled, half of the rows (two at least)
    with two filled cells, and fewer than half with nothing but one long text."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    filled = F.transform(clean, lambda r: F.filter(r, lambda c: c != ""))
    n, widest = F.size(clean), F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0))
    cells = F.size(F.flatten(filled))
    several = F.size(F.filter(filled, lambda r: F.size(r) >= 2))
    long_ = F.size(F.filter(filled, lambda r: (F.size(r) == 1) & (F.length(F.get(r, F.lit(0))) >= 80)))
    return (
        F.when(n < 2, "too_few_rows").when(widest < 2, "too_few_columns").when(cells < 4, "too_few_non_empty_cells").when(cells < 0.25 * n * widest, "too_sparse")
        .when(several < F.greatest(F.lit(2), F.floor(n / 2)), "unstable_columns").when(long_ >= 0.5 * n, "paragraph_like_rows").otherwise("")
    )


def distinct_for_model(rows: DataFrame, text="text") -> DataFrame:
    """Each text once, keyed by md5, as a model should see it."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.md5(F.encode(text, "UTF-8")).alias("text_md5")).agg(F.count("*").alias("n"))


def backfill_scope(records: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """Old records with the scope fields and tags of their document where they have none. Both: document and ``fields``."""
    known = documents.select("document", *[F.col(f).alias(f"own_{f}") for f in fields])
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return records.join(known, "document", "left").withColumns({f: F.coalesce(text(f), text(f"own_{f}")) for f in fields}).drop(*[f"own_{f}" for f in fields])
