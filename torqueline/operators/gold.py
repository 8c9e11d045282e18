"""Gold cases against the pages that they cite."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answers import phrase, phrase_matched

#: What a snippet may have or lack between its characters: blanks and signs.
BETWEEN = r"[\s，。；：、,.。;:()\[\]（）【】“”\"'`|=]*"


def located(snippet: Column, page: Column) -> Column:
    """(first, last) character of a snippet on a page, from 1, whatever blanks and signs stand between; null if it is not there."""
    signs = r"([\\\[\](){}.*+?^$|])"
    letters = F.filter(F.split(phrase(snippet), ""), lambda c: c != "")
    pattern = F.concat(F.lit("("), F.array_join(F.transform(letters, lambda c: F.regexp_replace(c, signs, r"\\$1")), BETWEEN), F.lit(")"))
    low = F.lower(F.coalesce(page, F.lit("")))
    at = F.regexp_instr(low, pattern)
    return F.when((F.size(letters) > 0) & (at > 0), F.struct(at.alias("first"), (at + F.length(F.regexp_substr(low, pattern)) - 1).alias("last")))


def regexp_found(snippet: Column, page: Column) -> Column:
    return (phrase(snippet) != "") & F.contains(phrase(page), phrase(snippet))


def gold_issues(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """``case, code, field, page, value``, a row for each issue of a case.

    An id that came up before; pages outside the document, of targets, evidence, images and their order; a target section that
    neither a target page nor its neighbours have; an answerable case without nuggets; no evidence; evidence without text or whose
    text its page does not have; a nugget that no evidence names or says; forbidden claims without reasons.

    cases: seq, case, document, target_pages (array), target_section, answerable (null: yes), nuggets (array), evidence (array of page, text,
    supports), expected_images, forbidden_images, step_image_mapping, expected_image_order (arrays of pages), forbidden_claims (array),
    n_forbidden_evidence; pages: document, page, text."""
    counts = pages.groupBy("document").agg(F.max("page").alias("n_pages"))
    texts = pages.groupBy("document", "page").agg(F.first("text").alias("body"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    said = lambda c: F.filter(F.transform(none(c, "string"), lambda x: F.trim(x)), lambda x: x != "")
    rows = cases.join(counts, "document", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    rows = rows.withColumns({"nuggets": said("nuggets"), "forbidden_claims": said("forbidden_claims"), "answerable": F.coalesce("answerable", F.lit(True)), "target_section": F.trim(F.coalesce("target_section", F.lit("")))})
    issue = lambda code, field, page=None, value=None: F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), (F.lit(None) if page is None else page).cast("int").alias("page"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    outside = lambda p: p.isNull() | (p < 1) | (p > F.col("n_pages"))

    def on_pages(field: str, code: str, keep_null: bool) -> Column:
        listed = F.filter(none(field, "int"), lambda p: outside(p) if keep_null else p.isNotNull() & outside(p))
        return F.transform(listed, lambda p: issue(code, field, p, p))

    some = lambda condition, i: F.filter(F.array(i), lambda _: condition)
    nth = F.row_number().over(Window.partitionBy("case").orderBy("seq"))
    own = rows.withColumn("nth", nth).select("case", F.explode(F.concat(
        some(F.col("nth") > 1, issue("duplicate_case_id", "case_id")), on_pages("target_pages", "target_pages_out_of_range", False),
        some(F.col("answerable") & (F.size("nuggets") == 0), issue("missing_required_nuggets", "required_nuggets")),
        some(F.size(F.coalesce("evidence", F.array())) == 0, issue("missing_gold_evidence", "gold_evidence")),
        on_pages("expected_images", "expected_image_page_out_of_range", False), on_pages("forbidden_images", "forbidden_image_page_out_of_range", False),
        on_pages("step_image_mapping", "step_image_mapping_page_out_of_range", False), on_pages("expected_image_order", "expected_image_order_out_of_range", True),
        some((F.size("forbidden_claims") > 0) & (F.coalesce("n_forbidden_evidence", F.lit(0)) == 0), issue("missing_forbidden_evidence", "forbidden_evidence")),
    )).alias("i")).select("case", "i.*")

    # A target page with its neighbours, in order.
    targets = rows.where("target_section <> ''").select("seq", "case", "document", "target_section", F.explode(F.array_distinct(F.filter(none("target_pages", "int"), lambda p: p.isNotNull()))).alias("target"))
    near = targets.withColumn("page", F.explode(F.sequence(F.col("target") - 1, F.col("target") + 1))).join(texts, ["document", "page"], "left")
    joined = near.groupBy("seq", "case", "target_section", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n").alias("around"))
    missed = joined.groupBy("seq", "case", "target_section").agg(F.max(phrase_matched(F.col("target_section"), F.col("around"))).alias("found")).where("NOT found")
    sections = missed.select("case", issue("target_section_not_found", "target_section", None, F.col("target_section")).alias("i")).select("case", "i.*")

    each = rows.select("seq", "case", "document", "n_pages", "nuggets", "answerable", F.explode("evidence").alias("e"))
    each = each.select("seq", "case", "document", "n_pages", "nuggets", "answerable", F.col("e.page").alias("page"), F.trim(F.coalesce("e.text", F.lit(""))).alias("text"), F.coalesce("e.supports", F.array().cast("array<string>")).alias("supports"))
    checked = each.join(texts, ["document", "page"], "left")
    page, text = F.col("page"), F.col("text")
    wrong = F.when(outside(page), issue("gold_evidence_page_out_of_range", "gold_evidence", page, text)).when(text == "", issue("empty_gold_evidence_text", "gold_evidence", page))
    wrong = wrong.when(~regexp_found(text, F.col("body")), issue("evidence_text_not_found", "gold_evidence", page, text))
    of_evidence = checked.select("case", wrong.alias("i")).where("i IS NOT NULL").select("case", "i.*")

    usable = checked.where(~outside(page) & (text != "") & F.col("answerable"))
    backed = usable.select("seq", "case", "text", "supports", F.explode("nuggets").alias("value")).where(
        F.array_contains(F.transform("supports", lambda s: F.trim(s)), F.col("value")) | phrase_matched(F.col("value"), text)).select("seq", "value").distinct()
    asked = rows.where(F.col("answerable") & (F.size(F.coalesce("evidence", F.array())) > 0)).select("seq", "case", F.explode("nuggets").alias("value"))
    unsupported = asked.join(backed, ["seq", "value"], "left_anti").select("case", issue("required_nugget_not_supported", "required_nuggets", None, F.col("value")).alias("i")).select("case", "i.*")
    return own.unionByName(sections).unionByName(of_evidence).unionByName(unsupported)


def issue_counts(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """``kind, key, n``: cases, issues, valid and invalid cases, issues by code and by case. Rows of one case id are one invalid case."""
    total = cases.agg(F.count("*").alias("n")).select(F.lit("cases").alias("kind"), F.lit("").alias("key"), "n")
    by_code = issues.groupBy("code").agg(F.count("*").alias("n")).select(F.lit("code").alias("kind"), F.col("code").alias("key"), "n")
    by_case = issues.groupBy("case").agg(F.count("*").alias("n")).select(F.lit("case").alias("kind"), F.col("case").cast("string").alias("key"), "n")
    sums = issues.agg(F.count("*").alias("issues"), F.count_distinct("case").alias("invalid")).crossJoin(total.select(F.col("n").alias("cases")))  # a row each
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n")) for k, n in (("issues", F.col("issues")), ("invalid_cases", F.col("invalid")), ("valid_cases", F.col("cases") - F.col("invalid")))])
    return total.unionByName(sums.select(F.explode(pairs).alias("p")).select("p.kind", F.lit("").alias("key"), "p.n")).unionByName(by_code).unionByName(by_case)
