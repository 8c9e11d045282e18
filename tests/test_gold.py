"""A28 by worked cases."""

from collections import Counter

from pyspark.sql import functions as F

from torqueline.operators import gold

CASE = (
    "seq long, case string, document string, target_pages array<int>, target_section string, answerable boolean, nuggets array<string>, evidence array<struct<page:int,text:string,supports:array<string>>>, "
    "expected_images array<int>, forbidden_images array<int>, step_image_mapping array<int>, expected_image_order array<int>, forbidden_claims array<string>, n_forbidden_evidence long")
PAGES = [("d", 1, "第一章 安装活塞环\n扭矩：20 N·m"), ("d", 2, "检查气缸头。清洗"), ("d", 3, None)]


def case(seq, name, **how):
    row = {"document": "d", "target_pages": [1], "target_section": "", "answerable": None, "nuggets": ["扭矩20"], "evidence": [(1, "扭矩 20N·m", [])], "expected_images": None, "forbidden_images": None,
           "step_image_mapping": None, "expected_image_order": None, "forbidden_claims": None, "n_forbidden_evidence": None, **how}
    return (seq, name, *row.values())


def test_issue_codes(spark):
    rows = [
        case(1, "fine"), case(2, "fine"), case(3, "pages", target_pages=[0, 2, 4, None], expected_images=[9, None], forbidden_images=[2, 7], step_image_mapping=[5], expected_image_order=[1, None]),
        case(4, "section", target_section="清洗气缸头", target_pages=[3]), case(5, "no section", target_section="更换皮带", target_pages=[3]), case(6, "bare", nuggets=[" "], evidence=[]),
        case(7, "refusal", answerable=False, nuggets=[], evidence=[(2, "检查 气缸头", None)], forbidden_claims=["x"]), case(8, "wrong page", evidence=[(8, "扭矩 20N·m", ["扭矩20"]), (2, " ", [])]),
        case(9, "other text", evidence=[(2, "扭矩 20N·m", [])]), case(10, "named", nuggets=["a", "b"], evidence=[(2, "清洗", [" a "])], forbidden_claims=["x"], n_forbidden_evidence=1), case(11, "elsewhere", document="none"),
    ]
    df = spark.createDataFrame(rows, CASE)
    issues = gold.gold_issues(df, spark.createDataFrame(PAGES, "document string, page int, text string"))
    got = Counter((r["case"], r["code"], r["page"], r["value"]) for r in issues.collect())
    assert got == Counter([
        ("fine", "duplicate_case_id", None, None), ("pages", "target_pages_out_of_range", 0, "0"), ("pages", "target_pages_out_of_range", 4, "4"), ("pages", "expected_image_page_out_of_range", 9, "9"),
        ("pages", "forbidden_image_page_out_of_range", 7, "7"), ("pages", "step_image_mapping_page_out_of_range", 5, "5"), ("pages", "expected_image_order_out_of_range", None, None),
        ("no section", "target_section_not_found", None, "更换皮带"), ("bare", "missing_required_nuggets", None, None), ("bare", "missing_gold_evidence", None, None), ("refusal", "missing_forbidden_evidence", None, None),
        ("wrong page", "gold_evidence_page_out_of_range", 8, "扭矩 20N·m"), ("wrong page", "empty_gold_evidence_text", 2, None), ("wrong page", "required_nugget_not_supported", None, "扭矩20"),
        ("other text", "evidence_text_not_found", 2, "扭矩 20N·m"), ("named", "required_nugget_not_supported", None, "b"),
        ("elsewhere", "target_pages_out_of_range", 1, "1"), ("elsewhere", "gold_evidence_page_out_of_range", 1, "扭矩 20N·m"), ("elsewhere", "required_nugget_not_supported", None, "扭矩20"),
    ])
    counts = {(r["kind"], r["key"]): r["n"] for r in gold.issue_counts(df, issues).collect()}
    assert counts["cases", ""] == 11 and counts["issues", ""] == 19 and counts["invalid_cases", ""] == 9 and counts["valid_cases", ""] == 2
    assert counts["code", "target_pages_out_of_range"] == 3 and counts["case", "pages"] == 6


def test_snippets_are_located_in_the_text_as_it_stands(spark):
    page = "x\n扭矩 ： 20 N·m（最大）, then A.B"
    df = spark.createDataFrame([("扭矩20n·m", page), ("a b", page), ("absent", page), ("", page), ("(最大)", page), ("x", None)], "s string, p string")
    found = df.select("s", gold.located(F.col("s"), F.col("p")).alias("at")).collect()
    assert [page[r["at"]["first"] - 1 : r["at"]["last"]] if r["at"] else None for r in found] == ["扭矩 ： 20 N·m", "A.B", None, None, "最大", None]
