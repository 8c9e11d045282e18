"""Rows without ids are linked and scanned like all others."""

import random
from collections import Counter

from torqueline.llm import license, near_dedup

from .test_operators import plain_classes


def versions(r, name, n, edits=2):
    base = [f"{name}{r.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for v in range(n):
        text = list(base)
        for _ in range(edits if v else 0):
            text[r.randrange(120)] = f"{name}edit{v}x{r.randint(0, 999)}"
        out.append(" ".join(text))
    return out


def test_near_copies_without_ids(spark):
    r, rows = random.Random(4), []
    rows += [(None, t) for t in versions(r, "a", 4)]  # a family without any id
    first, *rest = versions(r, "b", 12)
    rows += [(None, first)] + [(10 + i, t) for i, t in enumerate(rest)]  # one led by the text that all were made from
    one, two = versions(r, "c", 2)
    rows += [(50, one), (None, two), (None, one)]
    rows += [(60 + i, t) for i, t in enumerate(versions(r, "d", 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert Counter((x["id"], x["class_id"], x["class_size"]) for x in out) == plain_classes(rows)
    assert sorted(x["doc_id"] or 0 for x in near_dedup.keep_one(df).collect()) == [0, 10, 50, 60]


def test_notice_without_id(spark):
    notice = next(text for label, text in license.NOTICES if label == "isc")
    rows = [(None, f"before {notice} after"), (1, f"before {notice} after"), (None, "nothing here at all")]
    out = license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, r["labels"], r["score"]) for r in out) == [(0, "", 0.0), (0, "isc", 1.0), (1, "isc", 1.0)]
