"""Queries over all words and whole lines, against plain versions on small rows."""

import re
from collections import Counter

from torqueline import queries

DOCS = [(1, "pump valve seal ring"), (2, "pump valve"), (3, "ring, seal; VALVE pump pump"), (4, "pump valve seal"), (5, None), (6, "")]


def words(text):
    return [w for w in re.split("[^a-z]+", (text or "").lower()) if w]


def test_every_word_of_an_item_is_needed(spark):
    items = [(7, "Pump valve seal ring"), (8, "pump"), (9, "pump valve motor"), (10, None), (11, "seal seal ring")]
    want = set()
    for query, text in items:
        asked = set(words(text))
        found = [(-sum(Counter(words(t))[w] for w in asked), doc) for doc, t in DOCS if asked and asked <= set(words(t))]
        want |= {(query, doc, rank) for rank, (_, doc) in enumerate(sorted(found)[:10], 1)}
    out = queries.every_word(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert {(r["query"], r["doc"], r["rank"]) for r in out.collect()} == want and (7, 2) not in {(q, d) for q, d, _ in want}


def test_whole_lines_are_found(spark):
    docs = [(2, "the same start of a line, then one\nother\nthe same start of a line, then two\nother"), (3, "a\nb\nc"), (4, "x\n\ny")]
    want = {}
    for doc, text in docs:
        lines = text.split("\n")
        for page, line in enumerate(lines, 1):
            near = [lines[q - 1] for q in range(page + doc % 3 - 1, page + doc % 3 + 2) if 1 <= q <= len(lines)]
            if line.strip():
                want[doc * 100000 + page] = any(line in other for other in near)
    out = {r["id"]: r["found"] for r in queries.whole_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == want and not out[200001]
