"""Copies of a text take one place in a training sample."""

from collections import Counter

from torqueline.llm import lang_id, secrets


def test_language_sample_has_distinct_texts(spark):
    rows = [(f"copied words of {label} all over again", label) for label in "ab" for _ in range(400)]
    rows += [(f"text {label} number {'x' * i} of its own", label) for label in "ab" for i in range(1, 40)]
    found = lang_id.training_rows(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 60)
    per = Counter(r["label"] for r in found)
    assert per == {"a": 60, "b": 60}  # 30 texts each, whole and in part
    assert max(Counter((r["label"], tuple(r["index"]), tuple(r["value"])) for r in found).values()) <= 2


def test_secret_sample_has_distinct_excerpts(spark, monkeypatch):
    seen = []
    labelled = secrets.labelled
    monkeypatch.setattr(secrets, "labelled", lambda texts, rng: seen.extend(texts) or labelled(texts, rng))
    rows = [("token=abcdef0123456789abcdef",)] * 300 + [(f"token=abcdef0123456789abc{i:03}",) for i in range(50)]
    secrets.train(spark.createDataFrame(rows, "text string"), sample=40)
    assert len(seen) == len(set(seen)) == 40
    secrets.train(spark.createDataFrame(rows[:300], "text string"), sample=40)
    assert len(seen) == 41
