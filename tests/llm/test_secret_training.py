"""The secret network learns from the findings of all texts, and all held-back ones set its threshold."""

import random
import zlib

import numpy as np

from torqueline.llm import secrets

from .test_secret_labels import key

SF = "/root/testdata/sf0.001"


def texts_with_secrets(n):
    r = random.Random(5)
    return [f"text {i} has token={key(r)} and chapter-{i}-of-the-book-{i} end" for i in range(n)]


def test_threshold_comes_from_all_held_back_secrets(spark, monkeypatch):
    monkeypatch.setattr(secrets, "GROUP", 1 << 20)
    texts = texts_with_secrets(4000)
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:500], "", None, "no candidate here"]], "text string")
    net = secrets.train(df, epochs=0, seed=2, made=0)  # untrained: the scores of a plain version are known
    found = {(x.astype(np.uint8).tobytes(), y) for t in texts for x, y, _ in secrets.labelled([t], np.random.default_rng([2, zlib.crc32(t.encode())]))}
    rows = sorted(found)
    y = np.array([label for _, label in rows])
    order = np.random.default_rng([2, 0]).permutation(len(rows))
    held = np.concatenate([own[: len(own) // 4] for own in (order[y[order] == label] for label in (0, 1))])
    assert (net.learned, net.held) == (len(rows) - len(held), len(held)) and y.sum() == 8000
    x = np.array([np.frombuffer(seen, np.uint8) for seen, _ in rows]).astype(int)
    z = secrets.Network.fresh(np.random.default_rng(2)).forward(x[held])[0]
    last = np.sort(z[y[held] == 1])[20]  # 0.99 of 2,000 stay
    at = np.log(net.threshold / (1 - net.threshold)) * net.temperature
    assert last - 1 / secrets.STEPS - 1e-5 <= at <= last + 1e-5
    kept = z >= at - 1e-6
    assert np.isclose(net.precision, y[held][kept].mean(), atol=1e-3) and np.isclose(net.found, kept[y[held] == 1].mean(), atol=1e-3)


def test_groups_learn_together_whatever_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(secrets, "GROUP", 1000)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    net, other = secrets.train(rows), secrets.train(rows.unionByName(rows.limit(50)).repartition(7))
    assert (net.conv == other.conv).all() and (net.threshold, net.learned, net.held) == (other.threshold, other.learned, other.held)
    assert net.found >= 0.98 and net.precision >= 0.8 and net.learned + net.held > 5000


def test_every_text_gets_a_planted_finding(spark):
    texts = [f"plain words of text {i} " * 3 for i in range(700)]
    found = secrets.findings(spark.createDataFrame([(t,) for t in texts], "text string"), 100, 1).collect()
    assert len(found) == 700 and 250 < sum(r["label"] for r in found) < 450
    more = secrets.findings(spark.createDataFrame([(t,) for t in texts[:10] * 20], "text string"), 100, 1).collect()
    assert len(more) == 200  # copies count once, and few texts get more each


def test_spans_that_overlap_are_found_as_by_trying_all():
    r = random.Random(8)
    for _ in range(300):
        cuts = sorted(r.sample(range(100), 2 * r.randint(0, 8)))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        start = r.randrange(100)
        end = start + r.randint(1, 20)
        assert secrets.overlapping(spans, start, end) == next((s for s in spans if s[0] < end and start < s[1]), None)
