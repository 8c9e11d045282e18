"""The stages of the pipeline against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken

from torqueline.llm import bpe, lang_id
from torqueline.llm.common import stored, workspace

from .cases import empty_rows, hard_rows
from .test_operators import SF, plain_classes, sha, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(hard_rows(spark).selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars"))
    inputs = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(stored(stage(spark, inputs[-1], SF), workspace(spark, f"test-stage-{i}")))
        if i < 4:
            assert inputs[-1].columns == docs.columns
    rows = [[tuple(r) for r in df.collect()] for df in inputs]
    kept = Counter(rows[1])
    assert not kept - Counter(rows[0])
    assert all(t for _, t, *_ in rows[1]) and sum(kept.values()) >= 0.97 * sum(bool(words(r[1])) for r in rows[0])
    groups = {}
    for r in rows[1]:
        groups.setdefault(r[1], []).append(r)
    assert Counter((r[0], r[1]) for r in rows[2]) == Counter((max((x[0] for x in g if x[0] is not None), default=None), t) for t, g in groups.items())
    classes = {c for _, c, _ in plain_classes([(r[0], r[1]) for r in rows[2]])}
    assert {r[0] for r in rows[3]} == classes and len(rows[3]) == len(classes)
    windows = set()
    for _, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(t)
        windows |= {tuple(w[p : p + 10]) for p in range(max(len(w) - 9, 1))} if w else set()
    dirty = lambda w: any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
    assert Counter(rows[4]) == Counter(r for r in rows[3] if not dirty(words(r[1])))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter((r[0], len(ids := library.encode_ordinary(r[1] or "")), sha(" ".join(map(str, ids))), sha(r[1] or "")) for r in rows[4])
    assert Counter(rows[5]) == want


def test_stages_on_an_empty_table(spark):
    docs = empty_rows(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
