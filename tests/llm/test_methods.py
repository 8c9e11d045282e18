"""What the methods themselves promise, beyond the digests of the queries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from torqueline.llm import bpe, chat, exact_dedup, html_extract, lang_id, license, secrets, token_store
from torqueline.llm.common import workspace

SF = "/root/testdata/sf0.001"


def test_one_queue_over_many_pieces_equals_the_library():
    path, r = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(5)
    ranks = bpe.load_ranks(path)
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    signs = ("ab", "aaaaaaab", "the and in xyz", "éüñ漢字 　\n\t'", "0123456789 ", "'s't're ")
    texts = ["".join(r.choice(r.choice(signs)) for _ in range(r.randint(0, 120))) for _ in range(400)] + ["", "ab" * 500, "a" * 64, "a" * 65]
    ids, offsets = own.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode_ordinary(t) for t in texts]
    data, cuts = own.decode_all(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])] == texts
    pieces = [bytes(r.choice(b"abcde ") for _ in range(r.randint(1, 40))) for _ in range(300)]
    flat, n = own.merge_all(pieces)
    queued = np.split(flat, np.cumsum(n)[:-1])
    assert [q.tolist() for q, p in zip(queued, pieces) if p not in ranks] == [own.merge(p) for p in pieces if p not in ranks]


def test_table_of_pieces_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.Codec(bpe.load_ranks(path), public_tokenizers.PATTERN)
    words = [f"word{i} other{i * 7}" for i in range(60)]
    first = [own.encode(w) for w in words]
    assert len(own.slots) < 20 and [own.encode(w) for w in words] == first
    assert [own.decode(i).decode() for i in first] == words


@pytest.fixture(scope="module")
def network(spark):
    return secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_planted_secrets_that_no_rule_knows_are_found(network):
    rng, prose = np.random.default_rng(99), "some words of plain prose stand here before and after the run that matters in this case"
    hit = {0: [], 1: []}
    for i in range(800):
        if i % 2:
            prefix, signs, least, most = secrets.SHAPES[i // 2 % len(secrets.SHAPES)]
            run = prefix + secrets.drawn(rng, signs, int(rng.integers(least, most + 1)))
        else:
            run = secrets.look_alike(rng, i // 2)
        text = f"{prose} {run} {prose}"
        base = secrets.base_spans(text)
        if not base:
            hit[i % 2].append(any(kind == "model" for _, _, kind in secrets.scan_text(text, network)))
    assert np.mean(hit[1]) >= 0.9, np.mean(hit[1])
    assert np.mean(hit[0]) <= 0.25, np.mean(hit[0])
    assert network.found >= 0.98 and network.threshold <= 1


def test_secret_training_reads_a_bounded_sample(spark):
    rows = spark.range(5000).select(F.concat(F.lit("a text with number "), F.col("id").cast("string")).alias("text"))
    texts = secrets.chosen(rows, 100)
    assert len(texts) == 100 == len(set(texts))
    assert secrets.chosen(rows.limit(7).unionByName(rows.limit(7)), 100).__len__() == 7


def test_more_labels_than_places_are_learned(spark):
    r = random.Random(1)
    alphabet = [chr(0x4E00 + i) for i in range(4000)]
    rows = [(f"{x}" + " ".join("".join(r.sample(alphabet[13 * x : 13 * x + 13], 4)) for _ in range(20)), f"l{x:03d}") for x in range(300) for _ in range(4)]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"lang_pred": F.lit("clash"), "score": F.lit("clash")})
    model = lang_id.train(df)
    assert len(model.labels) == 300 and model.layer is not None
    out = lang_id.identify(df.withColumn("doc_id", F.lit(1)), model).collect()
    assert set(r["lang_pred"] for r in out) <= set(model.labels) and all(0 <= r["score"] <= 1 for r in out)


def test_labels_are_learned_from_few_hashes(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lang_id.training_rows(df, "text", "lang", 40)
    n = df.where("lang IS NOT NULL").select("lang").distinct().count()
    assert 0 < len(rows) <= 2 * 40 and len({r["label"] for r in rows}) == n


@pytest.mark.parametrize("inner", [
    "<datalist><option value=a></datalist>", "<button>gone", "<select><option>gone<option>gone</select>", "<svg><path>", "<noscript>", "<template><div>gone</div></template>",
    "<select><optgroup label=x><option>gone", "<button>gone</button>"])
def test_elements_without_end_tags_lose_nothing_else(inner):
    assert html_extract.main_text(f"<article><p>before</p>{inner}<p>after after</p></article>") == "before\n\nafter after"


def test_pages_without_tags_of_an_article(spark):
    prose = "This is a sentence of the text that stands in the middle of the page, and it is long enough to count. " * 2
    nav = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(12))
    page = f"<html><body><div><ul>{nav}</ul></div><div><p>{prose}</p><p>{prose}</p><p>Short end.</p></div><div><ul>{nav}</ul></div></body></html>"
    assert html_extract.main_text(page) == "\n\n".join([prose.strip(), prose.strip(), "Short end."])


def own_words(text):
    return text.split()


def plain_cover(text, template):
    """The best share of the template's words that stand in ``text`` in three-word grams within 6 of one diagonal."""
    w, t = own_words(text), own_words(template)
    hits = [(i - j, i, j) for j in range(len(t) - 2) for i in range(len(w) - 2) if w[i : i + 3] == t[j : j + 3]]
    best = 0
    for d in {x[0] for x in hits}:
        best = max(best, len({j + k for e, _, j in hits if abs(e - d) <= 6 for k in range(3)}))
    return best / len(t)


def test_notices_against_brute_force(spark):
    by = {}
    for label, text in license.NOTICES:
        by.setdefault(label, text)
    r, rows, want = random.Random(3), [], {}
    filler = lambda n: " ".join(f"w{r.randint(0, 500)}" for _ in range(n))
    for i, (label, text) in enumerate(sorted(by.items())):
        words = text.split()
        short = words[: int(len(words) * 0.4)]
        edited = [x for j, x in enumerate(words) if j % 17 != 5]  # some words left out
        for k, (body, labels) in enumerate(((words, {label}), (short, set()), (edited, {label}))):
            rows.append((10 * i + k, f"{filler(30)} {' '.join(body)} {filler(30)}"))
            want[10 * i + k] = labels
    rows += [(900, f"{by['gpl-3']} {filler(5)} {by['gpl-2']}"), (901, " ".join(x for j, x in enumerate(by["isc"].split()) for x in (x, filler(9)))), (None, by["gpl-3"])]
    want |= {900: {"gpl-2", "gpl-3"}, 901: set(), None: {"gpl-3"}}
    out = license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = {r["id"]: set(r["base_labels"].split(",")) - {""} for r in out}
    assert {r["id"]: set(r["labels"].split(",")) - {""} - (base[r["id"]] - want[r["id"]]) for r in out} == want
    for r in out:
        for p in r["passages"]:
            text = next(t for i, t in rows if i == r["id"])
            assert max(plain_cover(text, t) for label, t in license.NOTICES if label == p["label"]) >= p["cover"] - 1e-9


def test_exact_dedup_against_earlier_rows(spark):
    schema, folder = "doc_id long, text string", workspace(spark, "state")
    one = spark.createDataFrame([(1, "a"), (5, "b"), (7, None)], schema)
    two = spark.createDataFrame([(2, "a"), (3, "b"), (3, "b"), (9, "c"), (8, "")], schema)
    for digest in (exact_dedup.sha256, lambda t: F.lit("same")):
        state = f"{folder}-{hash(digest)}"
        exact_dedup.deduplicate(one, digest=digest, state=state)
        out = exact_dedup.deduplicate(two, digest=digest, state=state, earlier=one).collect()
        assert Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out) == Counter(
            [(2, 2, 2, True), (3, 5, 3, False), (3, 5, 3, False), (9, 9, 1, True), (8, 8, 2, True)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_loss_text_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "q ### x"), (1, 1, "assistant", "first </turn> \\ #"), (1, 2, "assistant", "second"), (1, 3, "user", None)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(made).first()["loss_text"] == "first </turn> \\ #second"
    none = made.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct((r["skip"] + r["keep"]).alias("skip"), F.lit(0).alias("keep"))))
    assert chat.read_back(none).first()["loss_text"] == ""


def test_shards_follow_the_bytes(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    folder, path = workspace(spark, "shards"), public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, folder, path, end_id=2, shard_bytes=2000)
    manifest = token_store.read_manifest(folder)
    assert len(manifest["shards"]) > 20
    rows = token_store.read(token_store.lookup(docs, folder, "doc_id"), folder).collect()
    assert len(rows) == 300 and len({hashlib.md5(r["ids"]).digest() for r in rows}) == 1
    assert token_store.HEADER_SIZE == 24


def test_a_repeated_call_adds_nothing(spark, tmp_path, monkeypatch):
    """The same call again, by its rows or its name, also after it had failed between its entries and the stream."""
    state, schema = f"file://{tmp_path}/state", "doc_id long, text string"
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema)
    two = spark.createDataFrame([(4, "a"), (5, "c")], schema)
    got = lambda df, **how: sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(df, state=state, **how).collect())
    first = got(one)
    assert first == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)] == got(one)
    with monkeypatch.context() as broken:
        broken.setattr(exact_dedup, "TAKEN", ("no.such.setting",))
        with pytest.raises(Exception, match="no.such.setting"):
            got(two, earlier=one, run="second")
    want = [(4, 4, 3, True), (5, 5, 1, True)]
    assert got(two, earlier=one, run="second") == want == got(two, earlier=one, run="second")
    assert got(two.limit(0), run="none") == []
