"""Each operator against a plain version of itself, on the rows of ``cases`` and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from torqueline.llm import bpe, chat, decontaminate, exact_dedup, html_extract, lang_id, license, near_dedup, queries, secrets, token_store
from torqueline.llm.common import workspace

from .cases import LONG, empty_rows, hard_rows

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return hard_rows(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\l\\b\\h <#", "", None, "###", "a: b", "\\", "plain", "</turn", "#", LONG]
    rows = [(c, t, role, hard[(c * 5 + t) % len(hard)], "x") for c in range(12) for t, role in enumerate(["user", "assistant", None, "a:b</turn>#", "assistant"])]
    rows += [(None, 0, "user", "no id", "x"), (1, 0, "user", "tie", "x"), (1, None, "assistant", "null turn", "x"), (2, 1, "assistant", "again", "x"), (2, 1, "assistant", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_back(chat.format_conversations(df)).collect()
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out} == want
    for r in out:
        said = "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["loss_text"] == said
        at, kept = 0, []
        for run in r["loss_runs"]:
            at += run["skip"]
            kept.append(r["formatted"][at : at + run["keep"]])
            at += run["keep"]
        bodies = [t["body"] for t in r["turns"] if t["role"] == "assistant"]
        assert [k for k in kept if k] == [b for b in bodies if b]
    assert chat.format_conversations(df.limit(0)).count() == 0


def plain_base(text):
    key = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, texts):
    more = ["password=token = abcdefgh", "API_KEY : 'abc/def+1", "AKIA" + "A1" * 8 + " AKIA short AKIAAKIA" + "B" * 20, "é" * 30 + "0123456789abcdef" * 3, "secret==abcdef Token=\"x\""]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    net = secrets.train(rows)
    found = [(r["id"], [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in secrets.scan(rows, net).collect()]
    want = Counter((i, tuple((s, secrets.KINDS[k], e) for s, k, e in plain_base(t or ""))) for i, t in [*texts, *((100 + i, t) for i, t in enumerate(more))])
    assert Counter((i, tuple(x for x in s if x[1] != "model")) for i, s in found) == want
    assert secrets.scan(empty_rows(spark), net).count() == 0
    assert secrets.train(empty_rows(spark)).threshold > 1


def test_secret_network_learns_and_gradients_are_right():
    rng = np.random.default_rng(3)
    net = secrets.Network.fresh(rng)
    x, y = rng.integers(0, secrets.CLASSES, (6, secrets.WIDTH)), np.array([0, 1, 0, 1, 1, 0.0])
    loss = lambda n: np.logaddexp(0, np.where(y > 0, -1, 1) * n.forward(x)[0]).mean()
    before, dense = loss(net), net.dense.copy()
    step = np.zeros_like(dense)
    for i in np.ndindex(3, 3):
        for sign in (1, -1):
            net.dense = dense.copy()
            net.dense[i] += sign * 1e-5
            step[i] += sign * loss(net) / 2e-5
    net.dense = dense.copy()
    net.learn(x, y, 1.0)
    assert np.allclose((dense - net.dense)[:3, :3], step[:3, :3], atol=1e-6)
    for _ in range(200):
        net.learn(x, y, 0.2)
    assert loss(net) < before / 4


def test_licenses(spark, docs, texts):
    mit = "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    more = [(200, "x Under the MIT-License, under the mit license"), (201, "Apache License, Version 2.0 / CC BY NC"), (202, f"pre words {mit} post"), (203, "cc by"), (204, "cc by nc cc by nc")]
    rows = docs.select("doc_id", "text", "id", "score").unionByName(spark.createDataFrame([(i, t, "x", "y") for i, t in more], "doc_id long, text string, id string, score string"))
    out = license.scan_licenses(rows).collect()
    want = Counter()
    for i, t in [*texts, *more]:
        w = words(t)
        places = sorted((p, label) for label, phrase in license.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        want[i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))] += 1
    assert Counter((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == want
    by = {r["id"]: r for r in out}
    assert by[202]["labels"] == "mit" and by[202]["passages"][0]["first"] == 2 and by[203]["labels"] == "" and by[204]["n_base"] == 2
    assert license.scan_licenses(empty_rows(spark)).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, texts, weak):
    from pyspark.sql import functions as F

    digest = (lambda t: (F.crc32(F.encode(t, "UTF-8")) % 7).cast("string")) if weak else exact_dedup.sha256
    out = exact_dedup.deduplicate(docs, digest=digest).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t or ""], len(groups[t or ""])) for i, t in texts)
    assert Counter((r["id"], r["keep_id"], r["group_size"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups) and all(r["id"] == r["keep_id"] for r in out if r["kept"])
    if not weak:
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((keep[t], t) for t in groups)
        assert exact_dedup.deduplicate(empty_rows(spark)).count() == 0 and exact_dedup.keep_one(empty_rows(spark)).count() == 0


def test_decontaminate(spark, docs, texts):
    items = [(i, t) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "Same TEXT twice"), (901, None), (902, ""), (903, "one"), (904, "same text twice"), (None, "twice over"), (905, " ".join(f"word{i}" for i in range(30, 45)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(len(w) - 9, 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    sizes = {len(k) for k in windows}
    want = Counter()
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    for limit in (10**9, 2000):  # one automaton, and several
        out = decontaminate.scan(docs, bench, max_nodes=10 * limit).collect()
        assert Counter((r["id"], r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), tuple(r["items"])) for r in out) == want
        by = {i: t for i, t in texts if i is not None}
        for r in out:
            if r["id"] is not None:
                for h, s in zip(r["hits"], r["spans"], strict=True):
                    assert words(by[r["id"]][s["first"] : s["last"]]) == words(by[r["id"]])[h["first"] : h["last"] + 1]
    assert decontaminate.scan(empty_rows(spark), bench).count() == 0
    assert all(not r["items"] for r in decontaminate.scan(docs, bench.limit(0)).collect())


def plain_classes(texts, threshold=0.8):
    def bag(t):
        w = words(t)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None

    bags = [bag(t) for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    root[top(i)] = top(j)
    members = {}
    for i, (doc, _) in enumerate(texts):
        members.setdefault(top(i), []).append(doc)
    return Counter((doc, min((d for d in members[top(i)] if d is not None), default=None), len(members[top(i)])) for i, (doc, _) in enumerate(texts))


def test_near_dedup(spark, docs, texts):
    out = near_dedup.near_duplicates(docs).collect()
    assert Counter((r["id"], r["class_id"], r["class_size"]) for r in out) == plain_classes(texts)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {(r["class_id"], r["node"] is None) for r in out}
    wordless = sum(r["node"] is None for r in out)
    assert kept.count() == len({c for c, none in classes if not none}) + wordless
    assert near_dedup.near_duplicates(empty_rows(spark)).count() == 0


def test_near_dedup_of_chains_and_shared_passages(spark):
    """Links between texts of which neither is the smallest of its bucket, and buckets of many classes."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(6):
        text = [f"g{g}w{r.randint(0, 10**6)}" for _ in range(90)]
        for step in range(12):  # each version is near the one before and further from the first
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[(step * 7) % 90] = f"edit{g}x{step}"
    for g in range(40):
        rows.append((len(rows), " ".join(passage + [f"own{g}x{i}" for i in range(r.randint(8, 40))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(df).collect()
    assert Counter((x["id"], x["class_id"], x["class_size"]) for x in out) == plain_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng, errors = np.random.default_rng(0), []
    for _ in range(60):
        a = np.sort(rng.integers(0, 2**63, 20).astype(np.uint64))
        b = np.sort(np.concatenate([a[:12], rng.integers(0, 2**63, 6).astype(np.uint64)]))
        sets = [(a, rng.integers(1, 60, 20)), (b, rng.integers(1, 60, 18))]
        s = near_dedup.signatures(sets)
        errors.append((s[0] == s[1]).mean() - near_dedup.overlap(*sets))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 + 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note --><div class="ad">Buy</div><header>Head</header>
<article><h1>Title &amp; more</h1><p><b>First   block<br>goes on<p>Second &lt;b&gt; &copy;<aside>Side</aside><ul><li>Item</li></ul>
<form><input value="x">Send</form><div id="comments"><p>Reader</p></div></article><footer>&copy; Foot</footer></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst block goes on\n\nSecond <b> ©\n\nItem"
    assert html_extract.main_text("<article><p>cut &am") == "cut &am"
    assert html_extract.main_text("<article><p>cut</p><p cla") == "cut"
    assert html_extract.main_text(None) == "" == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>")
    para = "A sentence of the main text that goes on for some while, as sentences do. " * 3
    plain = f"<body><div><a href=x>one</a> <a href=y>two</a></div><div>{para}</div><div>{para}</div><div>{para}</div>" + "<div><a href=x>link</a></div>" * 9
    assert html_extract.main_text(plain) == "\n\n".join([para.strip()] * 3)
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "u", "<article><p>" + LONG, "t")], "page_id long, url string, html string, text string")
    out = html_extract.extract(rows).collect()
    assert [len(r["text"]) for r in out if r["id"] == 2] == [len(LONG)] and len(out) == 4
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_language_id_held_out(spark, docs):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_lang_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.01 * len(held)
    model = lang_id.train(docs)
    by = {r["id"]: r for r in lang_id.identify(docs, model).collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (100001, 200001, 300001)) and by[500001]["lang_pred"] in model.labels
    assert lang_id.train(empty_rows(spark)) is None
    assert {r["lang_pred"] for r in lang_id.identify(docs, None).collect()} == {"und"}
    assert lang_id.identify(empty_rows(spark), model).count() == 0


def test_bpe_equals_the_library(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert Counter((r["id"], tuple(r["ids"])) for r in out) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in texts)
    assert Counter((r["id"], bytes(r["decoded"])) for r in out) == Counter((i, (t or "").encode()) for i, t in texts)
    assert bpe.encode(empty_rows(spark), path, public_tokenizers.PATTERN).count() == 0
    own, r = bpe.codec(path, public_tokenizers.PATTERN), random.Random(2)
    signs = [chr(i) for i in range(256)] + list("abé'st1 \n") * 9 + ["漢", "œ", " ", "　", "٣", "́", "\U0001F600", "\x1c", "​"]
    for n in [*range(60)] * 20 + [3000]:
        text = "".join(r.choice(signs) for _ in range(n))
        assert own.encode(text) == library.encode_ordinary(text)
    for text in ("ab" * 4000, "a" * 9001, "x" + "é" * 2000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_token_store(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    folder = workspace(spark, "test-store")
    more = [(302, "It'S ²3 \x85\xa0 µÀß''s x'D\x1c1"), (300, "A<|endoftext|>b  c\n\n d e f é İ ΑΣ"), (301, "it's 12 o'clock\tnow")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    token_store.write(rows, folder, path, end_id=2, keys_per_bucket=50)
    out = token_store.checksums(token_store.read(token_store.lookup(rows, folder, "doc_id"), folder)).orderBy("start").collect()
    encoded = Counter()
    for i, t in [*texts, *more]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        encoded[token_store.NULL_KEY if i is None else i, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    assert Counter((r["key"], r["n_ids"], r["crc"]) for r in out) == encoded
    assert [r["key"] for r in out] == sorted(r["key"] for r in out)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_ids"]
    strange = spark.createDataFrame([(10**15 + i,) for i in range(2000)], "key long")
    assert token_store.lookup(strange, folder).count() == 0
    none = workspace(spark, "test-store")
    token_store.write(empty_rows(spark), none, path, end_id=2)
    assert token_store.read(token_store.lookup(strange, none), none).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    mph = token_store.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(5000))
    again, _ = token_store.PerfectHash.from_bytes(mph.to_bytes())
    assert (again.slots(keys) == mph.slots(keys)).all()
