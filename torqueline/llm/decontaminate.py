"""Benchmark decontamination with an Aho-Corasick automaton.

Windows of ``window`` consecutive words of all benchmark items (an item with fewer words is one window) go into an
automaton; every text is scanned once, from end to end, and each occurrence is mapped back to word positions and to code
points of the original text.

The items are broadcast and each worker builds the automaton once. Its size is checked first: a window has about as many
nodes as bytes, and a node takes about 40 bytes. Up to ``max_nodes`` nodes (500,000 bytes of items at the default, 200 MB a
worker) there is one automaton and one scan; items of larger benchmarks are dealt to as many automata as keep each below that,
and texts are scanned once per automaton.

Defined cases: null text or item text has no words; repeated items count as one per ``item_id``; a null ``item_id`` is
ignored; repeated documents each get the same row; an empty benchmark hits nothing; empty documents give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import FOLD

SCHEMA = "id {id}, n_words long, hits array<struct<first:int,last:int>>, spans array<struct<first:int,last:int>>, items array<{item}>"


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return set()
    if len(words) < window:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)}


def automaton_of(items: list[tuple[object, str | None]], window: int) -> ahocorasick.Automaton:
    """Each window, between spaces, with its number of words and its items. One character stands for one UTF-8 byte."""
    by_window: dict[bytes, set] = {}
    for item, text in items:
        for w in windows_of(text, window):
            by_window.setdefault(w, set()).add(item)
    auto = ahocorasick.Automaton()
    for w, owners in by_window.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(owners)))
    if by_window:
        auto.make_automaton()
    return auto


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def word_offsets(data: bytes, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in the original of each run of words."""
    folded, at, bounds = data.translate(FOLD), 0, []
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    points = lambda n: len(data[:n].decode("utf-8"))
    return [(points(bounds[a][0]), points(bounds[b][1])) for a, b in wanted]


def scan_text(auto: ahocorasick.Automaton, data: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """The number of words, the hit runs of words (first, last) and the items of one text."""
    words = data.translate(FOLD).split()
    if not words or not len(auto):
        return len(words), [], set()
    joined = f" {b' '.join(words).decode('latin-1')} "
    runs, items, seen_at, seen_words = [], set(), 0, 0
    for end, (n, owners) in auto.iter(joined):
        # Spaces before the closing one are as many as the words up to it.
        seen_words += joined.count(" ", seen_at, end)
        seen_at = end
        runs.append((seen_words - n, seen_words - 1))
        items.update(owners)
    return len(words), merged(runs), items


def scan(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
         window=10, max_nodes=5_000_000) -> DataFrame:
    """One row per input row: ``id, n_words, hits, spans, items``.

    ``hits`` are runs of hit words (first, last, from 0), ``spans`` the same as code points of the original (end exclusive),
    ``items`` the distinct items with an occurring window."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    nodes = window * (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = -(-nodes // max_nodes) or 1
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = SCHEMA.format(id=docs.schema["id"].dataType.simpleString(), item=items.schema["item"].dataType.simpleString())
    if blocks > 1:  # a row number that survives reruns: equal rows have equal results
        docs = docs.withColumn("key", F.struct("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
    item_type = to_arrow_type(items.schema["item"].dataType)
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])  # of max_nodes, about
        parts.append(one_pass(docs, shared, window, schema, item_type))
    return parts[0] if blocks == 1 else combined(parts)


#: The automaton that this worker built last, by the name of its pass.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def built(name: str, items: list, window: int) -> ahocorasick.Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = automaton_of(items, window)
    return _BUILT[name]


def one_pass(docs: DataFrame, shared, window: int, schema: str, item_type) -> DataFrame:
    keyed, name = "key" in docs.columns, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = built(name, shared.value, window)
        for batch in batches:
            n, hits, spans, items = [], [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode("utf-8", "replace")
                count, runs, found = scan_text(auto, data)
                n.append(count)
                hits.append([{"first": a, "last": b} for a, b in runs])
                spans.append([{"first": a, "last": b} for a, b in word_offsets(data, runs)] if runs else [])
                items.append(sorted(found))
            pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            cols = {"id": batch.column("id"), "n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, pair), "spans": pa.array(spans, pair)}
            cols["items"] = pa.array(items, pa.list_(item_type))
            if keyed:
                cols["key"] = batch.column("key")
            yield pa.RecordBatch.from_pydict(cols)

    full = schema + (f", key {docs.schema['key'].dataType.simpleString()}" if keyed else "")
    return docs.mapInArrow(run, full)


def combined(parts: list[DataFrame]) -> DataFrame:
    """Unites the passes over several automata. Runs of several automata may touch and are merged again."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = parts[0].select("id", "key", "n_words")
    runs = F.zip_with("hits", "spans", lambda h, s: F.struct(h["first"].alias("first"), h["last"].alias("last"), s["first"].alias("start"), s["last"].alias("end")))
    found = every.where(F.size("items") > 0).groupBy("key").agg(
        F.sort_array(F.flatten(F.collect_list(runs))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    none = F.array().cast(found.schema["runs"].dataType)

    def merge(acc, x):
        top = F.element_at(acc, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))
        touches = (F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    rows = rows.join(found, "key", "left").withColumn("runs", F.aggregate(F.coalesce("runs", none), none, merge))
    pair = lambda first, last: F.transform("runs", lambda r: F.struct(r[first].alias("first"), r[last].alias("last")))
    empty = F.array().cast(found.schema["items"].dataType)
    return rows.select("id", "n_words", pair("first", "last").alias("hits"), pair("start", "end").alias("spans"), F.sort_array(F.coalesce("items", empty)).alias("items"))
