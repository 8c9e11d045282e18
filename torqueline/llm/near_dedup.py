"""Near-duplicate classes with BagMinHash signatures.

A text is the multiset of its five-word shingles. Each shingle owns independent Poisson processes over the dyadic weight
intervals [0,1), [1,2), [2,4), [4,8) ... of its integer multiplicity. A process is split at its first point: one half, by a
coin of that point, inherits it, the other goes on from there at half the rate; so only parts of the weight axis that hold
early points are ever visited, and weights that agree on an interval see the same points. The smallest point of each of
``REGISTERS`` registers is the signature: two registers agree with the probability of the weighted Jaccard similarity.

Registers are banded; texts that share a band are candidates, and a candidate pair becomes a link when the exact overlap of
its shingle multisets is ``threshold`` or more. Classes are the connected components of the links.

No group is ever expanded into all its pairs. Texts with equal words are one node. Each band bucket has a leader, the node
that meets most others over all bands (the text that copies were made from), and every member is compared exactly with it;
members that are not linked to it get a leader of their own once more. What is left to find are links between a member x in
another component than its leader L and a further member y of L's buckets. They are found by the differences from L: where
x and y differ from L in no common shingle, each shingle stands in one of them as often as in L, so x and y have at most the
similarity of x and L, which is below ``threshold``. With differences Dx and Dy, sizes X and Y and
c = (1 - threshold) / (1 + threshold), a link needs |Dx| + |Dy| - 2 |Dx and Dy| <= c (X + Y); so it has a common difference
among the first of both, in any order kept by all. Differences that only one component has cannot be common; of the others,
the rarest beside L come first, and with n of them only the first n - need + 1 of a member are looked at. What a member needs
beside others follows from the least share among them: members are put into levels by the size of their share, and one is looked at
once for each level, and not at all where n is below need, as in a group of texts that share a template and nothing else.
Members of one component do not meet where it has most of those on a difference. Only pairs that meet are compared, so no link
between texts that share a bucket is lost and few pairs are formed, however large the group.

Rows of a leader with many members are dealt out by salts, each with its own copy of the leader's bag.

Defined cases: a null text or one without words is in a class of its own; a text of fewer than five words is one shingle of
all of them; repeated rows each get a row; the class id is the smallest document id of the class (null ids last); an empty
table gives an empty result; other columns are ignored. Of each class one row is kept: one that has the class id, of several
such rows the first of those with the smallest digest; rows without words are all kept.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, give_back, remove, stored, workspace
from .components import components

REGISTERS, BANDS, ROWS = 128, 32, 4
SHINGLE = 5
U = np.uint64
#: Odd multipliers of the mixing steps.
M1, M2, GOLDEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
LEVEL, COIN, SIBLING, NEXT, REGISTER = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)
#: Most small nodes that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Most ids that are broadcast to find the rows that go; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: What tells the levels of members that are apart from their leader from those of members linked to it.
APART = 1000
#: Rows of one leader that go to one task.
SALTED = 500
#: Hashes of words kept by a worker.
WORDS = 50_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log(((mix(seed + GOLDEN) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)


class WordHashes(dict):
    """Hashes of words, emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their multiplicities."""
    h = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, U)
    for j in range(n):
        out = mix(out + GOLDEN) + h[j : j + len(out)]
    return np.unique(mix(out + U(n)), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` 32-bit values for each (hashes, multiplicities), none of which is empty."""
    out = np.zeros((len(sets), registers), np.uint32)
    todo, factor = np.arange(len(sets)), math.log(registers) + 5
    while len(todo):
        points, filled = first_points([sets[i] for i in todo], registers, factor)
        out[todo[filled]] = points[filled]
        todo, factor = todo[~filled], factor * 2
    return out


def first_points(sets, registers: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures from the points up to ``registers * factor / weight``, and whether they fill every register."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([c for _, c in sets]).astype(np.int64)
    limit = registers * factor / np.bincount(doc, weight, len(sets))
    begun = []
    for level in range(int(weight.max() - 1).bit_length() + 1):
        lo, hi = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        at = np.flatnonzero(weight > lo)
        seed = mix(element[at] ^ U(int(LEVEL) * (level + 1) % 2**64))
        x = exponential(seed) / (hi - lo)
        early = x <= limit[doc[at]]
        at, seed, x = at[early], seed[early], x[early]
        begun.append((at, seed, x, np.full(len(at), lo), np.full(len(at), hi)))
    at, seed, x, lo, hi = (np.concatenate(c) for c in zip(*begun, strict=True))
    keys, seeds, times = [], [], []

    def record(at, seed, x) -> None:
        keys.append(doc[at] * registers + (mix(seed ^ REGISTER) % U(registers)).astype(np.int64))
        seeds.append(seed)
        times.append(x)

    units = []  # processes over one unit of weight, which go on point by point
    while len(at):
        whole = hi <= weight[at]
        record(at[whole], seed[whole], x[whole])
        leaf = hi - lo == 1
        units.append((at[leaf], seed[leaf], x[leaf]))
        a, s, t, left, right = (v[~leaf] for v in (at, seed, x, lo, hi))
        half = (right - left) >> 1
        upper = (mix(s ^ COIN ^ half.astype(U)) >> U(63)).astype(np.int64)
        other = mix(s ^ SIBLING ^ (half.astype(U) * GOLDEN))
        low, high = left + upper * half, left + (1 - upper) * half
        at, seed, x = np.concatenate((a, a)), np.concatenate((s, other)), np.concatenate((t, t + exponential(other) / half))
        lo, hi = np.concatenate((low, high)), np.concatenate((low + half, high + half))
        live = (x <= limit[doc[at]]) & (lo < weight[at])
        at, seed, x, lo, hi = at[live], seed[live], x[live], lo[live], hi[live]
    at, seed, x = (np.concatenate(c) for c in zip(*units, strict=True))
    while len(at):
        seed = mix(seed ^ NEXT)
        x = x + exponential(seed)
        live = x <= limit[doc[at]]
        at, seed, x = at[live], seed[live], x[live]
        record(at, seed, x)
    key, seed, time = np.concatenate(keys), np.concatenate(seeds), np.concatenate(times)
    late_first = np.argsort(-time, kind="stable")
    best, seen = np.zeros(len(sets) * registers, U), np.zeros(len(sets) * registers, bool)
    best[key[late_first]] = seed[late_first]  # the earliest point is written last
    seen[key] = True
    return (mix(best) >> U(32)).astype(np.uint32).reshape(-1, registers), seen.reshape(-1, registers).all(1)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def sign(docs: DataFrame) -> DataFrame:
    """``id, node, sig`` of ``id, text``: ``node`` is a digest of the words; both are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            at = 0
            while at < len(texts):
                sets, where, nodes, size, start = [], [], [], 0, at
                while at < len(texts) and size < 200_000:
                    words = folded(texts[at].as_py())
                    nodes.append(hash_of(words))
                    if words:
                        where.append(at - start)
                        sets.append(shingles(words))
                        size += len(words) + 500
                    at += 1
                sigs: list[bytes | None] = [None] * (at - start)
                if sets:
                    for i, row in zip(where, signatures(sets), strict=True):
                        sigs[i] = row.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([ids[start:at], pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["id", "node", "sig"])
        give_back()

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node binary, sig binary")


def hash_of(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def packed(words: list[bytes]) -> bytes | None:
    """The shingle multiset of words: 64-bit hashes, then 32-bit multiplicities."""
    if not words:
        return None
    hashes, counts = shingles(words)
    return hashes.astype("<u8").tobytes() + counts.astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n)


def bags(texts: DataFrame) -> DataFrame:
    """``node, bag`` of ``text``: the shingle multiset, counted once for all comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                words = [folded(x.as_py()) for x in batch.column("text")[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(map(hash_of, words), pa.binary()), pa.array(map(packed, words), pa.binary())], ["node", "bag"])
        give_back()

    return texts.select("text").mapInArrow(run, "node binary, bag binary").where(F.col("node").isNotNull())


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b, near`` of the pairs (a, b, bag_a, bag_b): whether their multisets overlap by ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)
            near = pa.array([overlap(unpacked(x.as_py()), unpacked(y.as_py())) >= threshold for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), near], ["a", "b", "near"])

    return pairs.mapInArrow(run, "a binary, b binary, near boolean")


def occurrences(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The multiset as a sorted set: the n-th occurrence of a shingle is an element of its own."""
    hashes, counts = bag[0].astype(U), bag[1].astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    each = np.repeat(hashes, counts)
    return np.sort(np.where(nth == 0, each, mix(each + nth.astype(U) * GOLDEN)))


def differences(leader: np.ndarray, member: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """The member's share of ``need``, and the elements in which it differs from ``leader``."""
    found = np.setxor1d(leader, member, assume_unique=True)
    return len(found) - c * len(member), found.view(np.int64)


def spread(pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b, root, apart, share, tokens`` of the pairs (a, b, root, apart, bag_a, bag_b): the elements in which ``b`` differs from its
    leader ``a``, and its share of ``need``: two members need (share + share) / 2 common differences."""
    c = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                share, tokens = [], []
                for x, y in zip(part.column("bag_a"), part.column("bag_b"), strict=True):
                    of, found = differences(occurrences(unpacked(x.as_py())), occurrences(unpacked(y.as_py())), c)
                    share.append(of)
                    tokens.append(found)
                new = [pa.array(share, pa.float64()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in ("a", "b", "root", "apart")] + new, ["a", "b", "root", "apart", "share", "tokens"])
        give_back()

    return pairs.mapInArrow(run, "a binary, b binary, root binary, apart boolean, share double, tokens array<long>")


def least_common(share, other):
    """The common differences that members of these shares need."""
    return F.greatest(F.lit(1).cast("long"), F.ceil((share + other) / 2 - 1e-9))


class Graph:
    """Candidates, links and components of one run, all as tables in the shared folder."""

    def __init__(self, docs: DataFrame, folder: str, threshold: float) -> None:
        self.spark, self.folder, self.threshold, self.tables = docs.sparkSession, folder, threshold, 0
        self.signed = self.keep(sign(docs))
        nodes = self.signed.where(F.col("node").isNotNull()).groupBy("node")
        self.nodes = self.keep(nodes.agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("sig").alias("sig")))
        self.docs = docs

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return stored(df, f"{self.folder}/{self.tables}")

    def members(self) -> DataFrame:
        """``bucket, node, meets`` of each bucket with two nodes at least; a node meets so many nodes over all its buckets."""
        size = 4 * ROWS
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr(F.col("sig"), i * size + 1, F.lit(size))))
        rows = self.nodes.select("node", F.explode(bands).alias("bucket"))
        # A stored table on the small side of each join lets Spark split a hot key of the large side.
        shared = self.keep(rows.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"))
        rows = self.keep(rows.join(shared, "bucket").select("bucket", "node", "k"))
        return self.keep(rows.join(rows.groupBy("node").agg(F.sum("k").alias("meets")), "node").select("bucket", "node", "meets"))

    def candidate_bags(self, members: DataFrame) -> DataFrame:
        """``node, bag`` of the nodes that share a bucket."""
        wanted = self.keep(members.select("node").distinct().join(self.nodes, "node").select("node", "id"))
        small = wanted.count() <= BROADCAST_NODES
        ids = wanted.select("id").distinct()
        texts = self.docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")
        if not wanted.where(F.col("id").isNull()).isEmpty():  # a node of rows without ids is found by its digest alone
            texts = texts.unionByName(self.docs.where(F.col("id").isNull()))
        return self.keep(bags(texts).join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("bag").alias("bag")))

    def with_bags(self, pairs: DataFrame, bags: DataFrame) -> DataFrame:
        """``pairs`` with ``bag_a, bag_b``; pairs of one ``a`` are dealt out by salts."""
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALTED).alias("salts")).where("salts > 1")
        many = self.keep(many).select(F.col("a").alias("hot"), "salts")
        salts = F.coalesce("salts", F.lit(1).cast("long"))
        bag_b = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
        bag_a = bags.join(many, F.col("node") == F.col("hot"), "left").select(
            F.col("node").alias("a"), F.col("bag").alias("bag_a"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        dealt = pairs.join(many, F.col("a") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("hot", "salts")
        return dealt.join(bag_b, "b").join(bag_a, ["a", "salt"]).drop("salt")

    def compare(self, pairs: DataFrame, bags: DataFrame) -> DataFrame:
        return self.keep(compared(self.with_bags(self.keep(pairs), bags), self.threshold))

    def components(self, edges: DataFrame) -> DataFrame:
        return components(edges, self.keep)

    def roots(self) -> DataFrame:
        """``node, root`` of all nodes that have a link."""
        members = self.members()
        bags = self.candidate_bags(members)
        led = self.keep(self.led(members))
        first = self.compare(led.select("a", F.col("node").alias("b")).distinct(), bags)
        # Members apart from their leader get another one, so that a second cluster in a bucket becomes one component.
        apart = first.where(~F.col("near")).select("a", F.col("b").alias("node"))
        again = self.led(led.join(apart, ["a", "node"], "left_semi").select("bucket", "node", "meets"))
        second = self.compare(ordered(again.select("a", F.col("node").alias("b"))), bags)
        links = first.unionByName(second).where("near").select("a", "b")
        components = self.components(links)
        pairs = self.possible(first.select("a", "b"), components, bags)
        if pairs is None:
            return components
        found = self.compare(pairs, bags).where("near").select("a", "b")
        if found.isEmpty():
            return components
        return self.components(found.unionByName(components.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def led(self, members: DataFrame) -> DataFrame:
        """``bucket, a, node, meets``: every other member of each bucket with its leader ``a``."""
        leaders = self.keep(members.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("s")).select("bucket", F.col("s.node").alias("a")))
        return members.join(leaders, "bucket").where("node <> a").select("bucket", "a", "node", "meets")

    def possible(self, led: DataFrame, components: DataFrame, bags: DataFrame) -> DataFrame | None:
        """Pairs of nodes in two components that one node leads and that can be links by their differences from it; None where no node
        leads members of two components."""
        root_a = components.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = components.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rows = led.join(root_b, "b", "left").join(root_a, "a", "left").withColumn("root", F.coalesce("rb", "b"))
        rows = self.keep(rows.select("a", "b", "root", (F.col("root") != F.coalesce("ra", "a")).alias("apart")))
        open_leaders = rows.groupBy("a").agg(F.max("apart").alias("any"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        open_leaders = self.keep(open_leaders.where("any and lo < hi").select("a"))
        if open_leaders.isEmpty():
            return None
        rows = self.keep(rows.join(open_leaders, "a", "left_semi"))
        return self.sharing(self.keep(spread(self.with_bags(rows, bags), self.threshold)))

    def sharing(self, rows: DataFrame) -> DataFrame:
        """The pairs of members, by ``spread``, that differ from their leader in enough that is common to both."""
        each = rows.select("a", "b", "root", "apart", F.explode("tokens").alias("token"))
        # Differences that members of two components have, one of them apart from the leader.
        shared = each.groupBy("a", "token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("apart").alias("any"))
        shared = self.keep(shared.where("any and lo < hi").select("a", "token", "df"))
        own = each.select("a", "b", "token").join(shared, ["a", "token"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
        own = own.withColumn("n", F.size("own").cast("long")).join(self.levelled(rows), ["a", "b"])
        return self.meeting(self.keep(placed(own)))

    def levelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` without tokens but with ``level``, by share and whether apart, and ``levels`` of their leader, each with its least share."""
        step = F.signum("share") * F.floor(2 * F.log2(1 + F.abs("share")))
        rows = rows.drop("tokens").withColumn("level", (F.when(F.col("apart"), APART).otherwise(0) + step).cast("int"))
        least = rows.groupBy("a", "level").agg(F.min("share").alias("low"))
        levels = self.keep(least.groupBy("a").agg(F.collect_list(F.struct("level", "low")).alias("levels")))  # the logarithm of a text's length
        return rows.join(levels, "a")

    def meeting(self, places: DataFrame) -> DataFrame:
        """Pairs of ``places`` of two components with enough differences in common after the one on which they meet.

        Of the members that meet on a difference most may be of one component; those do not meet each other."""
        spot = ["a", "token", "low", "high"]
        most = places.groupBy(*spot, "root").agg(F.count("*").alias("k"), F.count_if(F.col("level") == F.col("low")).alias("lows"), F.count_if(F.col("level") == F.col("high")).alias("highs"))
        most = most.groupBy(*spot).agg(F.max_by("root", "k").alias("main"), F.count("*").alias("roots"), F.sum("lows").alias("lows"), F.sum("highs").alias("highs"))
        most = self.keep(most.where("roots > 1 AND lows > 0 AND highs > 0").select(*spot, "main"))
        places = places.join(most, spot).withColumn("own", F.col("root") == F.col("main"))
        x = places.where("level = low").withColumn("with_own", F.explode(F.when(F.col("own"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).alias("x")
        y = places.where("level = high").alias("y")
        need = least_common(F.col("x.share"), F.col("y.share"))
        met = F.col("x.with_own") == F.col("y.own")
        for c in spot:
            met = met & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        met = met & (F.col("x.root") != F.col("y.root")) & (F.col("x.at") + need <= F.col("x.n")) & (F.col("y.at") + need <= F.col("y.n"))
        met = met & ((F.col("x.low") < F.col("x.high")) | (F.col("x.b") < F.col("y.b")))
        return ordered(x.join(y, met).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")))


def placed(own: DataFrame) -> DataFrame:
    """Where each member is looked at: on the first of its differences, for each level of a partner that it has enough of them for.

    own: a, b, root, apart, share, level, levels, n, own (differences, the rarest first)."""
    apart = lambda level: level >= APART // 2
    partners = F.filter("levels", lambda p: apart(F.col("level")) | apart(p["level"]))
    rows = own.withColumn("p", F.explode(partners)).withColumn("least", least_common(F.col("share"), F.col("p.low"))).where("n >= least")
    first = F.slice("own", 1, (F.col("n") - F.col("least") + 1).cast("int"))
    low, high = F.least("level", "p.level").alias("low"), F.greatest("level", "p.level").alias("high")
    return rows.select("a", "b", "root", "level", low, high, "n", "share", F.posexplode(F.transform(first, lambda t: t["token"])).alias("at", "token"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold=0.8) -> DataFrame:
    """One row per input row: ``id, class_id, class_size, kept, node, root``.

    ``class_size`` counts rows; ``node`` (of the words) and ``root`` (of the class) are null without words."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    graph = Graph(docs, workspace(docs.sparkSession, "near-dedup"), threshold)
    roots = graph.roots()
    nodes = graph.keep(graph.nodes.select("node", "id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # The class id is the smallest id, null ids last; of the nodes that have it the one with the smallest digest stays.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    classes = graph.keep(nodes.groupBy("root").agg(first.alias("s"), F.sum("n").alias("class_size")))
    classes = classes.select("root", F.col("s.id").alias("class_id"), F.col("s.node").alias("stays"), "class_size")
    of_node = graph.keep(nodes.join(classes, "root").select("node", "root", "class_id", "class_size", (F.col("node") == F.col("stays")).alias("stays")))
    copies = graph.signed.groupBy("id", "node").agg(F.count("*").alias("copies"))
    rows = copies.join(of_node, "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    alone = F.col("node").isNull()
    rows = rows.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | F.col("stays") & F.col("id").eqNullSafe(F.col("class_id")) & (F.col("copy") == 1)).alias("kept"), "node", "root",
    )
    result = stored(rows, workspace(docs.sparkSession, "near-classes"))
    remove(docs.sparkSession, graph.folder)
    return result


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", threshold=0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class and with all its columns: the smallest id, then the smallest text,
    then the smallest other columns. Rows without words all stay."""
    columns = docs.columns
    found = near_duplicates(docs, id_col, text_col, threshold)
    # An id of one row that stays, the usual case, needs no second look at its text, and its text need not move.
    ids = found.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"), F.max("kept").alias("__any"))
    ids = stored(ids.where("__n > 1 OR NOT __any"), workspace(docs.sparkSession, "near-ids"))
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    once = docs.join(few(ids.select("__id")), docs[id_col].eqNullSafe(F.col("__id")), "left_anti")
    rows = docs.join(few(ids.where("__n > 1 AND __any").select("__id")), docs[id_col].eqNullSafe(F.col("__id")))

    @F.pandas_udf("binary")
    def node_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: hash_of(folded(text)))

    many = rows.withColumn("__own", node_of(F.col(text_col)))
    wordless = many.where(F.col("__own").isNull()).select(columns)
    kept = found.where(F.col("kept") & F.col("node").isNotNull()).select(F.col("id").alias("__kid"), F.col("node").alias("__kept"))
    same = F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__own") == F.col("__kept"))
    rest = [F.col(c) for c in columns if c != text_col]
    one = many.join(kept, same, "left_semi").groupBy("__id", "__own").agg(F.min(F.struct(text_col, *rest)).alias("__s"))
    one = one.select(*[F.col("__s")[c].alias(c) for c in columns])
    return once.unionByName(wordless).unionByName(one)
