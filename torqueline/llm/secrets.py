"""Secret scan: fixed rules, and a character convolutional network over every candidate with its context.

Rules give the base spans of kinds ``assign``, ``access`` and ``hex``. Candidates are all runs of 16 or more token characters
that hold a letter and a digit, or small and capital letters as only keys mix them. The network reads the code points around
and in a candidate as classes, through one convolution, a maximum over positions and two dense layers. Candidates that reach
its threshold and that no base span overlaps are added as kind ``model``.

It is trained on the labelled findings of all texts, equal ones once:

- every candidate, a secret where a rule hits; those without a rule that look like keys have no label, as they can be the
  secrets to add; and as many ordinary places of the texts that hold candidates;
- each of those secrets once more with the keyword or prefix that the rule knows it by taken away;
- secrets of public token shapes and look-alikes (identifiers, paths, dates, numbers, words joined by signs), put between words
  of each text: one in every distinct text, more if the table has too few texts for ``made`` of both.

The findings are dealt by hash to groups of about ``GROUP``. In every epoch each group goes on from the same weights by steps of
stochastic gradient descent in numpy, and the weights of all groups are averaged, as whole numbers, so that the order of tasks does
not matter. A quarter of each class and all findings of some shapes are held back. They calibrate the network by temperature, and the
threshold is the largest logit, in steps of 1/``STEPS``, that keeps ``recall`` of the held-back secrets; all of them are counted.
``precision`` and ``found`` tell what it does there, ``learned`` and ``held`` how many findings there were.

A long candidate is read in windows that cover it whole; its score is the largest of them.

Defined cases: null text is empty; repeated rows each get the same row; without any text no span is added; an empty table
gives an empty result; other columns are ignored. Texts are read whole.
"""

import copy
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored, workspace

KINDS = ("assign", "access", "hex", "model")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    "(" + "|".join(map(either_case, KEYWORDS[:4])) + "|" + either_case("api") + "_?" + either_case("key") + ")"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs, as [0-9a-f]+ finds them, that are long enough

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: A capital after a small letter or the other way round, but for one capital before small letters.
TURN = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")

#: Places of a window: context before, candidate, context after.
BEFORE, INSIDE, AFTER = 20, 40, 12
WIDTH = BEFORE + INSIDE + AFTER
#: Classes of code points: 0 none, ASCII signs by themselves, letters outside ASCII as one.
CLASSES = 128 - 31 + 1
FILTERS, REACH, HIDDEN = 24, 5, 16
#: A run looks like a key from so many bits a sign, and so many changes between a-z, A-Z and 0-9 a sign.
KEY_BITS, KEY_CHANGES = 3.0, 0.25
#: Fewest labelled secrets that the network is trained on.
LEAST = 10
#: Findings of a group, which one task learns from at a time; most partitions that groups are written by.
GROUP, FILES = 8192, 2000
#: Steps of a logit that held-back findings are counted by.
STEPS = 1024
#: Weights are averaged as whole numbers of 1/FINE.
FINE = 1 << 32

SMALL, CAPITAL, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = SMALL + CAPITAL + DIGITS
#: Public shapes of tokens (prefix, characters, fewest, most) and what stands before them.
SHAPES = (
    ("ghp_", ALNUM, 36, 36), ("glpat-", ALNUM + "_-", 20, 20), ("xoxb-", DIGITS + ALNUM, 40, 50), ("sk_live_", ALNUM, 24, 32), ("AIza", ALNUM + "_-", 35, 35),
    ("npm_", ALNUM, 36, 36), ("", ALNUM + "+/", 40, 88), ("", ALNUM, 20, 64), ("eyJ", ALNUM + "_-", 30, 90), ("MII", ALNUM + "+/", 61, 61),
    ("", SMALL + CAPITAL, 24, 48), ("hf_", SMALL + CAPITAL, 34, 34), ("", CAPITAL + DIGITS, 26, 52),
)
LEADS = ("", "", "Bearer ", "key ", "use ", "is ", "login with ", ": ", "=", "\"", "-----BEGIN PRIVATE KEY-----\n")
#: Held back altogether.
APART = 3


def drawn(rng: np.random.Generator, signs: str, n: int) -> str:
    return "".join(signs[i] for i in rng.integers(0, len(signs), n))


def words_drawn(rng: np.random.Generator, n: int, joint: str = "", title: bool = False) -> str:
    """``n`` pronounceable words, joined."""
    words = ["".join(drawn(rng, "bcdfghklmnprstvw", 1) + drawn(rng, "aeiou", 1) for _ in range(rng.integers(1, 4))) + drawn(rng, "nrstl", 1) for _ in range(n)]
    return joint.join(w.title() if title else w for w in words)


def look_alike(rng: np.random.Generator, kind: int) -> str:
    """A run that is no secret: a name, a path, a date, a number or words joined by signs."""
    year, n = str(rng.integers(1990, 2030)), lambda k: drawn(rng, DIGITS, k)
    made = (
        lambda: words_drawn(rng, 4, "-") + "-" + year, lambda: words_drawn(rng, 4, "_") + "_v" + n(1), lambda: words_drawn(rng, 4, "", True) + n(2),
        lambda: words_drawn(rng, 1) + words_drawn(rng, 4, "", True), lambda: f"{year}-{n(2)}-{n(2)}T{n(2)}-{n(2)}-{n(2)}Z", lambda: "IMG_" + year + n(4) + "_" + n(6),
        lambda: words_drawn(rng, 4, "/") + "/" + n(3), lambda: words_drawn(rng, 1).upper() + "-" + year + "-" + n(8), lambda: "DE" + n(20),
        lambda: "-".join((drawn(rng, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12))), lambda: drawn(rng, "=-_", 1) * int(rng.integers(12, 40)) + words_drawn(rng, 1) + n(1),
        lambda: words_drawn(rng, 3, "+") + "=" + n(3), lambda: words_drawn(rng, 3, "_").upper() + "_" + n(3),
    )
    return made[kind % len(made)]()


ALIKE = 13


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules in code points, leftmost and not overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold a letter and a digit, or turn between small and capital letters more than once."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if LETTER.search(run) and (DIGIT.search(run) or len(TURN.findall(run)) > 1):
            found.append(m.span())
    return found


def looks_like_key(run: str) -> bool:
    """Whether a run is as mixed as a random key; words, numbers and dates joined by signs are not."""
    signs = [c for c in run if c.isalnum()]
    shares = np.array(list(Counter(signs).values())) / len(signs)
    kinds = [c.isdigit() + 2 * c.isupper() for c in signs]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return bool(-(shares * np.log2(shares)).sum() >= KEY_BITS and changes >= KEY_CHANGES * len(signs))


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of a window of the candidate from ``start`` on, with what stands around it."""
    inside = text[start : min(end, start + INSIDE)]
    part = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points == 0, 0, np.where(points < 128, np.maximum(points, 31) - 30, CLASSES)).astype(np.int64)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    return [window(text, at, end) for at in range(start, end, INSIDE)]


@dataclass
class Network:
    """Weights; every class has one column of the convolution at each of ``REACH`` places."""

    conv: np.ndarray  # (REACH, CLASSES + 1, FILTERS)
    conv_bias: np.ndarray
    dense: np.ndarray  # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: float
    temperature: float = 1.0
    threshold: float = 2.0  # none
    precision: float = float("nan")  # of the held-back labels at the threshold
    found: float = float("nan")  # share of the held-back secrets at the threshold
    learned: int = 0
    held: int = 0

    @staticmethod
    def fresh(rng: np.random.Generator) -> "Network":
        return Network(
            rng.normal(0, 0.2, (REACH, CLASSES + 1, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, (FILTERS, HIDDEN)),
            np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0,
        )

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        places = x.shape[1] - REACH + 1
        maps = self.conv_bias + sum(self.conv[k][x[:, k : k + places]] for k in range(REACH))
        best = maps.argmax(1)
        pooled = np.take_along_axis(maps, best[:, None], 1)[:, 0]
        active = np.maximum(pooled, 0)
        hidden = np.maximum(active @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias, (best, pooled, active, hidden)

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        return 1 / (1 + np.exp(-np.concatenate(parts) / self.temperature))

    def learn(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of stochastic gradient descent on the logistic loss."""
        z, (best, pooled, active, hidden) = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(x)
        dh = np.outer(dz, self.out) * (hidden > 0)
        da = (dh @ self.dense.T) * (pooled > 0)
        self.out = self.out - rate * hidden.T @ dz
        self.out_bias -= rate * dz.sum()
        self.dense = self.dense - rate * active.T @ dh
        self.dense_bias = self.dense_bias - rate * dh.sum(0)
        self.conv_bias = self.conv_bias - rate * da.sum(0)
        filters = np.arange(FILTERS)[None, :]
        for k in range(REACH):
            np.subtract.at(self.conv[k], (np.take_along_axis(x, best + k, 1), filters), rate * da)


    def whole(self) -> np.ndarray:
        """All weights as whole numbers."""
        return np.rint(np.concatenate([np.ravel(getattr(self, k)) for k in WEIGHTS]) * FINE).astype(np.int64)

    def take(self, weights: np.ndarray) -> None:
        for k in WEIGHTS:
            own = np.asarray(getattr(self, k))
            part, weights = weights[: own.size].reshape(own.shape), weights[own.size :]
            setattr(self, k, part.copy() if own.ndim else float(part))


WEIGHTS = ("conv", "conv_bias", "dense", "dense_bias", "out", "out_bias")


def overlapping(spans: list[tuple], start: int, end: int) -> tuple | None:
    """The first of ``spans``, which are in order and do not overlap each other, that has a place in common with start to end."""
    at = bisect_right(spans, start, key=lambda s: s[1])
    return spans[at] if at < len(spans) and spans[at][0] < end else None


def labelled(texts: list[str], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, float, bool]]:
    """(window, label, held back) of candidates, 1 where a rule finds a secret, and of as many ordinary places.

    Nothing at a candidate that looks like a key without a rule is labelled."""
    for text in texts:
        base = base_spans(text)
        own = candidates(text)
        by_kind = [[b for b in base if b[2] == k] for k in KINDS[:3]]
        unknown = []
        for start, end in own:
            rule = next(filter(None, (overlapping(spans, start, end) for spans in by_kind)), None)
            if rule is None and looks_like_key(text[start:end]):
                unknown.append((start, end))
                continue
            yield window(text, start, end), float(rule is not None), False
            value = rule and rule[2] == "assign" and ASSIGN.match(text, rule[0])
            if value and value.end(2) - value.start(2) >= 16:  # the value once more, without its keyword
                before = text[max(0, rule[0] - BEFORE) : rule[0]] + words_drawn(rng, 1) + " "
                yield window(before + text[value.start(2) : value.end(2) + AFTER], len(before), len(before) + len(value[2])), 1.0, False
        for _ in range(max(1, len(own))):
            start = int(rng.integers(0, max(1, len(text))))
            end = start + int(rng.integers(16, 48))
            if text and not any(overlapping(spans, start, end) for spans in (*by_kind, unknown)):
                yield window(text, start, min(end, len(text))), 0.0, False


def planted(contexts: list[str], numbers: Iterable[int], rng: np.random.Generator) -> list[tuple[np.ndarray, float, bool]]:
    """(window, label, held back) of a secret of a public shape for each odd number and a look-alike for each even one, put between
    words of ``contexts``."""
    rows = []
    for i in numbers:
        text, kind = contexts[int(rng.integers(len(contexts)))], i // 2
        at = text.find(" ", int(rng.integers(0, len(text) + 1))) + 1
        if i % 2:
            prefix, signs, least, most = SHAPES[kind % len(SHAPES)]
            run, apart = prefix + drawn(rng, signs, int(rng.integers(least, most + 1))), kind % len(SHAPES) >= len(SHAPES) - APART
        else:
            run, apart = look_alike(rng, kind), kind % ALIKE >= ALIKE - APART
        lead = LEADS[int(rng.integers(len(LEADS)))] if i % 2 else ("", "", "https://www.", "see ", "file ")[int(rng.integers(5))]
        before = text[max(0, at - BEFORE) : at] + lead
        rows.append((window(before + run + " " + text[at : at + AFTER], len(before), len(before) + len(run)), float(i % 2), apart))
    return rows


def chosen(rows: DataFrame, n: int) -> list[str]:
    """``n`` of the distinct texts of ``rows`` (all, if they are fewer), those with the smallest hashes."""
    hashed = rows.select("text", F.xxhash64("text").alias("h"))
    total = hashed.select("h").distinct().count()
    # Twice the share that is wanted is read and sorted, not n rows of every task.
    below = -(1 << 63) + min((1 << 64) - 1, 2 * (n + 50) * (1 << 64) // max(total, 1))
    return [r[0] for r in hashed.where(F.col("h") <= below).select("text", "h").distinct().orderBy("h", "text").limit(n).select("text").collect()]


FINDING = "seen binary, label int, apart boolean"


def batch_of(found: Iterable[tuple[np.ndarray, float, bool]]) -> pa.RecordBatch:
    seen, label, apart = zip(*((x.astype(np.uint8).tobytes(), int(y), bool(a)) for x, y, a in found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(label, pa.int32()), pa.array(apart, pa.bool_())], ["seen", "label", "apart"])


def findings(rows: DataFrame, made: int, seed: int) -> DataFrame:
    """The labelled findings of every text of ``rows``, each once: the classes of its window as bytes, label, held back."""
    each = -(-2 * made // max(1, rows.select(F.xxhash64("text")).distinct().count()))  # to plant in a text, so that there are ``made`` of both

    def of_texts(texts: pa.Array) -> Iterator[tuple[np.ndarray, float, bool]]:
        for x in texts:
            text = x.as_py()
            rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "replace"))])  # copies have the same findings
            if candidates(text):
                yield from labelled([text], rng)
            first = int(rng.integers(2 * len(SHAPES) * ALIKE))
            yield from planted([text], range(first, first + each), rng)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(batch_of, batched(of_texts(batch.column("text")), 10_000))

    return rows.mapInArrow(run, FINDING).distinct()


def grouped(found: DataFrame, groups: int, seed: int) -> DataFrame:
    """One row per group: its findings in one order, whatever the order of ``found``, and which of them are held back."""

    def pack(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seen", "label", "apart")), strict=True))
        y, held = np.array([r[1] for r in rows], np.uint8), np.array([r[2] for r in rows])
        order = np.random.default_rng([seed, part]).permutation(np.flatnonzero(~held))
        for label in (0, 1):
            own = order[y[order] == label]
            held[own[: (len(own) + part % 4) // 4]] = True  # a quarter of each, over the groups even of rare ones
        return pa.table({
            "part": pa.array([part], pa.int32()), "seen": pa.array([b"".join(r[0] for r in rows)], pa.binary()),
            "labels": pa.array([y.tobytes()], pa.binary()), "held": pa.array([held.tobytes()], pa.binary()),
        })

    dealt = found.withColumn("part", F.pmod(F.xxhash64("seen", "label"), F.lit(groups)).cast("int")).repartition(min(groups, FILES), "part")
    return dealt.groupBy("part").applyInArrow(pack, "part int, seen binary, labels binary, held binary")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part, seen, labels, held in zip(*batch.columns, strict=True):
            x = np.frombuffer(seen.as_py(), np.uint8).reshape(-1, WIDTH).astype(np.int64)
            yield part.as_py(), x, np.frombuffer(labels.as_py(), np.uint8).astype(float), np.frombuffer(held.as_py(), bool)


def averaged(groups: DataFrame, net: Network, rates: list[tuple[int, float]], seed: int) -> np.ndarray:
    """Mean weights after each group has gone through ``rates`` (epoch, rate) from ``net`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part, x, y, held in groups_of(batches):
            own = copy.deepcopy(net)
            for epoch, rate in rates:
                order = np.random.default_rng([seed, part, epoch]).permutation(np.flatnonzero(~held))
                for at in range(0, len(order), 32):
                    batch = order[at : at + 32]
                    own.learn(x[batch], y[batch], rate)
            weights = np.append(own.whole(), 1)
            total = weights if total is None else total + weights
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["weights"])

    total = groups.mapInArrow(run, "weights binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)
    return total[:-1] / (total[-1] * float(FINE))


def held_back(groups: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all held-back findings: logits in whole steps, rising, and how many findings of label 0 and 1 have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y, held in groups_of(batches):
            x, y = x[held], y[held]
            z = np.concatenate([np.zeros(0), *(net.forward(x[i : i + 64])[0] for i in range(0, len(x), 64))])
            step, at = np.unique(np.floor(z * STEPS).astype(np.int64), return_inverse=True)
            n = [pa.array(np.bincount(at[y == label], minlength=len(step)).astype(np.int64)) for label in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(step), *n], ["step", "plain", "secret"])

    counted = groups.mapInArrow(run, "step long, plain long, secret long").groupBy("step").agg(F.sum("plain"), F.sum("secret"))
    rows = sorted(map(tuple, counted.collect()))  # as many as the logits have steps
    return tuple(np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def train(docs: DataFrame, text_col="text", sample: int | None = None, contexts=400, made=2600, epochs=12, rate=0.5, recall=0.99, seed=11) -> Network:
    """Fits the network on the labelled findings of all texts of ``docs``, with ``made`` planted secrets and look-alikes at least;
    without any text it adds nothing.

    A caller who asks for a ``sample`` gets one: findings of so many candidate-bearing and ``contexts`` other excerpts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    folder = workspace(spark, "secrets")
    net = Network.fresh(np.random.default_rng(seed))
    found = stored(findings(rows, made, seed) if sample is None else sampled(rows, sample, contexts, made, seed), f"{folder}/found")
    n, n_secrets = found.agg(F.count("*"), F.sum("label")).first()
    if (n_secrets or 0) >= LEAST:
        groups = stored(grouped(found, -(-n // GROUP), seed), f"{folder}/groups")
        rates = [(epoch, rate * (1 - epoch / epochs)) for epoch in range(epochs)]
        for part in [rates] if n <= GROUP else [[r] for r in rates]:  # one group alone has nothing to be averaged with
            net.take(averaged(groups, net, part, seed))
        calibrate(net, *held_back(groups, net), recall)
        net.learned = n - net.held
    remove(spark, folder)
    return net


def calibrate(net: Network, step: np.ndarray, plain: np.ndarray, secret: np.ndarray, recall: float) -> None:
    """Sets temperature, threshold and what it does from the counts of :func:`held_back`."""
    net.held = int(plain.sum() + secret.sum())
    if not secret.any():
        return
    z = (step + 0.5) / STEPS
    loss = {t: (plain * np.logaddexp(0, z / t) + secret * np.logaddexp(0, -z / t)).sum() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)}
    net.temperature = min(loss, key=lambda t: (loss[t], t))
    at = int(np.searchsorted(np.cumsum(secret), int((1 - recall) * secret.sum()), "right"))  # the step of the last secret that must be found
    net.threshold = float(1 / (1 + np.exp(-step[at] / STEPS / net.temperature)))
    net.precision, net.found = float(secret[at:].sum() / (plain[at:].sum() + secret[at:].sum())), float(secret[at:].sum() / secret.sum())


def sampled(rows: DataFrame, sample: int, contexts: int, made: int, seed: int) -> DataFrame:
    """Findings of ``sample`` distinct excerpts around candidates and of ``made`` secrets and look-alikes put into ``contexts`` excerpts."""
    texts = chosen(rows.mapInArrow(around_candidates, "text string"), sample)
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - 300, F.lit(1)))
    around = chosen(rows.select(F.substr("text", (place + 1).cast("int"), F.lit(300)).alias("text")), contexts)
    rng = np.random.default_rng(seed)
    found = [*labelled(texts, rng), *(planted(around, range(2 * made), rng) if around else [])]
    own = [(x.astype(np.uint8).tobytes(), int(y), bool(apart)) for x, y, apart in found]
    return rows.sparkSession.createDataFrame(own, FINDING).distinct()


def around_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate with 200 code points on either side."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            out += [text[max(0, s - 200) : min(e, s + 400) + 200] for s, e in candidates(text)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])


def scan_text(text: str, net: Network) -> list[tuple[int, int, str]]:
    spans = base_spans(text)
    own = [c for c in candidates(text) if not any(s < c[1] and c[0] < e for s, e, _ in spans)]
    if own and net.threshold <= 1:
        for start, end in own:
            if net.score(np.array(windows(text, start, end))).max() >= net.threshold:
                spans.append((start, end, "model"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, net: Network, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: ``id, spans`` with (kind, start, end) by start, then kind as in :data:`KINDS`."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scan_text(x.as_py() or "", net)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, span)], ["id", "spans"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
