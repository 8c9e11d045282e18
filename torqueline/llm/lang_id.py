"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (1 to 4 code points of the lower-cased words, with
word borders), then a linear layer and a softmax. Embeddings and layer are trained in numpy by stochastic gradient descent
on a bounded sample of labelled rows; a held-back part of that sample sets the temperature of the softmax and the score
below which a text counts as rejected, so that ``keep`` of the held-back texts stay.

Because averaging and the linear layer commute, prediction with up to ``dim`` labels looks up one row of class scores per
n-gram, with more labels one embedding; it reads every text from end to end.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and rejected; rows without a label are never
learned from, every label is, however rare; with no labelled row at all every text is ``und``; equal texts of a label are one
example; ties between classes go to the smallest label; an empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, stored, workspace

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Places of a text whose n-grams are scored together, so that long texts need little memory.
PIECE = 1 << 18


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    scores: np.ndarray  # (BUCKETS, labels): embeddings times the linear layer; the embeddings alone if there are more labels than places
    layer: np.ndarray | None  # the linear layer in that case
    bias: np.ndarray
    temperature: float
    threshold: float


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def letters_table() -> np.ndarray:
    """For code points of the basic plane: whether it is a letter or a mark, which words are made of."""
    return np.array([chr(c).isalpha() for c in range(0x10000)], bool)


_LETTERS: list[np.ndarray] = []


def signs_of(points: np.ndarray) -> np.ndarray:
    """The letters of a text and, as one border sign each, what stands between, before and after them."""
    if not _LETTERS:
        _LETTERS.append(letters_table())
    letter = np.where(points < 0x10000, _LETTERS[0][np.minimum(points, 0xFFFF)], True)
    signs = np.where(letter, points, 0)
    signs = signs[(signs != 0) | np.concatenate(([True], signs[:-1] != 0))] if len(signs) else signs
    return np.concatenate(([0], signs, [0])).astype(np.uint32)


def ngram_buckets(signs: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Bucket of each n-gram that begins at one of the first ``starts`` signs."""
    out, h = [], np.zeros(len(signs), np.uint32)
    for k in range(max(ORDERS)):
        if len(signs) <= k:
            break
        h = h[: len(signs) - k] * np.uint32(0x01000193) + (signs[k:] + np.uint32(k)) * np.uint32(0x9E3779B1)
        if k + 1 in ORDERS:
            own = h[:starts]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(17)).astype(np.int32))
    return np.concatenate(out)


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a text, so many places at a time; those across two pieces are in the first."""
    signs = signs_of(points)
    for at in range(0, len(signs), PIECE):
        yield ngram_buckets(signs[at : at + PIECE + max(ORDERS) - 1], PIECE)


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for part in pieces(points_of(text)):
        total += np.bincount(part, minlength=BUCKETS)
    index = np.flatnonzero(total)
    return index.astype(np.int32), (total[index] / total.sum()).astype(np.float32)


def training_rows(labelled: DataFrame, text_col: str, label_col: str, sample: int) -> list:
    """``sample`` distinct texts at most (one of each label at least), the same number for each label and chosen by a hash of
    the text, as sparse n-gram averages.

    Besides each whole text one run of eight words at a hashed place is learned, since short texts occur too."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    keyed = rows.where(F.col("label").isNotNull() & has_letter(F.col("text"))).withColumn("h", F.xxhash64("text"))
    # Copies of a text count once, else they would fill the sample and stand in its held-back part too. Hashes alone are
    # shuffled, and of each task only the smallest of a label; texts are fetched for the chosen ones only.
    folder = workspace(labelled.sparkSession, "lang-id")
    hashes = stored(keyed.select("label", "h").distinct(), folder)
    n_labels = hashes.select("label").distinct().count()
    if not n_labels:
        return []
    first = Window.partitionBy("label").orderBy("h")
    picked = hashes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(1, sample // n_labels)).select("label", "h")
    chosen = keyed.join(F.broadcast(picked), ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text"))  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, label = [], [], []
            for text, own, h in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "h")), strict=True):
                words = text.split()
                at = h % max(1, len(words) - 8)
                for part in (text, " ".join(words[at : at + 8])):
                    if any(c.isalpha() for c in part):
                        i, v = histogram(part)
                        index.append(i)
                        value.append(v)
                        label.append(own)
            yield pa.RecordBatch.from_pydict({
                "index": pa.array(index, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.float32())), "label": pa.array(label, pa.string()),
            })

    rows = chosen.mapInArrow(run, "index array<int>, value array<float>, label string").collect()
    remove(labelled.sparkSession, folder)
    return rows


def train(labelled: DataFrame, text_col="text", label_col="lang", sample=1200, dim=16, epochs=6, rate=0.5, keep=0.999, seed=7) -> Model | None:
    """Fits the model on at most ``sample`` labelled rows of ``labelled``, one of each label at least (a documented bound); None without any."""
    rows = training_rows(labelled, text_col, label_col, sample)
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], r["index"], r["value"]))
    rng = np.random.default_rng(seed)
    labels = tuple(sorted({r["label"] for r in rows}))
    y = np.array([labels.index(r["label"]) for r in rows])
    order = rng.permutation(len(rows))
    held, learned = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)

    def packed(batch):
        index = np.concatenate([np.asarray(rows[i]["index"], np.int32) for i in batch])
        value = np.concatenate([np.asarray(rows[i]["value"], np.float32) for i in batch])
        starts = np.cumsum([0] + [len(rows[i]["index"]) for i in batch])[:-1]
        return index, value, starts

    def mean(index, value, starts):
        return np.add.reduceat(embed[index] * value[:, None], starts)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        learned = rng.permutation(learned)
        for at in range(0, len(learned), 16):
            batch = learned[at : at + 16]
            index, value, starts = packed(batch)
            x = mean(index, value, starts)
            grad = softmax(x @ layer + bias)
            grad[np.arange(len(batch)), y[batch]] -= 1
            back = grad @ layer.T
            sizes = np.diff(np.append(starts, len(index)))
            layer -= step * (x.T @ grad) / len(batch)
            bias -= step * grad.sum(0) / len(batch)
            # Rows of rare n-grams get small gradients, hence the large factor on embeddings.
            np.subtract.at(embed, index, (20 * step / len(batch)) * np.repeat(back, sizes, 0) * value[:, None])
    check = held if len(held) else learned
    logits = mean(*packed(check)) @ layer + bias
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(losses, key=lambda t: (losses[t], t))
    top = softmax(logits / temperature).max(1)
    # Never above an even chance: a text that one label explains better than all others together stays.
    threshold = float(min(0.5, np.quantile(top, 1 - keep)))
    product = len(labels) <= dim
    return Model(labels, (embed @ layer).astype(np.float32) if product else embed, None if product else layer, bias, temperature, threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_text(model: Model, text: str) -> tuple[str, float]:
    total, n = np.zeros(model.scores.shape[1]), 0
    for buckets in pieces(points_of(text)):
        n += len(buckets)
        if len(buckets) > 4 * BUCKETS:
            total += np.bincount(buckets, minlength=BUCKETS).astype(np.float32) @ model.scores
        else:
            total += np.take(model.scores, buckets, axis=0).sum(0, dtype=np.float64)
    mean = total / max(n, 1)
    p = softmax((((mean if model.layer is None else mean @ model.layer) + model.bias) / model.temperature)[None])[0]
    best = int(p.argmax())
    return model.labels[best], float(p[best])


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: ``id, lang_pred, score, rejected``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return predicted(docs, model, "text").select("id", "lang_pred", "score", "rejected")


def predicted(docs: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` added (and replaced, where they exist)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of at most ``dim`` numbers

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        found = []
        for text in texts:
            letters = model is not None and text is not None and any(map(str.isalpha, text))
            found.append(score_text(model, text) if letters else (UNKNOWN, 0.0))
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    threshold = model.threshold if model else 0.0
    out = docs.withColumn("__lang", predict(F.col(text_col)))
    out = out.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < threshold))
