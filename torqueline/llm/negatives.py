"""Hard negatives by branch and bound over columns (BOND).

Vectors become whole numbers, and a score is an inner product with an anchor. Rows are cut into blocks that are stored by column.
For an anchor the columns of a block are read in falling order of the anchor's magnitude there. After each few columns a row's
score is known within bounds: what it has so far, and the least and most that the columns to come can add, from the block's
smallest and largest entry of each. A bitmap of candidates loses the rows that can no longer matter, and later columns are read
for what is left alone.

Two scans: the first finds the positives of an anchor, the best rows of its own label, and drops rows that end below as many
others as are wanted. The second finds rows of other labels inside the window below each positive's score, and drops rows that end
outside all windows or below as many rows that are certain to lie in each window they may still enter.

Anchors and rows meet in a grid of anchor chunks and row blocks, each pair a group of its own; a pair returns at most ``positives``
rows, or ``negatives`` rows a window, for each anchor, and a second step keeps the best of all blocks. Nothing is broadcast.

Defined cases: rows with a null label or a vector that is null, empty or holds null or non-finite entries take no part; rows are compared
with anchors of the same length alone; scores are exact, also beyond 2^53, and one that long cannot hold raises OverflowError; a row with a
null id is no anchor and comes last among equal scores; repeated rows are rows of their own, each a positive or negative, and an
anchor that occurs twice is two anchors, whose results are both returned; ties of score and id are settled by place, which shows in no
column; an empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, remove, stored, workspace

#: Anchors of a chunk; a row is copied once for each chunk.
CHUNK = 4096
#: Rows of a block: a 24th of the table within these bounds; an anchor is copied once for each block.
LEAST_BLOCK, BLOCK = 2048, 65_536
#: Columns read between two looks at the bitmap.
STEP = 8


class Block:
    """Rows of one block by column, with the smallest and largest entry of each column."""

    def __init__(self, x: np.ndarray) -> None:
        self.whole = np.ascontiguousarray(x.T)
        self.columns = self.whole.astype(np.float64)
        self.low, self.high = self.whole.min(1), self.whole.max(1)
        self.reach = len(self.whole) * float(np.abs(self.columns).max())

    def scan(self, anchor: np.ndarray, rows: np.ndarray, floor) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``rows`` that ``floor`` leaves, and their scores. ``floor`` maps lower and upper bounds to the kept places.

        Doubles hold every sum exactly up to 2^53; beyond that Python's whole numbers do."""
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        small = self.reach * float(np.abs(anchor.astype(np.float64)).max()) < 2**52
        number, columns = (np.float64, self.columns) if small else (object, self.whole.astype(object))
        a = anchor[order].astype(number)
        ends = (a * self.low[order].astype(number), a * self.high[order].astype(number))
        least, most = (np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        score = np.zeros(len(rows), number)
        for at in range(0, len(order), STEP):
            if not len(rows):
                break
            dims = order[at : at + STEP]
            read = columns[dims] if len(rows) == columns.shape[1] else columns[np.ix_(dims, rows)]
            score = score + a[at : at + STEP] @ read
            end = min(at + STEP, len(order))
            keep = floor(score + least[end], score + most[end]).astype(bool)
            if not keep.all():
                rows, score = rows[keep], score[keep]
        return rows, score


def largest(values: np.ndarray, k: int):
    """The k-th largest value, or None with fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def best_of(rows: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> list[int]:
    """Places in ``rows`` of the best k by falling score, then by ``place``."""
    t = largest(score, k)
    few = np.arange(len(rows)) if t is None else np.flatnonzero(score >= t)
    return sorted(few.tolist(), key=lambda i: (-score[i], place[rows[i]]))[:k]


def positives_in(block: Block, anchor: np.ndarray, rows: np.ndarray, place: np.ndarray, k: int) -> list[tuple[int, int]]:
    def floor(low, high):
        t = largest(low, k)
        return np.ones(len(low), bool) if t is None else high >= t

    rows, score = block.scan(anchor, rows, floor)
    return [(int(rows[i]), int(score[i])) for i in best_of(rows, score, place, k)]


def negatives_in(block: Block, anchor: np.ndarray, rows: np.ndarray, place: np.ndarray, scores: list[int], k: int, ratio: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(window, row, score) of the best k rows of each window; scores, the windows' upper ends, are rising."""
    part, base = ratio  # windows overlap and rise with their upper ends

    def floor(low, high):
        keep = (base * high >= part * scores[0]) & (low <= scores[-1])
        if len(low) and base * (high[0] - low[0]) > (base - part) * scores[-1]:
            return keep  # bounds as wide as the widest window: no row is certain to lie in one
        keep[:] = False
        for top in scores:
            can = (base * high >= part * top) & (low <= top)
            t = largest(low[can & (base * low >= part * top) & (high <= top)], k)
            keep |= can if t is None else can & (high >= t)
        return keep

    rows, score = block.scan(anchor, rows, floor)
    out = []
    for w, top in enumerate(scores):
        at = np.flatnonzero((base * score >= part * top) & (score <= top))
        out += [(w, int(rows[at[i]]), int(score[at[i]])) for i in best_of(rows[at], score[at], place, k)]
    return out


def mine(rows: DataFrame, id_col="vec_id", vector_col="embedding", label: Column | str = "label", anchors: Column | None = None, scale=256, positives=5, negatives=5, ratio=(80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``label`` and ``anchors`` are expressions over ``rows``; rows for which ``anchors`` holds are anchors, all by default. A negative n of a
    positive p has ``ratio[0] * p <= ratio[1] * n <= ratio[1] * p``."""
    spark = rows.sparkSession
    folder, tables = workspace(spark, "negatives"), iter(range(10**9))
    keep = lambda df: stored(df, f"{folder}/{next(tables)}")
    asked = (F.lit(True) if anchors is None else F.coalesce(anchors, F.lit(False))) & F.col(id_col).isNotNull()
    vector = F.col(vector_col).cast("array<double>")
    picked = rows.select(F.col(id_col).alias("id"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label"), asked.alias("anchor"), vector.alias("c"))
    bad = F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    picked = picked.where(F.col("label").isNotNull() & F.col("c").isNotNull() & ~bad & (F.size("c") > 0))
    # Stored, so that the number of a row is the same in every later plan.
    numbers = keep(picked.select("id", "label", "anchor", F.transform("c", lambda v: F.floor(v * scale)).alias("x"), F.monotonically_increasing_id().alias("row")))
    n, n_anchors = numbers.agg(F.count("*"), F.count_if("anchor")).first()
    block = max(LEAST_BLOCK, min(BLOCK, -(-n // 24)))
    side = lambda df, size, name: df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(-(-max(1, size[0]) // size[1]))).cast("int"))
    all_rows = side(numbers.select("id", "label", "row", "x", F.size("x").alias("dim")), (n, block), "block")
    all_anchors = side(numbers.where("anchor").select("label", "row", "x", F.size("x").alias("dim")), (n_anchors, CHUNK), "chunk")
    chunks, blocks = -(-max(1, n_anchors) // CHUNK), -(-max(1, n) // block)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = all_rows.withColumn("chunk", each(chunks)).groupBy("dim", "block", "chunk")

    first = all_anchors.withColumn("block", each(blocks)).groupBy("dim", "block", "chunk").cogroup(right).applyInArrow(
        lambda a, b: found_positives(a, b, positives), "anchor long, id long, row long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    near = keep(first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))

    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("scores"))  # ``positives`` scores at most
    asking = keep(all_anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor"))
    second = asking.withColumn("block", each(blocks)).groupBy("dim", "block", "chunk").cogroup(right).applyInArrow(
        lambda a, b: found_negatives(a, b, negatives, ratio), "anchor long, top long, id long, row long, score long")
    best = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    far = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    far = far.select(F.col("anchor").alias("of"), "top", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.join(far, (F.col("anchor") == F.col("of")) & (F.col("score") == F.col("top")))
    ids = numbers.where("anchor").select(F.col("id").alias("anchor_id"), F.col("row").alias("a"))
    found = pairs.join(ids, F.col("anchor") == F.col("a")).select("anchor_id", F.col("id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
    result = stored(found, workspace(spark, "hard-negatives"))
    remove(spark, folder)
    return result


def opened(a: pa.Table, b: pa.Table) -> Iterator:
    """What both scans need: (number, label, vector) of each anchor, the block, labels and row numbers, and the order of ids."""
    matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    labels, ids, rows = np.array(b["label"].to_pylist(), object), b["id"], b["row"].to_numpy()
    null = ids.is_null().to_numpy().astype(bool)
    values = ids.fill_null(0).to_numpy()
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((rows, values, null))] = np.arange(len(rows))
    return zip(a["row"].to_pylist(), a["label"].to_pylist(), matrix(a), strict=True), Block(matrix(b)), labels, rows, ids, place


def found_positives(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    out: list[tuple] = []
    if len(a) and len(b):
        anchors, block, labels, rows, ids, place = opened(a, b)
        of_label = {x: np.flatnonzero(labels == x) for x in set(labels)}
        for row, label, x in anchors:
            own = of_label.get(label, np.zeros(0, int))
            out += [(row, ids[i].as_py(), int(rows[i]), s) for i, s in positives_in(block, x, own[rows[own] != row], place, k)]
    return as_table(out, ["anchor", "id", "row", "score"])


def found_negatives(a: pa.Table, b: pa.Table, k: int, ratio: tuple[int, int]) -> pa.Table:
    out: list[tuple] = []
    if len(a) and len(b):
        scores = a["scores"].to_pylist()
        anchors, block, labels, rows, ids, place = opened(a, b)
        others = {x: np.flatnonzero(labels != x) for x in {*labels, *a["label"].to_pylist()}}
        for (row, label, x), tops in zip(anchors, scores, strict=True):
            tops = [t for t in tops if t >= 0]  # a window below a negative score is empty
            if tops:
                out += [(row, tops[w], ids[i].as_py(), int(rows[i]), s) for w, i, s in negatives_in(block, x, others[label], place, tops, k, ratio)]
    give_back()
    return as_table(out, ["anchor", "top", "id", "row", "score"])


def as_table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)
