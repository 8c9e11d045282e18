"""K1 with an index: exact nearest rows by cosine, reading only the cells of the corpus that can hold one.

Centres are fitted on a bounded sample; every row belongs to the cell of its nearest centre, and a cell knows the largest angle of
its rows to the centre. By the triangle inequality a row of a cell is at least as far from a query as the centre is, less that angle. A query
first reads the cells nearest to it until they hold ``k`` rows, which bounds what can still be among its best, and then the
other cells that are not too far for that bound. What is left out cannot be in the result, so the rows are those of ``retrieval.knn``.
On vectors without clusters in many dimensions nothing can be left out; the index then costs a little more than reading all."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import nearest

SAMPLE, CENTRES, ROUNDS = 4096, 1024, 6
#: Rows of a block of a cell and queries of a chunk.
BLOCK = 2048
#: Angles and rounded relevances that differ by less are not told apart.
CLOSE = 1e-6


def unit_rows(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    m = np.array(vectors.to_pylist(), float)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def centres_of(rows: DataFrame, n: int) -> np.ndarray:
    """Centres of unit vectors, the square root of the rows in number, by rounds of assignment over a sample of ``SAMPLE`` rows."""
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    u = unit_rows(sample)
    u = u[(u != 0).any(1)]
    if not len(u):
        return np.zeros((0, 0))
    chosen, closest = [0], u @ u[0]
    while len(chosen) < min(CENTRES, math.isqrt(n) + 1, len(u)):  # the farthest from all before
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, u @ u[chosen[-1]])
    centres = u[chosen]
    for _ in range(ROUNDS):
        of = (u @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, u)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``cell`` and ``angle``; zero vectors, which are equally far from all, are in cell -1 with the angle of a half turn."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit_rows(batch.column("vec")) if len(batch) else np.zeros((0, shared.value.shape[1]))
            some = (u != 0).any(1)
            cosine = u @ shared.value.T
            cell = np.where(some, cosine.argmax(1), -1)
            angle = np.where(some, np.arccos(np.clip(cosine.max(1), -1, 1)), math.pi)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vec", "cell", "angle"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, cell int, angle double")


def bounds(queries: DataFrame, centres: np.ndarray, cells: dict[int, tuple[int, float]], k: int) -> DataFrame:
    """``id, vec, first, rest, highest``: the cells that a query reads first, the others, and the largest cosine that a row of each of those can have."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, sorted(cells), cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, names, known = shared.value
        radius, sizes = np.array([known[c][1] for c in names]), np.array([known[c][0] for c in names])
        for batch in batches:
            u = unit_rows(batch.column("vec")) if len(batch) else np.zeros((0, middle.shape[1]))
            first, rest, highest = [], [], []
            for q in u:
                angle = np.array([np.arccos(np.clip(q @ middle[c], -1, 1)) if c >= 0 else 0.0 for c in names])
                order = np.argsort(angle - 2 * (np.array(names) < 0), kind="stable") if not q.any() else np.argsort(angle + 9 * (np.array(names) < 0), kind="stable")
                upto = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                first.append([names[i] for i in order[:upto]])
                rest.append([names[i] for i in order[upto:]])
                highest.append(np.cos(np.maximum(0, angle - radius - CLOSE))[order[upto:]] if q.any() else np.zeros(len(names) - min(upto, len(names))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(first, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.int32())), pa.array(highest, pa.list_(pa.float64()))], ["id", "vec", "first", "rest", "highest"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, first array<int>, rest array<int>, highest array<double>")


def read_cells(asked: DataFrame, rows: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``query, doc, relevance`` of the best ``k`` rows of each block of the cells that a query asks for. asked: id, vec, cell."""
    sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("chunks")).join(cells.select("cell", "blocks"), "cell")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = asked.join(sizes, "cell").withColumn("chunk", deal("id", F.col("chunks"))).withColumn("block", each("blocks"))
    right = rows.join(sizes, "cell").withColumn("block", deal("id", F.col("blocks"))).withColumn("chunk", each("chunks"))
    left, right = left.select(F.col("id").alias("query"), "vec", "cell", "block", "chunk"), right.select(F.col("id").alias("doc"), "vec", "cell", "block", "chunk")
    pairs = left.groupBy("cell", "block", "chunk").cogroup(right.groupBy("cell", "block", "chunk"))
    return pairs.applyInPandas(lambda a, b: nearest(a, b, k), "query long, doc long, relevance double")


def knn_by_cells(queries: DataFrame, corpus: DataFrame, k=10, id_col="id", vec_col="vec") -> tuple[DataFrame, DataFrame]:
    """K1: the result of ``retrieval.knn`` and ``pairs, read``: how many pairs of a query and a row there are and were compared."""
    named = lambda df: df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q, c = named(queries), written(named(corpus), "vectors")
    n = c.count()
    centres = centres_of(c, n)
    if not len(centres):  # no row has a direction: all are alike
        centres = np.zeros((1, c.select(F.size("vec")).first()[0] if n else 1))
    rows = written(in_cells(c, centres), "cells")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cells = written(cells, "cell-sizes")
    known = {r["cell"]: (r["n"], r["radius"]) for r in cells.collect()}  # CENTRES and one at most
    asked = written(bounds(q, centres, known, k), "bounds")
    near = written(read_cells(asked.select("id", "vec", F.explode("first").alias("cell")), rows, cells, k), "near")
    kth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "doc"))
    last = near.withColumn("place", kth).where(F.col("place") == k).select(F.col("query").alias("id"), F.col("relevance").alias("least"))
    others = asked.join(last, "id", "left").select("id", "vec", F.coalesce("least", F.lit(0.0)).alias("least"), F.explode(F.arrays_zip("rest", "highest")).alias("c"))
    # A relevance of 0 is that of all rows that point away, so nothing can be left out there.
    others = written(others.where((F.col("c.highest") + CLOSE >= F.col("least")) | (F.col("least") <= CLOSE)).select("id", "vec", F.col("c.rest").alias("cell")), "others")
    both = near.unionByName(read_cells(others, rows, cells, k))
    ranked = both.withColumn("rank", kth).where(F.col("rank") <= k)
    size = cells.select("cell", "n")
    read = asked.select(F.explode("first").alias("cell")).unionByName(others.select("cell")).join(size, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"))
    return ranked, asked.agg((F.count("*") * n).alias("pairs")).crossJoin(read)  # a row each
