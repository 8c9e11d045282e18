"""Near-duplicate vectors by a pivot-permutation index.

Reference points are drawn from a bounded sample of the vectors (``SAMPLE``, by digest), thinned so that no two lie closer than
``APART``. A vector is described by its ``NEAREST`` reference points in falling order of their cosine. Inverted lists by label
and reference point hold every vector that names the point; the vectors whose first point it is are at home there. Within a list
each vector at home meets the others, and the points that both descriptions share are counted; pairs that share ``SHARED`` or
more are verified by their cosine in double precision. A pair that two lists would find counts in one of them alone.

Recall: a link is missed only where neither vector names the other's first point, or too few points are shared. For vectors at
exactly the threshold of 0.98 this befalls about one in 10,000 (64 dimensions, 256 to 4,096 points); tests measure it.

No pair leaves a task: a task sums links by vector and passes on a spanning forest of what it has found. A long list is cut
into blocks of vectors at home and of all vectors, and each pair of blocks is a piece of work of its own, so no group is held by
one task. Equal vectors with equal labels are one node with a weight.

What reaches the driver is the sample, whatever the size of the table: at most ``SAMPLE`` vectors, and counts.

Defined cases: a vector that is null, zero, empty or holds null or non-finite entries, or has a null label, links with nothing and
is its own component; vectors of different lengths link with nothing; -0.0 is 0.0; repeated rows are each a row, linked like other
equal vectors; the component id is the smallest id reachable, null only where no row has one; an empty table gives an empty
result; other columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, remove, stored, workspace
from .components import components
from .vectors import matrices, stacked, units

SAMPLE, NEAREST, SHARED = 4096, 12, 4
#: Most reference points; there are ``POINTS_BY`` times the square root of the vectors, up to this.
POINTS, POINTS_BY = 2048, 4
#: Largest cosine of two reference points: a dense cluster has one of them and not many that share it out by chance.
APART = 0.8
#: Vectors of one block of a list, and about as many rows of one group of blocks.
BLOCK, GROUP = 4096, 16_384
#: Pairs looked at together within a task.
TOGETHER = 2_000_000
#: Cosines so close to the threshold are computed again, pair by pair, so that block sizes have no say.
CLOSE = 1e-9


def read_in(rows: DataFrame, number: str) -> DataFrame:
    """``id, label, dim, node, vec`` of ``id, label, vector``; ``node``, a digest of label and vector, is null for what cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label")
            dims, nodes, raw = ([None] * len(batch) for _ in range(3))
            for at, m in matrices(batch.column("vector")):
                for i, row in zip(at, (m + 0.0).astype(number), strict=True):
                    if row.any() and labels[i].is_valid:
                        raw[i], dims[i] = row.tobytes(), len(row)
                        nodes[i] = xxhash.xxh3_128_digest(raw[i] + labels[i].as_py().encode())
            new = [pa.array(dims, pa.int32()), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), labels, *new], ["id", "label", "dim", "node", "vec"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label string, dim int, node binary, vec binary")


def reference_points(nodes: DataFrame, number: str) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, spread out, from the nodes with the smallest digests."""
    most = min(POINTS, max(64, math.ceil(POINTS_BY * math.sqrt(nodes.count()))))
    rows = nodes.select("dim", "vec").orderBy("node").limit(SAMPLE).collect()
    found = {}
    for dim in {r["dim"] for r in rows}:
        u = units(np.stack([np.frombuffer(r["vec"], number) for r in rows if r["dim"] == dim]))
        chosen, free = [], np.ones(len(u), bool)
        while free.any() and len(chosen) < most:
            chosen.append(int(free.argmax()))
            free &= u @ u[chosen[-1]] < APART
            free[chosen[-1]] = False
        found[dim] = u[chosen]
    return found


def describe(nodes: DataFrame, points: dict[int, np.ndarray], number: str) -> DataFrame:
    """``nodes`` with ``points``, their nearest reference points from the nearest on; a dimension outside the sample has one point."""
    shared = nodes.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * len(batch)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at, known = np.flatnonzero(dims == dim), shared.value.get(dim)
                if known is None:
                    known = np.zeros((1, dim))
                for part in np.array_split(at, len(at) // 1024 + 1):
                    near = -(units(stacked(batch.column("vec").take(pa.array(part)), number)) @ known.T)
                    few = np.argpartition(near, min(NEAREST, near.shape[1] - 1), axis=1)[:, :NEAREST]
                    few.sort(axis=1)
                    order = np.take_along_axis(near, few, 1).argsort(axis=1, kind="stable")
                    for i, row in zip(part, np.take_along_axis(few, order, 1).astype(np.int32), strict=True):
                        out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "points"])
        give_back()

    return nodes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", points array<int>")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of ``n`` places that the links a-b make."""
    of = np.arange(n)
    while True:
        least = np.minimum(of[a], of[b])
        new = of.copy()
        for x in (a, b, of[a], of[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == of).all():
            return of
        of = new


def links_of(home: np.ndarray, other: np.ndarray, point: int, u: np.ndarray, points: list[np.ndarray], order: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between places at home in the list of ``point`` and others of it, each once over all lists."""
    words = max(int(p.max()) for p in points) // 64 + 1
    bits = np.zeros((len(points), words), np.uint64)
    for i, p in enumerate(points):
        np.bitwise_or.at(bits[i], p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    first = np.array([p[0] for p in points])
    shared = min(SHARED, min(map(len, points)))
    step = max(1, TOGETHER // max(1, len(other)))
    for start in range(0, len(home), step):
        h = home[start : start + step]
        common = np.zeros((len(h), len(other)), np.uint8)
        for w in range(words):
            common += np.bitwise_count(bits[h, w][:, None] & bits[other, w][None, :])
        i, j = np.nonzero(common >= shared)
        if len(i) * 4 > common.size:  # most pairs share points: one product for all
            cosine = (u[h] @ u[other].T)[i, j]
            i, j, cosine = (x[cosine > threshold - CLOSE] for x in (i, j, cosine))
            close = np.flatnonzero(cosine < threshold + CLOSE)
            cosine[close] = (u[h[i[close]]] * u[other[j[close]]]).sum(1)
        else:
            cosine = np.concatenate([(u[h[i[s : s + 8192]]] * u[other[j[s : s + 8192]]]).sum(1) for s in range(0, len(i), 8192)] or [np.zeros(0)])
        a, b = h[i[cosine >= threshold]], other[j[cosine >= threshold]]
        q = first[b]
        elsewhere = (bits[a, q >> 6] >> (q & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (q < point)
        once = np.where(q == point, order[a] < order[b], ~elsewhere)
        yield a[once], b[once]


def meet(cells: DataFrame, number: str, threshold: float) -> DataFrame:
    """``node, rep, n``: links of a node within one block pair, by weight, and the node of its component there."""

    def run(table: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        keys = table.select(["label", "dim", "point", "i", "j"]).to_pandas()
        for at in keys.groupby(list(keys), sort=False).indices.values():
            part = table.take(pa.array(at))
            nodes, weights = part["node"].to_pylist(), part["weight"].to_numpy()
            order = np.argsort(np.argsort(np.array(nodes, dtype=object)))
            points = [np.asarray(p, np.int64) for p in part["points"].to_pylist()]
            home, other = (np.flatnonzero(part[c].to_numpy(zero_copy_only=False)) for c in ("home", "other"))
            n, edges = np.zeros(len(nodes)), []
            u = units(stacked(part["vec"].combine_chunks(), number))
            for a, b in links_of(home, other, part["point"][0].as_py(), u, points, order, threshold):
                n += np.bincount(a, weights[b], len(nodes)) + np.bincount(b, weights[a], len(nodes))
                local = forest(a, b, len(nodes))
                edges.append(np.stack((np.flatnonzero(local != np.arange(len(nodes))), local[local != np.arange(len(nodes))])))
            of = forest(*np.concatenate(edges, axis=1), len(nodes)) if edges else np.arange(len(nodes))
            for x in np.flatnonzero(n):
                out[0].append(nodes[x])
                out[1].append(nodes[of[x]])
                out[2].append(int(n[x]))
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["node", "rep", "n"])

    return cells.groupBy("group").applyInArrow(run, "node binary, rep binary, n long")


def blocks(described: DataFrame, keep) -> DataFrame:
    """Rows of ``described`` dealt to block pairs: ``group, label, dim, point, i, j`` and whether a row is at home or another there."""
    posted = described.withColumn("point", F.explode("points")).withColumn("own", F.col("point") == F.col("points")[0])
    lists = posted.groupBy("label", "dim", "point").agg(F.count_if("own").alias("homes"), F.count("*").alias("all")).where("homes > 0")
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    lists = keep(lists.withColumns({"h": cut("homes"), "g": cut("all")}))
    total = lists.agg(F.sum(F.col("homes") * F.col("g") + F.col("all") * F.col("h"))).first()[0] or 0
    posted = posted.join(lists.drop("homes", "all"), ["label", "dim", "point"])
    i0, j0 = F.pmod(F.xxhash64("node", F.lit(1)), "h").cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), "g").cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(upto("h"), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))
    down = F.when(F.col("own"), F.transform(upto("g"), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    rows = posted.withColumns({"i0": i0, "j0": j0}).withColumn("cell", F.explode(F.array_union(across, down)))
    rows = rows.select(
        "label", "dim", "point", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "node", "weight", "vec", "points",
        (F.col("own") & (F.col("cell.i") == F.col("i0"))).alias("home"), (F.col("cell.j") == F.col("j0")).alias("other"),
    )
    return rows.withColumn("group", F.pmod(F.xxhash64("label", "dim", "point", "i", "j"), F.lit(max(64, total // GROUP))))


def near_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", threshold=0.98) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``; see the module."""
    spark = rows.sparkSession
    element = rows.schema[vector_col].dataType.elementType.simpleString()
    number, folder, tables = "<f4" if element == "float" else "<f8", workspace(spark, "near-vectors"), iter(range(10**9))
    keep = lambda df: stored(df, f"{folder}/{next(tables)}")
    vector = F.col(vector_col) if element == "float" else F.col(vector_col).cast("array<double>")
    read = keep(read_in(rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector")), number))
    same = read.where(F.col("node").isNotNull()).groupBy("node")
    nodes = keep(same.agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least")))
    described = keep(describe(nodes.drop("least"), reference_points(nodes, number), number))
    found = keep(meet(blocks(described, keep), number, threshold))
    roots = components(found.select(F.col("node").alias("a"), F.col("rep").alias("b")), keep)
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = nodes.select("node", "weight", "least").join(counted, "node", "left").join(roots, "node", "left")
    nodes = keep(nodes.withColumn("root", F.coalesce("root", "node")))
    least = keep(nodes.groupBy("root").agg(F.min("least").alias("component")))
    of_node = keep(nodes.join(least, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component"))
    result = read.select("id", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    result = result.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    result = stored(result, workspace(spark, "vector-components"))
    remove(spark, folder)
    return result
