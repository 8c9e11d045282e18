"""Exact deduplication by stateful streaming, in DataFrame functions only.

Documents enter a streaming aggregation as (digest, identifier, locator). Its keyed state lives in RocksDB on disk and has
no watermark, so it never expires: per digest it retains the stable identifier that stays, the number of rows and the
content locator (identifier and number of bytes of the kept text). Every hit, a digest that the state has more than once, is
checked by full bytes: its smallest and its largest text, found by digest, are the same text if and only if all are; digests
whose texts differ are grouped again by their full texts, so a digest collision never merges two texts.

The state lives in a folder. With a folder of the caller's own, ``deduplicate`` adds its rows to what earlier calls have put
there. Of ``earlier``, the rows of those calls, the texts that the locators of hit digests name take part in the check of full
bytes; all others were compared with those when they came in. A call that is repeated, by its name or with the same rows,
changes nothing, wherever it ended before.

Defined cases: null text equals the empty text; of equal texts the row with the largest identifier stays (null ids are
smallest); of repeated rows with that identifier exactly one stays; an empty table gives an empty result; other columns are
ignored. Texts are compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, stored, workspace

#: Most digests (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_HITS = 2_000_000

STATE = "spark.sql.streaming.stateStore"
#: Settings of the stream's own session: state on disk, no disk reserved ahead, one bound of memory for all stores of an executor,
#: and a store leaves memory with the task that has written it.
SETTINGS = {
    f"{STATE}.unloadOnCommit": "true",
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.allowFAllocate": "false", f"{STATE}.rocksdb.boundedMemoryUsage": "true", f"{STATE}.rocksdb.maxMemoryUsageMB": "32",
    f"{STATE}.rocksdb.writeBufferSizeMB": "4",
}
#: Settings that the stream takes over from the caller's session.
TAKEN = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def keyed_state(entries: DataFrame, folder: str, run: str) -> DataFrame:
    """Adds the ``entries`` (digest, id, n_bytes) of call ``run`` to the state in ``folder``; gives the updates of their digests over all
    calls: ``digest, best (id, n_bytes), group_size``.

    What a call has written is not written again, and the stream takes no file twice, so a call can be repeated wherever it
    ended."""
    spark = entries.sparkSession
    if not exists(spark, f"{folder}/entries/{run}/_SUCCESS"):
        entries.write.mode("overwrite").parquet(f"{folder}/entries/{run}")
    own = spark.newSession()  # its settings are no one else's
    for name, value in SETTINGS.items() | {(name, spark.conf.get(name)) for name in TAKEN}:
        own.conf.set(name, value)
    stream = own.readStream.schema(entries.schema).parquet(f"{folder}/entries/*")
    state = stream.groupBy("digest").agg(F.max(F.struct("id", "n_bytes")).alias("best"), F.count("*").alias("group_size"))

    def emit(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own output.
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    query = (
        state.writeStream.outputMode("update").foreachBatch(emit)
        .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = f"digest string, best {entries.select(F.struct('id', 'n_bytes').alias('s')).schema['s'].dataType.simpleString()}, group_size long"
    if not exists(spark, f"{folder}/state"):
        return spark.createDataFrame([], schema)
    updates = spark.read.schema(schema + ", batch int").parquet(f"{folder}/state").drop("batch")
    return updates.join(entries.select("digest").distinct(), "digest", "left_semi")


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def classes(docs: DataFrame, id_col="doc_id", text_col="text", digest: Callable[[Column], Column] = sha256,
            state: str | None = None, earlier: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """One row per distinct (id, text): ``id, digest, keep_id, group_size, n_rows``; ``n_rows`` rows have that id and text."""
    spark = docs.sparkSession
    work = workspace(spark, "exact-dedup")

    def digested(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        return rows.withColumn("digest", digest(F.col("text")))

    docs = digested(docs)
    entries = stored(docs.select("digest", "id", F.octet_length("text").alias("n_bytes")), f"{work}/entries")
    if run is None:  # a call with the same rows is the same call
        n, total = entries.agg(F.count("*"), F.sum(F.xxhash64("digest", "id", "n_bytes").cast("decimal(38,0)"))).first()
        run = f"rows-{n}-{total or 0}"
    updates = stored(keyed_state(entries, state or f"{work}/state", run), f"{work}/updates")
    # Later updates of a digest count more rows.
    last = updates.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    kept = stored(last.select("digest", F.col("s.best.id").alias("keep_id"), F.col("s.group_size").alias("group_size")), f"{work}/kept")
    rows = entries.groupBy("digest", "id").agg(F.count("*").alias("n_rows")).join(kept, "digest")

    # Copies meet within their tasks first, so no group is large. Only texts with a hit move: few digests are sent to all tasks.
    hits = stored(kept.where("group_size > 1").select(F.xxhash64("digest").alias("hit")).distinct(), f"{work}/hits")
    few = hits.count() <= BROADCAST_HITS
    hit = lambda rows: rows.join(F.broadcast(hits) if few else hits, F.xxhash64("digest") == F.col("hit"), "left_semi")
    every = docs
    if earlier is not None:  # of the texts before, those that the state has located: they were compared with their copies then
        located = hit(updates).select(F.col("best.id").alias("at"), F.col("best.n_bytes").alias("bytes")).distinct()
        texts = earlier.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        every = docs.unionByName(digested(texts.join(located, F.col("id").eqNullSafe(F.col("at")) & (F.octet_length("text") == F.col("bytes")), "left_semi").withColumnsRenamed({"id": id_col, "text": text_col})))
    shared = hit(every)
    ends = shared.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    differs = stored(ends.where("low <> high").select("digest"), f"{work}/collisions")
    rows = rows.select("id", "digest", "keep_id", "group_size", "n_rows")
    if not differs.isEmpty():
        every = docs if earlier is None else docs.unionByName(digested(earlier))
        exact = every.join(differs, "digest", "left_semi").groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        each = docs.join(differs, "digest", "left_semi").groupBy("digest", "text", "id").agg(F.count("*").alias("n_rows"))
        apart = each.join(exact, ["digest", "text"]).select(rows.columns)
        rows = rows.join(differs, "digest", "left_anti").select(apart.columns).unionByName(apart)
    result = stored(rows, workspace(spark, "exact-classes"))
    remove(spark, work)
    return result


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", digest: Callable[[Column], Column] = sha256,
                state: str | None = None, earlier: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``, over these rows and those that ``state`` has already.

    ``run`` names the call, so that repeating it adds nothing; without a name its rows stand for it."""
    rows = classes(docs, id_col, text_col, digest, state, earlier, run)
    numbered = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return numbered.select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of repeated rows with one id and text the one with the smallest other columns stays."""
    columns = docs.columns
    rows = classes(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("keep_id")))
    rows = rows.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), (F.col("n_rows") > 1).alias("__again"))
    keyed = docs.withColumn("__d", sha256(F.coalesce(F.col(text_col), F.lit(""))))
    chosen = keyed.join(rows, (keyed["__d"] == rows["__digest"]) & keyed[id_col].eqNullSafe(rows["__id"]))
    once = chosen.where(~F.col("__again")).select(columns)
    rest = [c for c in columns if c not in (id_col, text_col)]
    repeated = chosen.where("__again").groupBy("__id", "__digest").agg(
        F.first(id_col).alias(id_col), F.first(text_col).alias(text_col), *([F.min(F.struct(*rest)).alias("__rest")] if rest else [])
    )
    return once.unionByName(repeated.select(*[F.col(c) if c in (id_col, text_col) else F.col("__rest")[c].alias(c) for c in columns]))
