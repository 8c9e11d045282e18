"""T5: long-term memory as a table with history, kept up to date by micro-batches.

Results of consolidation are steps on memories, one after the other: a fact or an open question is written by user and name, a fact
is superseded, an open question resolved. The table holds every state that a memory ever had, with the generation that opened it
and the one that closed it; a generation closes the old state and opens the new one in one write. Memories are dealt into buckets by
their user, and a generation holds the closed states of the buckets it touches and all open ones of them; others stay as they
are. ``compact`` gathers all generations in one.

A batch that runs again reads the generations before it and replaces its own; a compaction that ends early leaves the old
generations in place, which are read until the new table is complete."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.lifecycle import source_priority
from ..sources.scratch import gone, there

STATE = StructType([
    *[StructField("user", LongType())], *[StructField(c, StringType()) for c in ("name", "fact", "content", "description", "type", "status")],
    StructField("turn_ts", LongType()), StructField("source", StringType()), StructField("opened", IntegerType()), StructField("closed", IntegerType()),
])
STORED = StructType([*STATE.fields, StructField("generation", IntegerType()), StructField("bucket", IntegerType())])
BUCKETS = 64
#: Generations after which a writer compacts.
COMPACT = 50


def base_of(spark: SparkSession, path: str) -> int:
    """The last generation up to which a complete compaction holds all, -1 without one."""
    if not there(spark, f"{path}/base"):
        return -1
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("generation=") and there(spark, f"{path}/base/{n}/_SUCCESS")), default=-1)


def rows_at(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All states in the table, of each bucket the closed ones of every generation and the open ones of its newest; None without any."""
    base, parts = base_of(spark, path), []
    if base >= 0:
        parts.append(spark.read.schema(STORED).option("basePath", f"{path}/base").parquet(f"{path}/base/generation={base}"))
    if there(spark, f"{path}/new"):
        new = spark.read.schema(STORED).parquet(f"{path}/new").where(F.col("generation") > base)
        parts.append(new if before is None else new.where(F.col("generation") < before))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    newest = rows.groupBy("bucket").agg(F.max("generation").alias("newest"))  # a row a bucket
    return rows.join(F.broadcast(newest), "bucket").where(F.col("closed").isNotNull() | (F.col("generation") == F.col("newest"))).drop("newest")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The memories as they are now."""
    rows = rows_at(spark, path)
    return None if rows is None else rows.where("closed IS NULL").select(*STATE.names)


def as_of(spark: SparkSession, path: str, generation: int) -> DataFrame | None:
    """The memories as they were after ``generation``."""
    rows = rows_at(spark, path)
    return None if rows is None else rows.where((F.col("opened") <= generation) & (F.col("closed").isNull() | (F.col("closed") > generation))).select(*STATE.names)


def overwrites(old: Column, new: Column) -> Column:
    """Whether a write goes over a state: later turns do (null is the earliest), in one turn those of the same or a higher source.

    A deleted memory is not revived by consolidation."""
    turn = lambda s: F.coalesce(s["turn_ts"], F.lit(-(2**63)))
    newer = F.when(turn(old) != turn(new), turn(new) > turn(old)).otherwise(source_priority(new["source"]) >= source_priority(old["source"]))
    return newer & ~((old["status"] == "deleted") & (F.coalesce(new["source"], F.lit("")) == "consolidation"))


def folded(open_rows: DataFrame, steps: DataFrame) -> DataFrame:
    """``key, old, new``: the state of each memory that ``steps`` touches, before and after them; ``old`` is null for a new one.

    steps: key, seq, step (write, supersede or resolve), and the state that a write brings. The steps of one memory in one batch are
    taken in their order."""
    fields = ("user", "name", "fact", "content", "description", "type", "status", "turn_ts", "source")
    state = F.struct(*fields)
    todo = steps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "step", state.alias("s")))).alias("steps"))
    old = open_rows.select("key", F.struct(*fields, "opened").alias("old"))
    rows = todo.join(old, "key", "left")
    kind = rows.select(F.element_at("steps", 1)["s"].alias("s")).schema["s"].dataType
    begin = F.when(F.col("old").isNotNull(), F.struct(*[F.col("old")[f].alias(f) for f in fields])).otherwise(F.lit(None).cast(kind))
    put = lambda s, **new: F.struct(*[new.get(f, s[f]).alias(f) for f in fields])

    def step(acc: Column, x: Column) -> Column:
        new = x["s"]
        write = F.when(acc.isNull(), new).when(overwrites(acc, new), put(new, fact=acc["fact"])).otherwise(acc)  # a memory keeps its fact id
        supersede = F.when(acc["fact"] == new["fact"], put(acc, status=F.lit("superseded"))).otherwise(acc)
        resolve = F.when((acc["type"] == "unresolved") & (acc["status"] != "deleted"), put(acc, status=F.lit("deleted"))).otherwise(acc)
        return F.when(x["step"] == "write", write).when(acc.isNull(), acc).when(x["step"] == "supersede", supersede).otherwise(resolve)

    return rows.select("key", "old", F.aggregate("steps", begin, step).alias("new")).where("new IS NOT NULL")


def memory_writer(path: str, buckets=BUCKETS, compact_every=COMPACT) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that takes the steps of a batch into the table at ``path``.

    batch: user, seq, step, name, fact, content, description, type, turn_ts, source. A write without a name is a memory of its own, by
    its fact; open questions (type unresolved) without one are named after it. A supersede names a fact, a resolve an open
    question. Steps of one user are taken in the order of ``seq``."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("user"), F.lit(buckets)).cast("int")
        rows = batch.select("user", "seq", "step", "name", "fact", "content", "description", "type", F.lit("active").alias("status"), "turn_ts", "source").withColumn("bucket", bucket)
        if compact_every and number % compact_every == 0:
            compact(spark, path, number, buckets)
        before = rows_at(spark, path, number)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        known = spark.createDataFrame([], STORED) if before is None else before.where(F.col("closed").isNull() & F.col("bucket").isin(touched))
        blank = F.trim(F.coalesce("name", F.lit(""))) == ""
        own = F.when(blank & (F.col("type") == "unresolved"), F.concat(F.lit("todo-"), "fact")).when(~blank, F.col("name"))
        rows = rows.withColumn("name", F.when(F.col("step") == "write", own).otherwise(F.col("name")))
        key = F.struct("user", F.coalesce(F.concat(F.lit("n:"), "name"), F.concat(F.lit("f:"), "fact")).alias("id")).alias("key")
        writes, resolves = (rows.where(F.col("step") == s).select("*", key) for s in ("write", "resolve"))
        # A fact id belongs to the memory that has it, or to the one that this batch writes with it.
        facts = known.select(F.col("user").alias("u"), F.col("fact").alias("f"), key).unionByName(writes.select(F.col("user").alias("u"), F.col("fact").alias("f"), "key")).distinct()
        marks = rows.where("step = 'supersede'").join(facts, (F.col("user") == F.col("u")) & (F.col("fact") == F.col("f"))).drop("u", "f")
        changed = folded(known.select("*", key), writes.unionByName(resolves).unionByName(marks))
        fields = ("user", "name", "fact", "content", "description", "type", "status", "turn_ts", "source")
        at = F.lit(number).cast("int")
        differs = F.col("old").isNull() | ~F.struct(*[F.col("old")[f] for f in fields]).eqNullSafe(F.struct(*[F.col("new")[f] for f in fields]))
        changed = changed.where(differs)
        closed = changed.where("old IS NOT NULL").select(*[F.col("old")[f].alias(f) for f in fields], F.col("old.opened").alias("opened"), at.alias("closed"))
        opened = changed.select(*[F.col("new")[f].alias(f) for f in fields], at.alias("opened"), F.lit(None).cast("int").alias("closed"))
        rest = known.select("*", key).join(changed.select("key"), "key", "left_anti").select(*STATE.names)
        out = closed.unionByName(opened).unionByName(rest).withColumn("bucket", bucket)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/new/generation={number}")

    return run


def compact(spark: SparkSession, path: str, before: int, buckets=BUCKETS) -> None:
    """Gathers all generations below ``before`` in one table, which stands for them when it is complete; then they go."""
    rows, last = rows_at(spark, path, before), base_of(spark, path)
    if rows is None or last == before - 1:
        return
    rows.drop("generation").repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/generation={before - 1}")
    if last >= 0:
        gone(spark, f"{path}/base/generation={last}")
    if there(spark, f"{path}/new"):
        new = spark.read.schema(STORED).parquet(f"{path}/new").where(F.col("generation") < before)
        for r in new.select("generation").distinct().collect():  # as many as were written since the last compaction
            gone(spark, f"{path}/new/generation={r[0]}")


def summaries(results: DataFrame, most=300) -> DataFrame:
    """T5: the newest summary of each session, cut at ``most`` characters; empty ones leave the one before. results: session, seq, summary."""
    said = results.where(F.coalesce("summary", F.lit("")) != "")
    return said.groupBy("session").agg(F.max_by(F.left("summary", F.lit(most)), "seq").alias("summary"))
