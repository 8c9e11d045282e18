"""Registered queries of the streams: each feeds a table to a stream, runs it to its end and reads what it has written."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .sources.scratch import folder, written
from .sources.tables import table
from .streaming import jobs, memory, state


def streamed(rows: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``job`` makes of ``rows`` as a stream, appended to a table in the shared folder."""
    spark, place = rows.sparkSession, folder(rows.sparkSession, name)
    rows.write.parquet(f"{place}/in")
    out = job(state.session_of(spark).readStream.schema(rows.schema).parquet(f"{place}/in"))
    q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query("""SELECT DISTINCT user_id::VARCHAR AS message FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT '' FROM events WHERE event_id % 10 = 0""")
def t1_consume_once(spark, d):
    """Each message id once; a tenth of the messages has none and all of those pass."""
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    return streamed(rows, jobs.consume_once, "t1").select(F.coalesce("message_id", F.lit("")).alias("message"))


@query("""WITH b AS (SELECT user_id || '-' || abs(event_id) % 50 AS session, user_id AS "user", abs(event_id) % 50 AS manual, ts FROM events),
dw AS (SELECT *, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts)) / 1000000.0) AS s FROM b),
beats AS (SELECT *, (CASE WHEN s IS NULL OR s > 300 THEN 0 ELSE least(s, 30) END)::BIGINT AS seconds, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM dw),
p AS (SELECT *, sum(seconds) OVER (PARTITION BY "user", manual, day ORDER BY ts, session ROWS UNBOUNDED PRECEDING)::BIGINT AS day_seconds FROM beats)
SELECT session, epoch_us(ts) AS at_us, seconds, day, day_seconds, day_seconds >= 60 AND day_seconds - seconds < 60 AS counted_now FROM p""")
def t2_reading_progress(spark, d):
    """T2 by keyed state and timers; a last beat of no user lets the watermark pass all others."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    manual = F.abs("event_id") % 50
    beats = events.select("user_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), manual.cast("string")).alias("session"), manual.alias("manual"), "ts")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit("").alias("session"), F.lit(None).cast("long").alias("manual"), "ts")
    rows = beats.unionByName(end.where("ts IS NOT NULL")).withColumnRenamed("user_id", "user")
    out = streamed(rows, state.reading_progress, "t2").where("user IS NOT NULL")
    return out.select("session", F.unix_micros("ts").alias("at_us"), "seconds", "day", "day_seconds", "counted_now")


@query("""SELECT strftime(ts + INTERVAL 8 HOUR, '%G-%V') AS period, user_id AS manual, count(*) AS reads FROM events GROUP BY 1, 2""")
def t3_week_counts(spark, d):
    """Counts by ISO week, brought up to date by each batch."""
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("manual"))
    place = folder(spark, "t3")
    rows.write.parquet(f"{place}/in")
    counts = jobs.period_counts(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), "week")
    jobs.count_writer(counts, f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return jobs.latest_counts(spark, f"{place}/out", counts)


ROUNDS_SQL = """WITH RECURSIVE m AS (SELECT conv_id AS session, turn // 2 + 1 AS round, role, length(coalesce(text, '')) AS n FROM conversations),
b AS (SELECT session, CAST(ceil(round / 2.0) AS BIGINT) AS block, sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS chars, count(*) AS messages, min(round) AS first, max(role = 'assistant' AND round % 2 = 0) AS answered FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY block) AS i FROM b),
f AS (SELECT session, i, block, first, messages, chars, answered AND chars >= 60 AS due FROM o WHERE i = 1
  UNION ALL SELECT o.session, o.i, o.block, CASE WHEN f.due THEN o.first ELSE f.first END, o.messages + CASE WHEN f.due THEN 0 ELSE f.messages END, o.chars + CASE WHEN f.due THEN 0 ELSE f.chars END,
    o.answered AND o.chars + CASE WHEN f.due THEN 0 ELSE f.chars END >= 60 FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1)
SELECT session, block * 2 AS round, first::BIGINT AS first_round, messages::BIGINT AS messages, chars::BIGINT AS chars FROM f WHERE due"""


def rounds(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn").cast("long")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), (F.floor(turn / 2) + 1).cast("long").alias("round"), (turn % 2).alias("place"), "role", "text")


@query(ROUNDS_SQL)
def t4_consolidation(spark, d):
    """T4 by keyed state; the given conversations are short, so it runs at every second round and 60 characters."""
    out = streamed(rounds(spark, d), lambda m: state.consolidation_triggers(m, every=2, least=60), "t4")
    return out.select("session", "round", "first_round", "messages", "chars")


@query(ROUNDS_SQL)
def t4_consolidations_batch(spark, d):
    from .operators import lifecycle

    return lifecycle.consolidations(rounds(spark, d), every=2, least=60)


@query("""WITH w AS (SELECT user_id AS "user", 'n' || event_id % 7 AS name, event_id, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS i FROM events),
l AS (SELECT "user", name, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM w GROUP BY ALL)
SELECT "user", name, 'f' || first AS fact, 'text ' || last AS content, CASE WHEN first % 3 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN first % 3 = 0 THEN 2 ELSE 1 END AS states FROM l""")
def t5_memory(spark, d):
    """T5: all writes in one batch, and marks that supersede a third of the facts in the next; ``states`` counts each memory's history."""
    path, events = folder(spark, "t5") + "/memory", table(spark, d, "events")
    nothing = lambda c: F.lit(None).cast("string").alias(c)
    fact = F.concat(F.lit("f"), F.col("event_id").cast("string"))
    writes = events.select(
        F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.lit("write").alias("step"), F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")).alias("name"), fact.alias("fact"),
        F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("content"), nothing("description"), F.lit("fact").alias("type"), F.col("event_id").alias("turn_ts"), F.lit("agent_explicit").alias("source"))
    marks = events.where("event_id % 3 = 0").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.lit("supersede").alias("step"), nothing("name"), fact.alias("fact"), nothing("content"), nothing("description"), nothing("type"), F.lit(None).cast("long").alias("turn_ts"), nothing("source"))
    write = memory.memory_writer(path)
    write(writes, 0)
    write(marks, 1)
    now = memory.current(spark, path).select("user", "name", "fact", "content", "status")
    states = memory.rows_at(spark, path).groupBy(F.col("user").alias("u"), F.col("name").alias("m")).agg(F.count("*").alias("states"))
    return written(now.join(states, F.col("user").eqNullSafe(F.col("u")) & (F.col("name") == F.col("m"))).drop("u", "m"), "t5-now")
