"""Versioned tables: knowledge documents, long-term memory, reviews and conversations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key and the number of the next version."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    out = rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return out.withColumn("next_version", F.col(version) + 1)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks deleted, modified (the content hash differs) or added between two versions. Both: uid, text, position."""
    last = lambda df, name: df.groupBy("uid").agg(F.max_by(F.sha1(F.col("text")), "position").alias(name), F.lit(True).alias(f"in_{name}"))
    both = last(old, "old").join(last(new, "new"), "uid", "full_outer")
    change = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("uid", change.alias("change"), F.col("old").alias("old_hash"), F.col("new").alias("new_hash")).where("change is not null")


def source_priority(source: Column) -> Column:
    """Null and unknown sources weigh most, then explicit saves, consolidation and the capture fallback."""
    return F.when(source == "capture_fallback", 1).when(source == "consolidation", 2).when(source == "agent_explicit", 3).otherwise(4)


def arbitrate(writes: DataFrame) -> DataFrame:
    """The winning write of each (user, name) by turn, source priority and arrival; null turns are oldest.

    A deleted row is not revived by consolidation, but by any other later write. writes: user, name, content, status,
    turn_ts, source, arrival."""
    key = ["user", "name"]
    rank = F.struct(F.coalesce("turn_ts", F.lit(-1)).alias("t"), source_priority(F.col("source")).alias("p"), F.col("arrival"))
    rows = writes.withColumn("rank", rank)
    gone = F.max(F.when(F.col("status") == "deleted", F.col("rank"))).over(Window.partitionBy(*key))
    rows = rows.withColumn("gone", gone)
    blocked = (F.col("source") == "consolidation") & (F.col("status") != "deleted") & (F.col("rank") > F.col("gone"))
    rows = rows.where(~F.coalesce(blocked, F.lit(False)))
    best = rows.groupBy(*key).agg(F.max(F.struct("rank", "content", "status", "source")).alias("b"))
    return best.select(*key, "b.content", "b.status", "b.source", F.col("b.rank.arrival").alias("arrival"))


def number_reflections(rows: DataFrame) -> DataFrame:
    """Versions of (user, type) in order of time; the last is active, older ones are archived. rows: user, type, at, id."""
    order = Window.partitionBy("user", "type").orderBy("at", "id")
    rows = rows.withColumn("version", F.row_number().over(order))
    last = F.lead("version").over(order).isNull()
    return rows.withColumn("status", F.when(last, "active").otherwise("archived"))


def recent_rounds(messages: DataFrame, rows=8) -> DataFrame:
    """The last rows of each session in ascending order. messages: session, round, id."""
    order = Window.partitionBy("session").orderBy(F.desc("round"), F.desc("id"))
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= rows).withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("round", "id"))).drop("back")


def unconsolidated(messages: DataFrame) -> DataFrame:
    """The messages that no consolidation has taken, of each session and user in the order of rounds, with their place.

    messages: session, user, round, id, consolidated (null: not yet)."""
    open_ = messages.where(~F.coalesce(F.col("consolidated"), F.lit(False)))
    return open_.withColumn("place", F.row_number().over(Window.partitionBy("session", "user").orderBy("round", "id"))).drop("consolidated")


def memory_index(facts: DataFrame, tier: Column, most=200, others=30) -> DataFrame:
    """The top facts of a user by importance and newness, then by relevance tier with few of tier 0. facts: user, id, importance, created."""
    order = Window.partitionBy("user").orderBy(F.desc("importance"), F.desc("created"), "id")
    top = facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("tier", tier)
    within = Window.partitionBy("user", "tier").orderBy("place")
    top = top.withColumn("n", F.row_number().over(within)).where((F.col("tier") > 0) | (F.col("n") <= others))
    return top.withColumn("position", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("tier"), "place"))).drop("n", "place")


def consolidations(messages: DataFrame, every=4, least=30) -> DataFrame:
    """T4: the rounds at which a session is consolidated: each ``every``-th with an answer, if the user has written ``least`` characters
    since the last one; what was too short goes on. Sums of blocks of rounds are folded, not texts.

    messages: session, round, role, text."""
    chars = F.when(F.col("role") == "user", F.length(F.coalesce("text", F.lit("")))).otherwise(0)
    answered = F.max((F.col("role") == "assistant") & (F.col("round") % every == 0))
    block = F.ceil(F.col("round") / every)
    blocks = messages.groupBy("session", block.alias("block")).agg(F.sum(chars).alias("chars"), F.count("*").alias("messages"), F.min("round").cast("long").alias("first"), answered.alias("answered"))
    ordered = blocks.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("block", "chars", "messages", "first", "answered"))).alias("blocks"))
    long = lambda v: F.lit(v).cast("long")
    none = F.struct(long(None).alias("first"), long(0).alias("messages"), long(0).alias("chars"))
    row = F.struct(long(0).alias("round"), long(0).alias("first_round"), long(0).alias("messages"), long(0).alias("chars"))

    def step(acc: Column, b: Column) -> Column:
        now = F.struct(F.coalesce(acc["open"]["first"], b["first"]).alias("first"), (acc["open"]["messages"] + b["messages"]).alias("messages"), (acc["open"]["chars"] + b["chars"]).alias("chars"))
        due = b["answered"] & (now["chars"] >= least)
        out = F.struct((b["block"] * every).alias("round"), now["first"].alias("first_round"), now["messages"].alias("messages"), now["chars"].alias("chars"))
        return F.struct(F.when(due, none).otherwise(now).alias("open"), F.when(due, F.concat(acc["out"], F.array(out))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(none.alias("open"), F.slice(F.array(row), 1, 0).alias("out"))
    return ordered.select("session", F.explode(F.aggregate("blocks", begin, step)["out"]).alias("o")).select("session", "o.*")


def archive(facts: DataFrame, now: Column) -> DataFrame:
    """L1: active facts of low importance and confidence that were not used for 90 days become archived."""
    idle = F.col("last_used").isNull() | (F.col("last_used") < now - F.expr("INTERVAL 90 DAYS"))
    due = (F.col("status") == "active") & (F.col("importance") <= 3) & (F.col("confidence") < 0.6) & idle
    return facts.withColumn("status", F.when(due, "archived").otherwise(F.col("status")))


def decay(facts: DataFrame, now: Column) -> DataFrame:
    """L2: active facts below importance 8, not of type user or unresolved, untouched for 180 days become archived."""
    touched = F.coalesce("last_used", "created")
    due = (F.col("status") == "active") & (F.col("importance") < 8) & ~F.col("type").isin("user", "unresolved") & (touched < now - F.expr("INTERVAL 180 DAYS"))
    return facts.withColumn("status", F.when(due, "archived").otherwise(F.col("status")))


def purge(facts: DataFrame, now: Column, days=180) -> DataFrame:
    """L3: superseded facts older than ``days`` go."""
    old = (F.col("status") == "superseded") & (F.coalesce("last_used", "created") < now - F.make_interval(days=F.lit(days)))
    return facts.where(~F.coalesce(old, F.lit(False)))


def purge_handled(messages: DataFrame, now: Column, days=7) -> DataFrame:
    """L3: ids of handled messages go after ``days``. messages: message_id, handled_at."""
    return messages.where(F.col("handled_at").isNull() | (F.col("handled_at") >= now - F.make_interval(days=F.lit(days))))


def due_for_dedup(facts: DataFrame, state: DataFrame, more_than=20) -> DataFrame:
    """Users with more new active facts since their last deduplication than allowed. state: user, deduped_at."""
    new = facts.where((F.col("status") == "active") & ~F.col("type").isin("user", "unresolved")).join(state, "user", "left")
    new = new.where(F.col("deduped_at").isNull() | (F.col("created") > F.col("deduped_at")))
    return new.groupBy("user").agg(F.count("*").alias("n_new")).where(F.col("n_new") > more_than)


def due_for_reflection(facts: DataFrame, reflections: DataFrame, now: Column, at_least=10) -> DataFrame:
    """Users with enough active facts that are no preferences, and no reflection within a day. reflections: user, at."""
    many = facts.where((F.col("status") == "active") & (F.col("type") != "preference")).groupBy("user").agg(F.count("*").alias("n_facts"))
    recent = reflections.where(F.col("at") >= now - F.expr("INTERVAL 24 HOURS"))
    return many.where(F.col("n_facts") >= at_least).join(recent, "user", "left_anti")


def recall_rounds(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages whose round lies in a segment of a fact's range such as "3-5,9"; reading stops at a malformed segment.

    facts: fact, session, ranges; messages: session, round, id. Rounds of a range are listed within those that the session has, so
    the join has equal keys and a range of any length costs no more than its session."""
    part = F.split(F.coalesce("ranges", F.lit("")), ",")
    good = lambda s: F.trim(s).rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$")
    bad_at = F.array_position(F.transform(part, lambda s: ~good(s)), True)
    kept = F.when(bad_at > 0, F.slice(part, 1, (bad_at - 1).cast("int"))).otherwise(part)
    seg = facts.select("fact", "session", F.explode(kept).alias("s"))
    ends = F.transform(F.split("s", "-"), lambda x: F.trim(x).cast("long"))
    seg = seg.select("fact", "session", F.element_at(ends, 1).alias("lo"), F.element_at(ends, -1).alias("hi")).where("lo <= hi")
    held = messages.groupBy("session").agg(F.min("round").alias("first"), F.max("round").alias("last"))
    seg = seg.join(held, "session").withColumn("lo", F.greatest("lo", "first")).withColumn("hi", F.least("hi", "last")).where("lo <= hi")
    rounds = seg.select("fact", "session", F.explode(F.sequence("lo", "hi")).alias("round")).distinct()
    return rounds.join(messages, ["session", "round"]).select("fact", "session", "round", "id")


def insert_once(queue: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key the queue has not, the first of each key."""
    first = new.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("place = 1").drop("place")
    return first.join(queue.select(key), key, "left_anti")
