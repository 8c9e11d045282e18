"""Streams with state of their own: reading progress and consolidation.

Their sessions need ``SETTINGS``, as Spark keeps such state in RocksDB alone; ``session_of`` makes one."""

import itertools
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Hours that the business day is ahead of UTC.
BUSINESS_HOURS = 8


def session_of(spark: SparkSession, taken=("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")) -> SparkSession:
    """A session with ``SETTINGS`` that leaves those of ``spark`` as they are."""
    own = spark.newSession()
    for name, value in {**SETTINGS, **{n: spark.conf.get(n) for n in taken}}.items():
        own.conf.set(name, value)
    return own


def micros(ts: datetime) -> int:
    """Microseconds since 1970; a timestamp without a zone is one of this machine's."""
    passed = ts.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def business_day(at: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(microseconds=at, hours=BUSINESS_HOURS)).strftime("%Y-%m-%d")


class Reading(StatefulProcessor):
    """State of a user as one value: beats that the watermark has not passed, the last beat of each open session, seconds by manual and day.

    It is kept by user and not by user and manual, and read and written whole, as each call of a state costs more than what it holds."""

    def __init__(self, cap: int, gap: int, valid: int, manual: str) -> None:
        self.cap, self.gap, self.valid, self.manual = cap, gap, valid, manual

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        beat, total = f"struct<manual:{self.manual},session:string,at:bigint>", f"struct<manual:{self.manual},day:string,seconds:bigint,counted:boolean>"
        self.kept = handle.getValueState("kept", f"waiting array<{beat}>, last array<{beat}>, days array<{total}>")

    def held(self) -> tuple[list, list, list]:
        return tuple([tuple(x) for x in part] for part in self.kept.get()) if self.kept.exists() else ([], [], [])

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        new = [(r["manual"], r["session"], r["at"]) for r in rows]
        waiting, last, days = self.held()
        first = min((at for *_, at in waiting), default=None)
        self.kept.update((waiting + new, last, days))
        at = min(at for *_, at in new)
        if first is None or at < first:
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Counts the beats that the watermark has passed, in their order, so that late ones have come in before."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, last, days = self.held()
        last, days = {(m, s): at for m, s, at in last}, {(m, d): (n, counted) for m, d, n, counted in days}
        waiting.sort(key=lambda w: (w[2], w[1]))
        due, later = [w for w in waiting if w[2] < now], [w for w in waiting if w[2] >= now]
        for manual, session, at in due:
            before = last.get((manual, session))
            passed = None if before is None else (at - before) // 1_000_000
            seconds = 0 if passed is None or passed > self.gap else min(passed, self.cap)
            last[manual, session] = at
            day = business_day(at)
            so_far, counted = days.get((manual, day), (0, False))
            total = so_far + seconds
            days[manual, day] = (total, counted or total >= self.valid)
            when = datetime.fromtimestamp(at // 1_000_000).replace(microsecond=at % 1_000_000)
            yield Row(user=key[0], manual=manual, session=session, ts=when, seconds=seconds, day=day, day_seconds=total, counted_now=not counted and total >= self.valid)
        # Sessions that no beat can go on with, and days that no beat can fall on any more, leave the state.
        today = business_day(now)
        last = [(*k, at) for k, at in last.items() if at >= now - (self.gap + 1) * 1_000_000]
        days = [(*k, *v) for k, v in days.items() if k[1] >= today]
        if later or last or days:
            self.kept.update((later, last, days))
        elif self.kept.exists():
            self.kept.clear()
        if later:
            self.handle.registerTimer(later[0][2] // 1000 + 1)
        elif last:
            self.handle.registerTimer((max(at for *_, at in last) + (self.gap + 2) * 1_000_000) // 1000)


def reading_progress(beats: DataFrame, late="5 minutes", cap=30, gap=300, valid=60) -> DataFrame:
    """What each heartbeat adds, as the batch says (``usage.dwell``, ``usage.progress``): whole seconds since the last beat of
    its session, capped, 0 after a pause over ``gap``; the running total of user, manual and day (UTC+8); and whether this beat made the day
    count, which happens once. Beats are counted when the watermark has passed them, so those up to ``late`` behind find
    their place; repeated ones add nothing. Later ones are left out.

    beats: session, user, manual, ts, where a session belongs to one user and manual."""
    rows = beats.withWatermark("ts", late).select("user", "manual", F.col("session").cast("string").alias("session"), "ts", F.unix_micros("ts").alias("at"))
    keys = [StructField(c, rows.schema[c].dataType) for c in ("user", "manual")]
    out = StructType([*keys, StructField("session", StringType()), StructField("ts", TimestampType()), StructField("seconds", LongType()), StructField("day", StringType()), StructField("day_seconds", LongType()), StructField("counted_now", BooleanType())])
    return rows.groupBy("user").transformWithState(Reading(cap, gap, valid, rows.schema["manual"].dataType.simpleString()), out, "Append", "EventTime")


class Rounds(StatefulProcessor):
    """State of a session: the messages that no consolidation has taken yet, as their number, user characters and first round."""

    def __init__(self, every: int, least: int) -> None:
        self.every, self.least = every, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "first long, messages long, chars long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        first, messages, chars = self.pending.get() if self.pending.exists() else (None, 0, 0)
        for number, group in itertools.groupby(sorted(rows, key=lambda r: r["round"]), lambda r: r["round"]):
            said = list(group)
            first = number if first is None else min(first, number)
            messages, chars = messages + len(said), chars + sum(r["chars"] for r in said)
            if number % self.every == 0 and chars >= self.least and any(r["answer"] for r in said):
                yield Row(session=key[0], round=number, first_round=first, messages=messages, chars=chars)
                first, messages, chars = None, 0, 0
        if messages:
            self.pending.update((first, messages, chars))
        elif self.pending.exists():
            self.pending.clear()


def consolidation_triggers(messages: DataFrame, every=4, least=30) -> DataFrame:
    """T4: a row whenever the answer of an ``every``-th round comes in and the user has written ``least`` characters since the last
    such row; what is too short is kept for the next time, and so are rounds that failed before.

    messages: session, round, role, text; those of a session come in the order of its rounds."""
    chars = F.when(F.col("role") == "user", F.length(F.coalesce("text", F.lit("")))).otherwise(0).cast("long")
    rows = messages.select("session", F.col("round").cast("long").alias("round"), (F.col("role") == "assistant").alias("answer"), chars.alias("chars"))
    out = StructType([StructField("session", rows.schema["session"].dataType), *[StructField(c, LongType()) for c in ("round", "first_round", "messages", "chars")]])
    return rows.groupBy("session").transformWithState(Rounds(every, least), out, "Append", "None")
