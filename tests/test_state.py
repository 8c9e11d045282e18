"""Streams with state against the batch that says the same: late and repeated rows, restarts in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from torqueline.operators import lifecycle, usage
from torqueline.streaming import state

BEATS, MESSAGES = "session string, user long, manual long, ts timestamp", "session long, round long, place long, role string, text string"
START = dt.datetime(2025, 3, 1, 15, 50)  # ten minutes before the business day ends


def run(spark, schema, parts, job, folder):
    """Feeds ``parts`` one after the other, each in a query of its own that goes on from the checkpoint of the one before."""
    own, out = state.session_of(spark), f"file://{folder}/out"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        stream = own.readStream.schema(schema).parquet(f"file://{folder}/in")
        q = job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def beats(seed, n=160):
    rng, rows = random.Random(seed), []
    for s in range(8):
        t = START + dt.timedelta(seconds=rng.randint(0, 300))
        for _ in range(n // 8):
            rows.append((f"s{s}", s % 3, s % 2, t))
            t += dt.timedelta(seconds=rng.choice([0, 7, 20, 20, 29.999999, 45, 299, 300.5, 301, 420]))
    return sorted(rows, key=lambda r: r[3])


def test_reading_progress_equals_the_batch(spark, tmp_path):
    rng, rows = random.Random(1), beats(1)
    # Out of order by up to four minutes, repeated, and in three parts; a last beat far ahead lets the watermark pass all others.
    mixed = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.uniform(0, 240)))
    mixed += rng.sample(mixed[-5:], 3)
    end = ("end", 99, 99, rows[-1][3] + dt.timedelta(days=3))
    parts = [mixed[:60], mixed[60:110], [*mixed[110:], end]]
    got = run(spark, BEATS, parts, state.reading_progress, tmp_path).where("user <> 99")
    df = spark.createDataFrame(mixed, BEATS)
    want = usage.progress(usage.dwell(df, "session", "user", "manual"))
    columns = ["session", "user", "manual", "ts", "seconds", "day", "day_seconds", "counted_now"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    counted = got.where("counted_now").select("user", "manual", "day").collect()
    assert len(counted) == len(set(counted)) > 3
    assert {tuple(r) for r in counted} == {tuple(r) for r in usage.daily_reads(usage.dwell(df, "session", "user", "manual")).where("counted").select("user", "manual", F.col("day").cast("string")).collect()}


def test_beats_behind_the_watermark_are_left_out(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[("a", 1, 1, at(0)), ("a", 1, 1, at(20)), ("b", 2, 1, at(2000))], [("a", 1, 1, at(10)), ("b", 2, 1, at(4000))], [("b", 2, 1, at(9000))]]
    got = run(spark, BEATS, parts, state.reading_progress, tmp_path)
    assert sorted((r["session"], r["seconds"]) for r in got.where("user = 1").collect()) == [("a", 0), ("a", 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_consolidation_triggers_equal_the_batch(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for s in range(6):
        for r in range(1, rng.randint(3, 22)):
            rows.append((s, r, 0, "user", rng.choice([None, "", "short", "a question of some length and more"])))
            if rng.random() < 0.85:
                rows.append((s, r, 1, "assistant", "an answer of great length that says nothing about the user"))
    parts = [[r for r in rows if r[1] <= 5], [r for r in rows if 5 < r[1] <= 6], [r for r in rows if r[1] > 6]]
    got = run(spark, MESSAGES, parts, state.consolidation_triggers, tmp_path)
    want = lifecycle.consolidations(spark.createDataFrame(rows, MESSAGES))
    columns = ["session", "round", "first_round", "messages", "chars"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() > 3


class Calls:
    """A state handle of one value that counts the calls."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def called(self, change=None):
        self.n += 1
        if change is not None:
            self.value = change[0]

    exists = lambda self: self.called() or self.value is not None
    get = lambda self: self.called() or self.value
    update = lambda self, value: self.called((value,))
    clear = lambda self: self.called((None,))


def test_calls_of_the_state_do_not_grow_with_beats():
    """a user's beats of all manuals are read and written at once."""
    import types

    for n in (10, 1000):
        handle, job = Calls(), state.Reading(30, 300, 60, "bigint")
        job.init(handle)
        rows = [{"manual": i % 7, "session": str(i % 7), "at": 10_000_000 * i} for i in range(n)]
        assert list(job.handleInputRows((1,), rows, None)) == []
        passed = types.SimpleNamespace(getCurrentWatermarkInMs=lambda n=n: 10_000 * n)
        out = list(job.handleExpiredTimer((1,), passed, None))
        assert len(out) == n and handle.n <= 6 and len(handle.timers) == 2
