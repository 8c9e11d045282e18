"""The memory table against a plain list of states: marks, history, batches that run again, compaction."""

import random

from torqueline.streaming import memory

BATCH = "user long, seq long, step string, name string, fact string, content string, description string, type string, turn_ts long, source string"
RANK = {"agent_explicit": 3, "consolidation": 2, "capture_fallback": 1}
FIELDS = ["user", "name", "fact", "content", "description", "type", "status", "turn_ts", "source"]


def steps_of(rng, batch, written, n=25):
    rows = []
    for i in range(n):
        seq, user, name = batch * 1000 + i, rng.randrange(4), rng.choice(["a", "b", "c", "todo", "", None])
        kind = rng.choice(["fact", "fact", "unresolved"])
        step = rng.choice(["write"] * 5 + ["supersede", "resolve"])
        if step == "write":
            written.append((user, f"g{seq}"))
            rows.append((user, seq, step, name, f"g{seq}", f"text {seq}", None, kind, rng.choice([None, batch, batch, batch + 1]), rng.choice([None, "agent_explicit", "consolidation", "capture_fallback"])))
        elif step == "supersede" and written:
            owner, fact = rng.choice(written)
            rows.append((owner, seq, step, None, fact if rng.random() < 0.9 else "none", None, None, None, None, None))
        elif step == "resolve" and name:
            rows.append((user, seq, step, name, None, None, None, None, None, None))
    return rows


def plain(batches):
    """(states now, states after each batch): one step after the other."""
    now, after = {}, []
    for rows in batches:
        for user, _, step, name, fact, content, description, kind, turn, source in sorted(rows, key=lambda r: r[1]):
            if step == "write":
                name = name if name and name.strip() else f"todo-{fact}" if kind == "unresolved" else None
                key = (user, f"n:{name}" if name else f"f:{fact}")
                new = [user, name, fact, content, description, kind, "active", turn, source]
                old = now.get(key)
                if old is None:
                    now[key] = new
                    continue
                t, u = (-(2**63) if v is None else v for v in (old[7], turn))
                newer = u > t if u != t else RANK.get(source, 4) >= RANK.get(old[8], 4)
                if newer and not (old[6] == "deleted" and source == "consolidation"):
                    now[key] = [*new[:2], old[2], *new[3:]]
            elif step == "supersede":
                for old in now.values():
                    if old[0] == user and old[2] == fact:
                        old[6] = "superseded"
            elif (user, f"n:{name}") in now and now[user, f"n:{name}"][5] == "unresolved" and now[user, f"n:{name}"][6] != "deleted":
                now[user, f"n:{name}"][6] = "deleted"
        after.append(sorted((tuple(v) for v in now.values()), key=repr))
    return after


def states(df):
    return sorted((tuple(r) for r in df.select(FIELDS).collect()), key=repr)


def test_states_equal_step_by_step(spark, tmp_path):
    rng, path = random.Random(1), f"file://{tmp_path}/memory"
    written = []
    batches = [steps_of(rng, k, written) for k in range(7)]
    batches[4] = batches[4][:1]  # one bucket alone
    write = memory.memory_writer(path, buckets=3, compact_every=3)
    want = plain(batches)
    assert memory.current(spark, path) is None
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, BATCH), k)
        if k in (3, 5):
            write(spark.createDataFrame(rows, BATCH), k)  # a batch that runs again, also right after a compaction, changes nothing
        assert states(memory.current(spark, path)) == want[k]
    for k in range(7):  # also of generations that a compaction has gathered
        assert states(memory.as_of(spark, path, k)) == want[k]
    memory.compact(spark, path, 7, buckets=3)
    assert states(memory.current(spark, path)) == want[-1] and states(memory.as_of(spark, path, 2)) == want[2]
    assert {r["status"] for r in memory.current(spark, path).collect()} == {"active", "superseded", "deleted"}


def test_a_compaction_that_ended_early_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    write = memory.memory_writer(path, buckets=2, compact_every=0)
    rows = [(1, 1, "write", "a", "f1", "x", None, "fact", 1, None)]
    write(spark.createDataFrame(rows, BATCH), 0)
    (tmp_path / "memory/base/generation=0/bucket=0").mkdir(parents=True)  # without the mark of a complete table
    assert [r["content"] for r in memory.current(spark, path).collect()] == ["x"]
    write(spark.createDataFrame([(1, 2, "write", "a", "f2", "y", None, "fact", 2, None)], BATCH), 1)
    assert [(r["fact"], r["content"]) for r in memory.current(spark, path).collect()] == [("f1", "y")]


def test_summaries(spark):
    rows = [(1, 1, "old"), (1, 2, "x" * 400), (1, 3, ""), (2, 1, None)]
    assert [tuple(r) for r in memory.summaries(spark.createDataFrame(rows, "session long, seq long, summary string")).collect()] == [(1, "x" * 300)]
