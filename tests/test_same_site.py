"""J3 against a plain version, and what its pairs move as."""

import random

import pytest

from pyspark.sql import functions as F

from torqueline.operators import usage


def plain(owned, sites, links, live, scored, top):
    out = set()
    for user in {u for u, _ in owned}:
        own = {d for u, d in owned if u == user}
        near = {d for d, s in sites if s in {s for o, s in sites if o in own}} - own
        found = sorted({m for d, m in links if d in near and m in live} - {m for u, m in scored if u == user})
        out |= {(user, m) for m in (found[:top] if top else found)}
    return out


def given(spark, seed):
    rng = random.Random(seed)
    sites = [(d, d // 4) for d in range(40)]
    links = [(rng.randrange(44), rng.randrange(30)) for _ in range(200)]
    owned = [(rng.randrange(12), rng.randrange(42)) for _ in range(50)]
    live = set(rng.sample(range(30), 22))
    scored = list({(u, m) for u, d in owned for e, m in links if d == e and rng.random() < 0.5})
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((owned, "user long, device long"), (sites, "device long, site long"), (links, "device long, manual long"), ([(m,) for m in live], "manual long"), (scored, "user long, manual long"))]
    return (owned, sites, links, live, scored), frames


def test_pairs_equal_all_pairs(spark):
    for top in (None, 3):
        rows, frames = given(spark, 5)
        out = [(r["user"], r["manual"]) for r in usage.same_site_scores(*frames, top=top).collect()]
        assert len(out) == len(set(out)) > 10 and set(out) == plain(*rows, top)


def test_pairs_move_as_arrays(spark):
    """rows of user and manual are made at the end, and no join or grouping takes them."""
    for top in (None, 3):
        plan = usage.same_site_scores(*given(spark, 6)[1], top=top)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(m#" in plan.splitlines()[1]


def test_kinds_are_cut_each_by_themselves(spark):
    """with ``apart`` one pass gives the first manuals of both kinds."""
    rows, frames = given(spark, 7)
    owned, sites, links, live, scored = rows
    frames[3] = spark.createDataFrame([(m, m % 4 == 0) for m in live], "manual long, apart boolean")
    out = usage.same_site_scores(*frames, top=2)
    kinds = [plain(owned, sites, links, {m for m in live if (m % 4 == 0) == late}, scored, 2) for late in (True, False)]
    assert {(r["user"], r["manual"]) for r in out.collect()} == kinds[0] | kinds[1] and all(kinds)


def test_recommendations_are_computed_once(spark):
    """what a user's best manuals follow from stands once in the plan, not once more for the newest that fill them up."""
    own = spark.createDataFrame([(1, 5, 3.0), (1, 6, 3.0), (2, 5, 3.0)], "user long, manual long, score double")
    live = spark.sql("SELECT id AS manual, timestamp_seconds(id) AS created, timestamp_seconds(id) AS updated FROM range(9)")
    near = own.where("manual < 0")
    out = usage.recommend(own, near, spark.createDataFrame([(1,), (3,)], "user long"), live, F.lit("2024-01-01").cast("timestamp"), top=3)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["user"], r["place"])):
        got.setdefault(r["user"], []).append((r["manual"], r["score"]))
    assert got == {1: [(5, 3.0), (6, 3.0), (8, 0.0)], 2: [(5, 3.0)], 3: [(8, 0.0), (7, 0.0), (6, 0.0)]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("检修设备") == 1


@pytest.mark.parametrize("most", [usage.BROADCAST_LIVE, 0])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_manuals_move_as_words(spark, monkeypatch, kind, most):
    """of a site's manuals 64 move to a user as one word, with ids below 0 and far apart, or of a kind that has no words."""
    monkeypatch.setattr(usage, "BROADCAST_LIVE", most)
    rows, frames = given(spark, 8)
    ids = lambda m: (m * m * m * 1009 - 9_000_000) if m % 2 else m - 15
    frames = [f.withColumn("manual", F.when(F.col("manual") % 2 == 1, F.col("manual") * F.col("manual") * F.col("manual") * 1009 - 9_000_000).otherwise(F.col("manual") - 15).cast(kind)) if "manual" in f.columns else f for f in frames]
    out = usage.same_site_scores(*frames)
    got = [(r["user"], int(r["manual"])) for r in out.collect()]
    assert dict(out.dtypes)["manual"] == {"long": "bigint"}.get(kind, kind)
    assert len(got) == len(set(got)) > 10 and set(got) == {(u, ids(m)) for u, m in plain(*rows, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(words#" in plan and "collect_list(m#" not in plan
