"""The rule that leaves pairs out, against all pairs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from torqueline.llm import near_dedup as nd

THRESHOLD = 0.8
C = (1 - THRESHOLD) / (1 + THRESHOLD)


def bag(counts: dict[int, int]):
    keys = sorted(counts)
    return np.array(keys, np.uint64), np.array([counts[k] for k in keys], np.int64)


@st.composite
def copies(draw):
    base = {k: draw(st.integers(1, 3)) for k in range(draw(st.integers(4, 24)))}
    edit = st.dictionaries(st.integers(0, 34), st.integers(0, 3), max_size=9)
    made = [{k: n for k, n in {**base, **draw(edit)}.items() if n} for _ in range(6)]
    return [bag(base)] + [bag(m) for m in made if m]


def differing(bags, group):
    """Rows of ``spread`` of one leader, each member in a component of its own or, if linked to it, in the leader's."""
    leader, *members = bags
    one, rows = nd.occurrences(leader), []
    for i, member in enumerate(members):
        near = nd.overlap(leader, member) >= THRESHOLD
        share, tokens = nd.differences(one, nd.occurrences(member), C)
        rows.append((f"{group:05}", f"{group:05}-{i:05}", f"{group:05}" if near else f"{group:05}-{i:05}", not near, float(share), [int(t) for t in tokens]))
    return rows


def graph_of(spark, tmp_path):
    graph = object.__new__(nd.Graph)
    graph.spark, graph.folder, graph.threshold, graph.tables = spark, f"file://{tmp_path}/graph", THRESHOLD, 0
    return graph


SPREAD = "a string, b string, root string, apart boolean, share double, tokens array<long>"


def test_no_link_is_left_out(spark, tmp_path):
    """The pairs that are formed hold every link between members of two components, over many groups of copies."""
    drawn = []

    @settings(max_examples=250, deadline=None, database=None)
    @given(copies())
    def collect(bags):
        drawn.append(bags)

    collect()
    rows = [r for g, bags in enumerate(drawn) for r in differing(bags, g)]
    found = {(r["a"], r["b"]) for r in graph_of(spark, tmp_path).sharing(spark.createDataFrame(rows, SPREAD)).collect()}
    wanted = set()
    for g, (leader, *members) in enumerate(drawn):
        apart = [nd.overlap(leader, m) < THRESHOLD for m in members]
        for i, x in enumerate(members):
            for j, y in enumerate(members[:i]):
                same = len(x[0]) == len(y[0]) and all((p == q).all() for p, q in zip(x, y))
                if not same and (apart[i] or apart[j]) and nd.overlap(x, y) >= THRESHOLD:
                    wanted.add((f"{g:05}-{j:05}", f"{g:05}-{i:05}"))
    assert wanted <= found and len(wanted) > 30


def test_texts_that_share_a_template_form_no_pairs(spark, tmp_path):
    """64 common words and 10 own ones: members have their leader's own words in common, which are too few to be a link."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**62, 56, dtype=np.uint64)

    def text(near=False):
        own = rng.integers(0, 2**62, 14, dtype=np.uint64)
        kept = np.concatenate((own[:2], first[2:])) if near else own
        h = np.sort(np.concatenate((common, kept)))
        return h, np.ones(len(h), np.int64)

    first = rng.integers(0, 2**62, 14, dtype=np.uint64)
    leader = (np.sort(np.concatenate((common, first))), np.ones(70, np.int64))
    for n in (500, 2000):
        rows = differing([leader, *[text(near=i % 10 == 0) for i in range(n)]], 0)
        graph = graph_of(spark, tmp_path / str(n))
        assert graph.sharing(spark.createDataFrame(rows, SPREAD)).count() == 0
        placed = [t for k in range(1, graph.tables + 1) if "at" in (t := spark.read.parquet(f"{graph.folder}/{k}")).columns]
        met = placed[0].groupBy("a", "token", "low", "high").agg((F.count_if(F.expr("level = low")) * F.count_if(F.expr("level = high"))).alias("pairs"))
        assert met.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] == 0  # some are looked at, none meets another


def test_occurrences_have_the_similarity_of_the_multisets():
    a, b = bag({1: 3, 2: 1, 5: 2}), bag({1: 1, 2: 4, 7: 1})
    x, y = (set(nd.occurrences(s).tolist()) for s in (a, b))
    assert (len(x), len(y)) == (6, 6)
    assert len(x & y) / len(x | y) == nd.overlap(a, b)


def test_members_far_from_their_leader_are_linked(spark):
    """Copies with the same edits are linked with each other though no leader is near both."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 150)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(20, 60)]
    for start in range(4):
        far = list(base)
        for at in range(70, 150, 12):
            far[at] = f"y{start}-{at}"
        rows.append((100 + 2 * start, " ".join(far)))
        far[3] = f"z{start}"
        rows.append((101 + 2 * start, " ".join(far)))
    out = {r.id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: nd.shingles(nd.folded(t)) for i, t in rows}
    want = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if want[j] < want[i] and nd.overlap(sets[i], sets[j]) >= THRESHOLD:
                    want[i], changed = want[j], True
    assert out == want and len(set(out.values())) > 1
