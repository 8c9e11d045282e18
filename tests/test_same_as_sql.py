"""Queries and their SQL on small tables with ties, repeated rows and large keys."""

from datetime import datetime

import duckdb

import __spark_entry__ as entry

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def line(order, part, supplier, number, quantity=10.0, flag="A", status="O", discount=0.05):
    return (order, part, supplier, number, quantity, 100.0, discount, 0.02, flag, status, datetime(2024, 1, 1))


def both(spark, place, name, **tables):
    """Rows of the query and of its SQL, sorted, from tables of (rows, schema)."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{place}/{table}.parquet/*.parquet')")
    ours = sorted(map(tuple, entry.queries()[name](spark, str(place)).collect()), key=str)
    return ours, sorted(db.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def test_pictures_of_one_place(spark, tmp_path):
    """pages of one line and part are in the order of pages."""
    rows = [line(1, 5, 8, 1), line(1, 5, 3, 1), line(1, 6, 3, 2, flag="N"), line(2, 5, 8, 1, flag="N"), line(2, 5, 3, 1), line(2, 5, 8, 1)]
    ours, theirs = both(spark, tmp_path, "c24_pictures", lineitem=(rows, LINE))
    assert ours == theirs and len(ours) == 2


def test_paths_that_are_given_twice(spark, tmp_path):
    """F8: a chunk and a path meet once, by the best of what they share."""
    part = [(5, "n", "b", "t", 3, 1.0), (205, "n", "b", "t", 7, 1.0)]
    rows = [line(1, 205, 3, 1, flag="R"), line(1, 205, 8, 1, flag="R"), line(2, 5, 8, 1, flag="R"), line(3, 5, 3, 7, flag="R"), line(3, 5, 8, 7, flag="R")]
    ours, theirs = both(spark, tmp_path, "j19_corroborated", part=(part, PART), lineitem=(rows, LINE))
    assert ours == theirs and len({r[:2] for r in ours}) == len(ours) == 2


def test_order_of_candidates_with_large_part_keys(spark, tmp_path):
    """the place of a candidate is its line, then its part, however large the part's key; none is lost to another line's."""
    rows = [line(1, 5, 3, 3), line(1, 10_005, 3, 2, 30.0), line(1, 20_005, 3, 1, 20.0), line(1, 1_200_000, 9, 1, 5.0), line(1, 7, 9, 4, 50.0), line(1, 7, 109, 4, 50.0)]
    ours, theirs = both(spark, tmp_path, "u1_merge_candidates", lineitem=(rows, LINE))
    assert ours == theirs and [r[2] for r in ours] == [2, 1] and ours[1][6] == "p1200000"


def test_filters_meet_kinds_of_chunks(spark):
    """summaries of the chunks that each filter lets pass, from chunks of one kind together."""
    from torqueline.operators import planning

    columns = ("chunk_type", "version", "device_type", "document")
    filters = [(q, r, x, k, v, d, o) for q, (r, x, k, v, d, o) in enumerate([("t", False, "table", "v1", "1", None), ("t", True, "table", None, "1", None), ("s", False, None, "v1", "1", "5"), ("s", False, None, "v2", "2", "7"), ("s", True, None, None, "1", "5"), ("s", True, None, None, "1", "5")])]
    chunks = [(i, ["table", "image", None][i % 3], f"v{i % 2}", str(i % 4), str(i % 8), "manual", "draft" if i % 5 == 0 else "ready") for i in range(200)]
    f = spark.createDataFrame(filters, "query long, route string, relaxed boolean, chunk_type string, version string, device_type string, document string")
    c = spark.createDataFrame(chunks, "chunk long, chunk_type string, version string, device_type string, document string, record_type string, status string")
    want = {}
    for r in planning.matching(f, c, columns).collect():
        want.setdefault((r["query"], r["route"], r["relaxed"]), []).append(r["chunk"])
    out = planning.matching_summary(f, c, columns)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items()} and len(want) > 2
