"""Retrieval for batches of queries: recall, fusion, merging, qualification and grading."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.tables import in_parts


def knn(queries: DataFrame, corpus: DataFrame, k=10, block=2048, id_col="id", vec_col="vec", where: Column | None = None, least: float | None = None) -> DataFrame:
    """K1: exact cosine top ``k`` of each query: ``query, doc, relevance, rank`` with relevance clamped to 0..1 and six decimals.

    Both sides are cut into blocks of about ``block`` rows by a hash, and each pair of blocks meets in one task of bounded size,
    which keeps ``k`` rows a query; a window merges them. ``where`` filters the corpus before, ``least`` the scores after the cut.
    Null vectors match nothing."""
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec_col).alias("vec"))
    c = (corpus if where is None else corpus.where(where)).where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(vec_col).alias("vec"))
    n_q, n_c = (max(1, -(-rows.count() // block)) for rows in (q, c))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        each = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("qb", "cb")

    pairs = dealt(q, "query", "qb", n_q, "cb", n_c).cogroup(dealt(c, "doc", "cb", n_c, "qb", n_q))
    found = pairs.applyInPandas(lambda a, b: nearest(a, b, k), "query long, doc long, relevance double")
    order = Window.partitionBy("query").orderBy(F.desc("relevance"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("relevance") >= least)


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def nearest(queries: pd.DataFrame, corpus: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a block of the corpus for each query of a block; of equal scores the smallest ids."""
    if queries.empty or corpus.empty:
        return pd.DataFrame({"query": pd.Series([], dtype="int64"), "doc": pd.Series([], dtype="int64"), "relevance": pd.Series([], dtype="float64")})
    corpus = corpus.sort_values("doc")  # a stable choice by score then prefers small ids
    docs, score = corpus["doc"].to_numpy(), np.round(np.clip(unit(queries["vec"]) @ unit(corpus["vec"]).T, 0, 1), 6)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), order.shape[1]), "doc": docs[order].ravel(), "relevance": np.take_along_axis(score, order, 1).ravel()})


def neighbours(queries: DataFrame, corpus: DataFrame, reach=10, id_col="id") -> DataFrame:
    """A route of rows whose ids lie within ``reach``, the nearest first, scored 1/rank: ``query, doc, relevance, rank``."""
    wanted = queries.select(F.col(id_col).alias("query"), F.explode(F.sequence(F.col(id_col) - reach, F.col(id_col) + reach)).alias("doc")).where("query <> doc")
    found = wanted.join(corpus.select(F.col(id_col).alias("doc")), "doc")
    order = Window.partitionBy("query").orderBy(F.abs(F.col("doc") - F.col("query")), "doc")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.select("query", "doc", (F.lit(1.0) / F.col("rank")).alias("relevance"), "rank")


def fuse(lists: DataFrame, base=60, weight=0.85) -> DataFrame:
    """Reciprocal rank fusion of ``query, route, rank, doc, relevance``.

    The first occurrence of a document in a list counts. Gives ``query, doc, rrf, relevance, best, min_rank, routes, place``;
    rounding to six decimals comes before the order."""
    firsts = lists.groupBy("query", "route", "doc").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    n_lists = lists.groupBy("query").agg(F.countDistinct("route").alias("n_lists"))
    fused = firsts.groupBy("query", "doc").agg(
        F.sum(F.lit(1.0) / (base + F.col("rank"))).alias("raw"), F.max("relevance").alias("best"), F.min("rank").alias("min_rank"),
        F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
    ).join(n_lists, "query")
    norm = F.col("raw") / (F.col("n_lists") / F.lit(base + 1.0))
    fused = fused.select(
        "query", "doc", F.round("raw", 6).alias("rrf"),
        F.round(F.greatest(norm, F.least(F.lit(1.0), weight * F.col("best"))), 6).alias("relevance"), "best", "min_rank", "routes",
    )
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), F.desc("best"), "min_rank", "doc")
    return fused.withColumn("place", F.row_number().over(order))


def merge_routes(lists: DataFrame) -> DataFrame:
    """One row per query and document with the union of its routes and its best-scored row."""
    best = F.max(F.struct("relevance", F.struct((-F.col("rank")).alias("r")), "route")).alias("b")
    merged = lists.groupBy("query", "doc").agg(F.array_sort(F.collect_set("route")).alias("routes"), best)
    return merged.select("query", "doc", F.array_join("routes", ",").alias("routes"), F.col("b.relevance").alias("relevance"), F.col("b.route").alias("best_route"))


def canonical_id(doc: Column, metadata: Column) -> Column:
    """What a hit stands for: its source chunk, its source image, the image that it sums up, or itself."""
    named = lambda key: F.nullif(F.coalesce(metadata[key], F.lit("")), F.lit(""))
    summed = F.when(metadata["chunk_type"] == "image_summary", F.replace(doc, F.lit(":ims:"), F.lit(":img:")))
    return F.coalesce(named("source_chunk_id"), named("source_image_id"), summed, doc)


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per query and canonical id, in the order in which ids first come up: ``query, doc, place, routes, relevance, metadata,
    variants``.

    A query's candidates of one id are folded in their order: routes and variants are united; metadata take on each later value that is
    not empty, and those of a candidate with a higher score than all before it stand in the place of what was there.
    candidates: query, seq, doc, routes (array), relevance, metadata (map of strings), variants (array)."""
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    rows = candidates.select(
        "query", canonical_id(F.col("doc"), F.coalesce("metadata", empty)).alias("doc"), "seq", F.coalesce("routes", none).alias("routes"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        F.coalesce("metadata", empty).alias("metadata"), F.coalesce("variants", none).alias("variants"))
    fields = ("routes", "relevance", "metadata", "variants")
    each = rows.groupBy("query", "doc").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct("routes", "relevance", "variants").alias("s"), F.map_entries("metadata").alias("m")))).alias("c"))
    item = lambda c: F.struct(c["s"]["routes"].alias("routes"), c["s"]["relevance"].alias("relevance"), F.map_from_entries(c["m"]).alias("metadata"), c["s"]["variants"].alias("variants"))

    def overlay(acc: Column, c: Column) -> Column:
        new = item(c)
        better = new["relevance"] > acc["relevance"]
        laid = F.map_filter(F.map_zip_with(acc["metadata"], new["metadata"], lambda k, a, b: F.coalesce(F.nullif(b, F.lit("")), a)), lambda k, v: v.isNotNull())
        return F.struct(
            F.array_sort(F.array_union(acc["routes"], new["routes"])).alias("routes"), F.greatest(acc["relevance"], new["relevance"]).alias("relevance"),
            F.when(better, new["metadata"]).otherwise(laid).alias("metadata"), F.array_union(acc["variants"], new["variants"]).alias("variants"))

    first = F.element_at("c", 1)
    folded = F.aggregate(F.slice("c", 2, F.size("c")), item(first), overlay)
    out = each.select("query", "doc", first["seq"].alias("seq"), folded.alias("f"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("seq"))
    return out.select("query", "doc", place.alias("place"), *[F.col("f")[x].alias(x) for x in fields])


def diversify(ranked: DataFrame, k=5, floor=0.45, slack=0.25) -> DataFrame:
    """The first of each type above max(floor, best - slack), then the rest by score. ranked: query, doc, type, relevance."""
    by_score = Window.partitionBy("query").orderBy(F.desc("relevance"), "doc")
    by_type = Window.partitionBy("query", "type").orderBy(F.desc("relevance"), "doc")
    best = F.max("relevance").over(Window.partitionBy("query"))
    first = (F.row_number().over(by_type) == 1) & (F.col("relevance") >= F.greatest(F.lit(floor), best - slack))
    chosen = ranked.withColumn("first_of_type", first)
    order = Window.partitionBy("query").orderBy(F.desc("first_of_type"), F.desc("relevance"), "doc")
    return chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def confidence(ranked: DataFrame, wanted: Column, high=0.9, medium=0.65) -> DataFrame:
    """Best score, types met and a level; high and medium need a hit of a wanted type."""
    out = ranked.groupBy("query").agg(F.max("relevance").alias("best"), F.array_join(F.array_sort(F.collect_set(F.col("type").cast("string"))), ",").alias("types"), F.max(wanted).alias("hit"))
    level = F.when(F.col("hit") & (F.col("best") >= high), "high").when(F.col("hit") & (F.col("best") >= medium), "medium").otherwise("low")
    return out.select("query", "best", "types", level.alias("level"))


def quality(ranked: DataFrame, required: Column | None = None, top_k=5) -> DataFrame:
    """A grade of each result list with the reasons against it, in their order.

    ``required`` is the chunk type that the query's plan asks for, null if none. ranked: query, place, relevance, type, document,
    section, of which ``top_k`` places count."""
    rows = ranked.where(F.col("place") <= top_k).withColumn("required", required if required is not None else F.lit(None).cast("string"))
    score = lambda n: F.max(F.when(F.col("place") == n, F.col("relevance")))
    spread = lambda c, n: F.count_distinct(F.when((F.col("place") <= n) & (F.col(c).cast("string") != ""), F.col(c)))
    four = F.when(F.col("place") <= 4, F.col("relevance"))
    out = rows.groupBy("query").agg(
        F.count("*").alias("n"), score(1).alias("best"), score(2).alias("second"), (F.max(four) - F.min(four)).alias("width"), F.max("required").alias("required"),
        F.collect_set(F.col("type").cast("string")).alias("types"), *[spread(c, k).alias(f"{c}{k}") for c in ("document", "section") for k in (3, 4)])
    weak, medium = F.col("best") < 0.55, (F.col("best") >= 0.55) & (F.col("best") < 0.72)
    missing = F.col("required").isNotNull() & ~F.array_contains("types", F.col("required"))
    few = (F.lit(top_k) > 1) & (F.col("n") < min(top_k, 2))
    close = (F.col("n") >= 2) & (F.round(F.col("best") - F.col("second"), 9) <= 0.03) & ((F.col("document3") > 1) | (F.col("section3") > 1))
    apart = (F.col("n") >= 3) & (F.round("width", 9) <= 0.08) & ((F.col("document4") > 2) | (F.col("section4") > 2))
    reasons = F.array_compact(F.array(
        F.when(weak, "weak_top_score"), F.when(medium, "medium_top_score"), F.when(missing, F.concat(F.lit("missing_required_type:"), "required")),
        F.when(few, "too_few_candidates"), F.when(close, "ambiguous_close_scores"), F.when(apart, "dispersed_sources")))
    grade = F.when(weak, "low").when(missing | medium | few | close | apart, "medium").when(F.col("best") >= 0.8, "high").otherwise("medium")
    return out.select("query", F.round("best", 6).alias("best"), F.array_join(F.array_sort("types"), ",").alias("types"), F.array_join(reasons, ",").alias("reasons"), grade.alias("grade"))


def scope_filter(rows: DataFrame, equal: dict[str, object], any_of: dict[str, list] | None = None) -> DataFrame:
    """a conjunction of the filters that have a value; ``any_of`` columns match any of their values."""
    for name, value in equal.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    for name, values in (any_of or {}).items():
        if values:
            rows = rows.where(F.col(name).isin(values))
    return rows


def scope_state(asked: Column, found: Column) -> Column:
    """unknown if either side is empty, else matched or mismatch, without case and outer blanks."""
    a, b = (F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in (asked, found))
    return F.when((a == "") | (b == ""), "unknown").when(a == b, "matched").otherwise("mismatch")


def topic_state(query: Column, content: Column, coverage: Column, title_coverage: Column) -> Column:
    """F4's topic: conflict if no term of the query stands in the content and both coverages are under .15; matched if a coverage
    is .35 or half of the terms stand there; else weak."""
    terms = F.filter(F.split(F.trim(F.lower(F.translate(F.coalesce(query, F.lit("")), "/", " "))), r"\s+"), lambda t: F.length(t) >= 2)
    met = F.size(F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(content, F.lit(""))), t)))
    ratio = F.when(F.size(terms) > 0, met / F.size(terms)).otherwise(F.lit(0.0))
    none = (F.size(terms) > 0) & (met == 0) & (coverage < 0.15) & (title_coverage < 0.15)
    return F.when(none, "conflict").when((coverage >= 0.35) | (title_coverage >= 0.35) | (ratio >= 0.5), "matched").otherwise("weak")


def qualify(rows: DataFrame, asked: dict[str, tuple[Column, Column]], topic: Column, strict: Column, locked: Column) -> DataFrame:
    """excluded on any mismatch or topic conflict; reference_only without any asked scope, with an asked one unknown or an
    unconfirmed topic; else qualified. A scope locked by section or evidence lists stands for a confirmed topic.

    asked: name to (asked, found) in the order of the reasons; ``topic`` as of ``topic_state``."""
    states = {name: scope_state(a, f) for name, (a, f) in asked.items()}
    given = {name: F.trim(F.coalesce(a.cast("string"), F.lit(""))) != "" for name, (a, _) in asked.items()}
    any_of = lambda cs: [*cs][0] if len([*cs]) == 1 else F.greatest(*cs)
    bad = F.array_compact(F.array(*[F.when(s == "mismatch", f"{name}_mismatch") for name, s in states.items()], F.when((topic == "conflict") & ~locked, "topic_conflict")))
    unknown = any_of([(s == "unknown") & given[name] for name, s in states.items()])
    confirmed, scoped = (topic == "matched") | locked, any_of(list(given.values()))
    soft = F.array_compact(F.array(F.when(topic == "weak", "weak_topic_match"), F.when(unknown, "identity_not_confirmed")))
    open_ = ~scoped | unknown | ~confirmed
    fallback = F.when(strict, F.array(F.lit("strict_evidence_not_confirmed"))).otherwise(F.array(F.lit("reference_only")))
    state = F.when(F.size(bad) > 0, "excluded").when(open_, "reference_only").otherwise("qualified")
    reasons = F.when(F.size(bad) > 0, bad).when(open_ & (F.size(soft) == 0), fallback).otherwise(soft)
    return rows.withColumn("state", state).withColumn("reasons", F.array_join(reasons, ","))


def keyword_all(queries: DataFrame, words: DataFrame, k=10) -> DataFrame:
    """K2: documents with every term of a query, by total term frequency, scored 1/rank.

    Only words that are asked for are counted. A query's candidates are the documents of its rarest term; the other terms are
    looked up for these alone, so common terms are never listed in full. What words are counted in and looked up in are parts of
    bounded size, if ``words`` come in such parts by ``doc``. queries: query, term (distinct); words: doc, term, a row per word."""
    asked = queries.select("term").distinct()
    postings = written(words.join(asked, "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf")), "postings")
    df = asked.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    of_query = queries.join(df, "term").groupBy("query").agg(F.min(F.struct("df", "term")).alias("s"), F.count("*").alias("n_terms")).where("s.df > 0")
    candidates = of_query.select("query", "n_terms", F.col("s.term").alias("term")).hint("shuffle_hash").join(postings.select("doc", "term"), "term").select("query", "doc", "n_terms")
    wanted = candidates.join(queries, "query")
    found = wanted.join(in_parts(postings, "doc", "term"), ["doc", "term"]).groupBy("query", "doc", "n_terms").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).where("n = n_terms")
    order = Window.partitionBy("query").orderBy(F.desc("tf"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "doc", "rank", (F.lit(1.0) / F.col("rank")).alias("relevance"))


def chapter_groups(hits: DataFrame) -> DataFrame:
    """A4: hits by (query, document, section) in the order of their first hit. hits: query, document, section, rank."""
    out = hits.groupBy("query", F.coalesce("document", F.lit("")).alias("document"), F.coalesce("section", F.lit("")).alias("section"))
    out = out.agg(F.count("*").alias("hits"), F.min("rank").alias("first_rank"), F.array_join(F.array_sort(F.collect_list("rank")), ",").alias("ranks"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("first_rank", "document", "section")))


def chapters(hits: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """A4: hits by (query, document, section): their number, the list of hits in order, the ``attributes`` of the first, and the group's place by its
    first hit. Nulls of document and section are empty. hits: query, document, section, rank, hit and the attributes."""
    keys = ["query", *[F.coalesce(c, F.lit("")).alias(c) for c in ("document", "section")]]
    first = F.min(F.struct("rank", "hit", *attributes)).alias("first")
    out = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda h: h["hit"]).alias("hits"), first)  # a query's own hits
    place = F.row_number().over(Window.partitionBy("query").orderBy("first.rank", "document", "section"))
    return out.withColumn("place", place).select("query", "document", "section", "n", "hits", *[F.col(f"first.{a}").alias(a) for a in attributes], "place")


#: Words that say torque, and how units are written.
TORQUE = ("拧紧力矩", "紧固力矩", "拧紧扭矩", "紧固扭矩", "扭力")
UNITS = {"nm": "n·m"}


def conflicts(measured: DataFrame) -> DataFrame:
    """(field, unit, scope) with two distinct values and two evidence ids at least, after fields, units and numbers are
    written in one way. measured: evidence, field, unit, scope, value."""
    field = F.regexp_replace(F.lower("field"), r"\s+", "")
    for word in TORQUE:
        field = F.replace(field, F.lit(word), F.lit("扭矩"))
    unit = F.translate(F.lower(F.replace("unit", F.lit(" "))), "*⋅.", "···")
    for own, one in UNITS.items():
        unit = F.when(unit == own, one).otherwise(unit)
    number = F.regexp_replace(F.translate(F.regexp_replace("value", r"\s+", ""), "～~", "--"), r"(\.\d*?)0+(?!\d)", "$1")
    out = measured.select(F.regexp_replace(field, "^[:：|/]+|[:：|/]+$", "").alias("field"), unit.alias("unit"), F.coalesce("scope", F.lit("")).alias("scope"), "evidence",
                          F.lower(F.regexp_replace(number, r"\.(?!\d)", "")).alias("v")).where("field <> '' AND unit <> '' AND v <> ''")
    out = out.groupBy("field", "unit", "scope").agg(F.count_distinct("v").alias("n_values"), F.count_distinct("evidence").alias("n_evidence"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.where("n_values >= 2 and n_evidence >= 2")
