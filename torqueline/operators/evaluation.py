"""Offline evaluation: ranking metrics, pass rates, paired comparison and dataset checks."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(runs: DataFrame, qrels: DataFrame, k=10) -> DataFrame:
    """Recall, reciprocal rank and nDCG at ``k`` (gain 2^grade - 1) of each query with a positive judgement.

    runs: query, rank, doc (the first rank of a document counts); qrels: query, doc, grade."""
    first = runs.groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "doc"))).where(F.col("rank") <= k)
    grades = qrels.withColumn("grade", F.when(F.col("grade") < 0, F.raise_error(F.lit("a grade is negative"))).otherwise(F.col("grade")))
    grades = grades.where("grade > 0").withColumn("gain", F.pow(F.lit(2.0), "grade") - 1)
    # The ideal list depends on the number of each grade alone, so counts are enough.
    best = grades.groupBy("query", "gain").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query").orderBy(F.desc("gain"))
    best = best.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    best = best.withColumn("taken", F.least(F.col("n"), F.greatest(F.lit(k) - F.col("before"), F.lit(0))))
    ranks = F.when(F.col("taken") > 0, F.sequence(F.col("before") + 1, F.col("before") + F.col("taken"))).otherwise(F.array().cast("array<bigint>"))
    ideal = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + F.col("gain") / F.log2(r + 1.0))
    per = best.withColumn("ideal", ideal).groupBy("query").agg(F.sum("n").alias("positives"), F.sum("ideal").alias("ideal"))
    hits = first.join(grades, ["query", "doc"]).groupBy("query").agg(
        F.count("*").alias("hits"), F.min("rank").alias("best_rank"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    out = per.join(hits, "query", "left")
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query", value(F.col("hits") / F.col("positives")).alias("recall"), value(1.0 / F.col("best_rank")).alias("mrr"), value(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def hit_summary(cases: DataFrame) -> DataFrame:
    """Hit rates at 1, 3 and 5 and mean reciprocal rank over answerable cases that were not skipped, and the mean recall and
    precision of their pictures where pictures are asked for.

    cases: answerable, skipped, rank (null: no hit), image_recall, image_precision (null: none asked for)."""
    hit = lambda n: F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6).alias(f"hit_{n}")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    rows = cases.where(F.col("answerable") & ~F.coalesce("skipped", F.lit(False)))
    return rows.agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), mean("image_recall"), mean("image_precision"))


def nugget_coverage(nuggets: DataFrame) -> DataFrame:
    """The covered share of each case's nugget weights, null without weight. nuggets: case, weight (null: 1), covered."""
    weight = F.coalesce("weight", F.lit(1.0))
    out = nuggets.groupBy("case").agg(F.sum(F.when(F.col("covered"), weight).otherwise(0.0)).alias("covered"), F.sum(weight).alias("total"))
    return out.select("case", F.round(F.col("covered") / F.nullif("total", F.lit(0.0)), 6).alias("coverage"))


def run_summary(rows: DataFrame, by: str = "variant") -> DataFrame:
    """Pass rates of subsets (0 for an empty one) and latency mean and interpolated percentiles.

    rows: passed, answerable, latency_ms."""
    rate = lambda on: F.round(F.coalesce(F.avg(F.when(on, F.col("passed").cast("double"))), F.lit(0.0)), 6)
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), rate(F.lit(True)).alias("pass_rate"), rate(F.col("answerable")).alias("answerable_pass_rate"),
        rate(~F.col("answerable")).alias("refusal_pass_rate"), F.round(F.avg("latency_ms"), 2).alias("latency_mean"),
        F.round(F.percentile("latency_ms", 0.5), 2).alias("latency_p50"), F.round(F.percentile("latency_ms", 0.95), 2).alias("latency_p95"),
    )


#: Passes over all rows, and over those with steps in an order or with images, and the names of their rates.
ALL_PASSES = {"final_pass": "final_pass_rate", "answer_correct_pass": "answer_correct_pass_rate", "evidence_pass": "evidence_pass_rate", "delivery_pass": "delivery_pass_rate",
              "mechanism_pass": "mechanism_pass_rate", "grounding_pass": "grounding_pass_rate", "forbidden_claim_pass": "unsupported_claim_free_rate"}
IMAGE_PASSES = {"image_pass": "image_pass_rate", "image_order_pass": "image_order_pass_rate", "step_image_binding_pass": "step_image_binding_pass_rate"}


def full_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """All figures of a run by ``by``: numbers of cases of each kind, pass rates over all, procedures, images and questions without an
    answer, mean recalls, latencies of the rows that have one. What is null counts as not passed or 0; an empty kind has 0.

    rows: the passes of ``ALL_PASSES`` and ``IMAGE_PASSES``, answerable, refusal_pass, procedure_order_pass, expected_step_order,
    image_eval_required, required_nugget_recall, image_recall, image_precision, latency_ms."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    answerable, image, steps = yes("answerable"), yes("image_eval_required"), F.trim(F.coalesce("expected_step_order", F.lit(""))) != ""
    mean = lambda value, on: F.round(F.coalesce(F.avg(F.when(on, value)), F.lit(0.0)), 6)
    rate = lambda c, on: mean(yes(c).cast("double"), on)
    number = lambda c, on: mean(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), on)
    every, latency = F.lit(True), F.col("latency_ms").cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("case_count"), F.count_if(answerable).alias("answerable_case_count"), *[rate(c, every).alias(name) for c, name in ALL_PASSES.items()],
        number("required_nugget_recall", answerable).alias("avg_required_nugget_recall"), F.count_if(steps).alias("procedure_case_count"), rate("procedure_order_pass", steps).alias("procedure_order_pass_rate"),
        F.count_if(image).alias("image_case_count"), *[rate(c, image).alias(name) for c, name in IMAGE_PASSES.items()], number("image_recall", image).alias("avg_image_recall"), number("image_precision", image).alias("avg_image_precision"),
        F.count_if(~answerable).alias("no_answer_case_count"), rate("refusal_pass", ~answerable).alias("no_answer_correct_rate"),
        F.round(F.coalesce(F.avg(F.floor(latency)), F.lit(0.0)), 2).alias("avg_latency_ms"), F.round(F.coalesce(F.percentile(latency, 0.5), F.lit(0.0)), 2).alias("p50_latency_ms"),
        F.round(F.coalesce(F.percentile(latency, 0.95), F.lit(0.0)), 2).alias("p95_latency_ms"))


def metric_counts(rows: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Numerator, denominator and rate of each metric (passes, applies); null passes are left out, no denominator gives a null rate."""
    pairs = []
    for name, (passed, applies) in metrics.items():
        counted = applies & passed.isNotNull()
        pairs += [F.count_if(counted & passed).alias(f"{name}_n"), F.count_if(counted).alias(f"{name}_of")]
    one = rows.agg(*pairs)
    shown = ", ".join(f"'{name}', {name}_n, {name}_of" for name in metrics)
    out = one.select(F.expr(f"stack({len(metrics)}, {shown}) AS (metric, numerator, denominator)"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("numerator").cast("double"), F.col("denominator")), 6))


def case_rollup(turns: DataFrame) -> DataFrame:
    """Cases from their turns: summed latency, queries in order, and all applicable passes. turns: case, turn, query, latency, passed."""
    asked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "query"))), lambda t: t["query"]), " | ")
    return turns.groupBy("case").agg(F.count("*").alias("turns"), F.sum("latency").alias("latency"), asked.alias("queries"), F.bool_and("passed").alias("passed"))


def case_totals(turns: DataFrame, sums: list[str], passes: list[str]) -> DataFrame:
    """Cases from their turns: numbers (latency, tokens) summed over the turns that have them, null without any; queries in order; each pass true if
    all turns to which it applies pass, null if it applies to none. turns: case, turn, query, ``sums`` and ``passes``."""
    asked = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("turn", "query"))), lambda t: t["query"]), lambda q: F.coalesce(q, F.lit("")) != "")
    return turns.groupBy("case").agg(F.count("*").alias("turns"), F.array_join(asked, " | ").alias("queries"), *[F.sum(c).alias(c) for c in sums], *[F.bool_and(c).alias(c) for c in passes])


def majority(rows: DataFrame) -> DataFrame:
    """A case of a variant passes if at least half of its repetitions do. rows: variant, case, passed, score."""
    return rows.groupBy("variant", "case").agg((2 * F.count_if("passed") >= F.count("*")).alias("passed"), F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("repetitions"))


def missing_cases(rows: DataFrame) -> DataFrame:
    """Cases that a variant lacks."""
    variants = [r[0] for r in rows.select("variant").distinct().orderBy("variant").collect()]  # the runs compared, a few
    every = F.array(*[F.lit(v) for v in variants]).cast("array<string>")
    met = rows.groupBy("case").agg(F.collect_set(F.col("variant").cast("string")).alias("met"))
    return met.select("case", F.explode(F.array_except(every, "met")).alias("variant"))


def by_type(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Hit rates of two runs per type and overall, with the difference. Both: type, hit."""
    rates = lambda df, name: df.rollup("type").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias(name), F.grouping("type").alias("overall"))
    b, c = rates(base, "base_rate"), rates(candidate, "candidate_rate")
    out = b.join(c, (b["type"].eqNullSafe(c["type"])) & (b["overall"] == c["overall"]), "full_outer")
    kind = F.when(F.coalesce(b["overall"], c["overall"]) == 1, "overall").otherwise(F.coalesce(b["type"], c["type"], F.lit("unspecified")))
    return out.select(kind.alias("type"), "base_rate", "candidate_rate", F.round(F.coalesce("candidate_rate", F.lit(0.0)) - F.coalesce("base_rate", F.lit(0.0)), 6).alias("delta"))


def ablation(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Difference of means by each dimension by itself; empty values count as unspecified. rows: dims, delta."""
    for d in dims:
        rows = rows.withColumn(d, F.when(F.trim(F.coalesce(d, F.lit(""))) == "", "unspecified").otherwise(F.col(d)))
    pairs = ", ".join(f"'{d}', {d}" for d in dims)
    long = rows.select("delta", F.expr(f"stack({len(dims)}, {pairs}) AS (dimension, value)"))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def bootstrap(deltas: DataFrame, samples=10_000, seed=20, values=4096) -> DataFrame:
    """Percentile interval of the mean of paired differences, resampled ``samples`` times.

    Equal differences are counted first and the distinct ones dealt into parts of about ``values``. How many pairs of a resample fall
    into a part is drawn down a tree that halves the parts: at each of its nodes how many of those above go to the left, the same
    in every task by the node's seed. Then a task draws which values of its part. So the draw is exact whatever the number of
    values; a task holds a part and draws as many numbers as the tree is deep."""
    counted = deltas.where("delta is not null").groupBy("delta").agg(F.count("*").alias("n"))
    parts = -(-counted.count() // values) or 1
    counted = counted.withColumn("part", F.pmod(F.xxhash64("delta"), F.lit(parts)).cast("int"))
    sums = {r["part"]: r for r in counted.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("delta").cast("double") * F.col("n")).alias("s")).collect()}  # a row for each part
    sizes = np.array([sums[p]["n"] if p in sums else 0 for p in range(parts)], np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    total = int(upto[-1])
    mean = sum(r["s"] for r in sums.values()) / total if total else None

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("delta")
        value, n, part = rows["delta"].to_numpy(np.float64), rows["n"].to_numpy(np.int64), int(key[0])
        shares, low, high = np.full(samples, total), 0, parts
        while high - low > 1:
            middle = (low + high) // 2
            left = np.random.default_rng([seed, 0, low, high]).binomial(shares, (upto[middle] - upto[low]) / max(1, upto[high] - upto[low]))
            shares, low, high = (left, low, middle) if part < middle else (shares - left, middle, high)
        rng = np.random.default_rng([seed, 1, part])
        return pd.DataFrame({"replicate": np.arange(samples), "sum": [float(rng.multinomial(s, n / n.sum()) @ value) for s in shares]})

    sampled = counted.groupBy("part").applyInPandas(draw, "replicate long, sum double").groupBy("replicate").agg((F.sum("sum") / max(total, 1)).alias("mean"))
    return sampled.agg(
        F.lit(total).cast("long").alias("pairs"), F.round(F.lit(mean).cast("double"), 6).alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def align(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases of two runs side by side; ``side`` says where a case is missing. Both: case, passed, latency."""
    b = base.select("case", F.col("passed").alias("base_passed"), F.col("latency").alias("base_latency"), F.lit(True).alias("b"))
    c = candidate.select("case", F.col("passed").alias("cand_passed"), F.col("latency").alias("cand_latency"), F.lit(True).alias("c"))
    side = F.when(F.col("b") & F.col("c"), "both").when(F.col("b"), "base_only").otherwise("candidate_only")
    return b.join(c, "case", "full_outer").withColumn("side", side).drop("b", "c")


def transitions(aligned: DataFrame, slower=1.2) -> DataFrame:
    """Counts of pass and fail transitions and of cases that became slower than ``slower`` times."""
    word = lambda c: F.when(c, "pass").otherwise("fail")
    slow = F.count_if(F.col("cand_latency") > slower * F.col("base_latency"))
    return aligned.where("side = 'both'").groupBy(word(F.col("base_passed")).alias("base"), word(F.col("cand_passed")).alias("candidate")).agg(F.count("*").alias("n"), slow.alias("n_slower"))


def mcnemar(aligned: DataFrame) -> DataFrame:
    """Discordant pairs and the exact two-sided p: twice the binomial tail, at most 1, and 1 without any."""
    b = F.count_if(F.col("base_passed") & ~F.col("cand_passed")).alias("lost")
    c = F.count_if(~F.col("base_passed") & F.col("cand_passed")).alias("won")
    one = aligned.where("side = 'both'").agg(b, c)

    @F.pandas_udf("double")
    def p(lost: pd.Series, won: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def tail(x, y):
            n, m = int(x + y), int(min(x, y))
            return 1.0 if n == 0 else min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(m + 1)))

        return pd.Series([tail(x, y) for x, y in zip(lost, won, strict=True)])

    return one.withColumn("p_value", F.round(p("lost", "won"), 6))


def compare_fractions(pairs: DataFrame) -> DataFrame:
    """Improved, equal or declined by cross multiplication of whole numbers. pairs: metric, base_n, base_of, cand_n, cand_of."""
    left, right = (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)") for a, b in (("cand_n", "base_of"), ("base_n", "cand_of")))
    none = (F.coalesce("base_of", F.lit(0)) == 0) | (F.coalesce("cand_of", F.lit(0)) == 0)
    return pairs.withColumn("verdict", F.when(none, "not_applicable").when(left > right, "improved").when(left < right, "declined").otherwise("equal"))


def rank_regressions(base: DataFrame, candidate: DataFrame, missing=999) -> DataFrame:
    """Cases whose rank got worse; a missing rank counts as ``missing``. Both: case, rank."""
    out = base.select("case", F.col("rank").alias("b")).join(candidate.select("case", F.col("rank").alias("c")), "case", "left")
    out = out.select("case", F.coalesce("b", F.lit(missing)).alias("base_rank"), F.coalesce("c", F.lit(missing)).alias("cand_rank"))
    return out.where("cand_rank > base_rank")


def near_pages(evidence: DataFrame, pages: DataFrame, reach=1) -> DataFrame:
    """Evidence with its text found on a page at most ``reach`` away. evidence: id, doc, page, text; pages: doc, page, text."""
    wide = evidence.withColumn("page", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)))
    p = pages.select("doc", "page", F.col("text").alias("page_text"))
    found = wide.join(p, ["doc", "page"]).where(F.col("page_text").contains(F.col("text"))).select("id").distinct()
    return evidence.join(found.withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def dataset_issues(cases: DataFrame) -> DataFrame:
    """Issue codes of gold cases, one row each. cases: case, question, answerable, pages (array), n_pages, nuggets (array)."""
    cases = cases.withColumn("same", F.count("*").over(Window.partitionBy("case")))
    rules = [
        F.when(F.col("same") > 1, "duplicate_case"), F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "missing_question"),
        F.when(F.exists("pages", lambda p: (p < 1) | (p > F.col("n_pages"))), "page_out_of_range"),
        F.when(F.col("answerable") & (F.size("nuggets") <= 0), "missing_nuggets"),
    ]
    return cases.select("case", F.explode(F.array_compact(F.array(*rules))).alias("code"))


def graph_recall(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Per case type the cases, those that pass and, for recall types, the mean share of expected nodes found.

    An isolation case passes on an empty result, a negative one always, any other when all its expected components, one at
    least, are found. cases: case, case_type, should_be_empty, components, solutions; found: case, component, solution."""
    got = found.groupBy("case").agg(F.collect_set("component").alias("got_components"), F.collect_set("solution").alias("got_solutions"), F.count("*").alias("n_found"))
    none = F.array().cast("array<string>")
    rows = cases.join(got, "case", "left")
    hits = lambda wanted, have: F.size(F.filter(F.coalesce(wanted, none), lambda x: F.array_contains(F.coalesce(F.col(have), none), x)))
    size = lambda wanted: F.size(F.coalesce(wanted, none))
    component_hits, expected = hits("components", "got_components"), size("components") + size("solutions")
    passed = (
        F.when(F.col("should_be_empty"), F.col("n_found").isNull()).when(F.col("case_type") == "negative", True)
        .otherwise((component_hits == size("components")) & (size("components") > 0))
    )
    share = F.when(expected > 0, (component_hits + hits("solutions", "got_solutions")) / expected).otherwise(1.0)
    weak = F.coalesce("should_be_empty", F.lit(False)) | (F.col("case_type") == "negative")
    share = F.when(F.col("case_type").startswith("recall"), F.when(weak, F.lit(0.0)).otherwise(share))
    scored = rows.select("case_type", passed.alias("passed"), share.alias("share"))
    return scored.groupBy("case_type").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg("share"), 6).alias("recall"))
