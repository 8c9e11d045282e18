"""Manuals, procedures, rules and promoted knowledge."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terms import containing


def inventory(manuals: DataFrame, documents: DataFrame, status: str | None = None) -> DataFrame:
    """Manuals with their active document. A status, where given, drops manuals without such a document.

    manuals: manual, name, active_document; documents: document, file, status."""
    out = manuals.join(documents, F.col("active_document") == F.col("document"), "left").drop("active_document")
    return out if status is None else out.where(F.col("status") == status)


def substrings(text: Column, longest: int) -> Column:
    """The distinct substrings of ``text`` of 1 to ``longest`` characters."""
    starts = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(text)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.substr(text, i, n)))))


def match_procedure(devices: DataFrame, procedures: DataFrame) -> DataFrame:
    """The published procedure whose device type is part of the device name: of the same level first, else one without
    a level; the newest version, then the smallest id. Types meet names as equal substrings, so no pair is tried in vain.

    devices: device, name, level; procedures: procedure, type, level, version, status."""
    usable = procedures.where((F.col("status") == "PUBLISHED") & (F.trim("type") != ""))
    # Of one type and level only the first can be chosen, and devices of one name and level get the same.
    ranked = Window.partitionBy("type", "own_level").orderBy(F.desc("version"), "procedure")
    usable = usable.select("procedure", "type", F.col("level").alias("own_level"), "version").withColumn("n", F.row_number().over(ranked)).where("n = 1").drop("n")
    named = devices.where(F.trim("name") != "")
    kinds = named.select("name", "level").distinct()
    names = containing(kinds, "name", usable, "type").withColumnsRenamed({"text": "name", "term": "type"})
    exact = F.col("level") == F.col("own_level")
    free = F.coalesce(F.trim("own_level"), F.lit("")) == ""
    found = kinds.join(names.join(usable, "type"), "name").withColumn("exact", F.coalesce(exact, F.lit(False))).where(F.col("exact") | free)
    order = (F.desc("exact"), F.desc("version"), "procedure")
    of_kind = found.withColumn("n", F.row_number().over(Window.partitionBy("name", "level").orderBy(*order))).where("n = 1")
    of_kind = of_kind.select(F.col("name").alias("of_name"), F.col("level").alias("of_level"), "procedure", "version", "exact")
    met = named.join(of_kind, (F.col("name") == F.col("of_name")) & F.equal_null("level", "of_level"))
    first = Window.partitionBy("device").orderBy(*order)
    return met.withColumn("n", F.row_number().over(first)).where("n = 1").select("device", "procedure", "exact")


def round_trip(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many distinct chunk ids of the graph the chunk store knows. references, chunks: chunk."""
    asked = references.where(F.col("chunk").isNotNull()).select("chunk").distinct()
    known = asked.join(chunks.select("chunk").distinct().withColumn("known", F.lit(1)), "chunk", "left")
    return known.agg(F.count("*").alias("referenced"), F.count("known").alias("resolved"))


def pair_feedback(answers: DataFrame, messages: DataFrame, paths=("$.scope", "$.meta.scope")) -> DataFrame:
    """Each answer with its explicit question: same session and user, role user; the scope by the first path that has one.

    answers: answer, session, user, question, response; messages: message, session, user, role, text."""
    asked = messages.where("role = 'user'").select(F.col("message").alias("question"), "session", "user", F.col("text").alias("question_text"))
    scope = F.coalesce(*[F.get_json_object("response", p) for p in paths])
    return answers.withColumn("scope", scope).join(asked, ["session", "user", "question"], "left").drop("response")


def prefer_graph(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """Candidates of both, one per query and non-empty id, those of the graph first. Both: query, id, name."""
    both = graph.withColumn("route", F.lit("graph")).unionByName(vector.withColumn("route", F.lit("vector")))
    best = both.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "").groupBy("query", "id").agg(F.min(F.struct("route", "name")).alias("s"))
    return best.select("query", "id", "s.name", "s.route")


def in_one_only(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The keys that only one of two runs has, with its side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def history(tasks: DataFrame, cases: DataFrame, size=10) -> DataFrame:
    """Per user the newest closed tasks, then the newest approved cases, ``size`` rows at most. Both: user, id, at."""
    newest = Window.partitionBy("user").orderBy(F.desc("at"), F.desc("id"))

    def top(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= size).withColumn("kind", F.lit(kind))

    both = top(tasks, "maintenance_task").unionByName(top(cases, "approved_case"))
    order = Window.partitionBy("user").orderBy(F.desc("kind"), "n")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("user", "id", "kind", "place")


def toc_paths(entries: DataFrame, deepest=6) -> DataFrame:
    """The titles above each entry, then its own. An entry of a level is above until one of that level or less follows.

    entries: document, pos, level (1 to ``deepest``), title; entries without a title are left out."""
    entries = entries.where(F.trim("title") != "").withColumn("title", F.trim("title"))
    before = Window.partitionBy("document").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.struct("pos", "title"))).over(before) for n in range(1, deepest + 1)]
    rows = entries.select("document", "pos", "level", "title", *[c.alias(f"at{n}") for n, c in enumerate(last, 1)])
    above = []
    for n in range(1, deepest):
        open_ = F.col("level") > n
        for upper in range(1, n):
            open_ &= F.coalesce(F.col(f"at{upper}.pos") < F.col(f"at{n}.pos"), F.lit(True))
        above.append(F.when(open_, F.col(f"at{n}.title")))
    within = F.when(F.col("level").between(1, deepest), F.array_compact(F.array(*above, F.col("title"))))
    path = F.coalesce(within, F.raise_error(F.concat(F.lit("no such level: "), F.col("level").cast("string"))).cast("array<string>"))
    return rows.select("document", "pos", path.alias("path"))


def dedupe_records(rows: DataFrame, id_columns: list[str], structural: list[str], positions: list[str]) -> DataFrame:
    """One row per source chunk: a raw step first, then that with most structural fields, then the first read.

    The chunk is the first non-empty of ``id_columns``; rows without one all stay. ``place`` is the source order within the
    document, missing positions last. rows: document, chunk_type, seq and the columns named."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    rows = rows.withColumn("chunk", F.coalesce(*map(text, id_columns)))
    filled = sum((text(c).isNotNull().cast("int") for c in structural), F.lit(0))
    rows = rows.withColumn("filled", filled).withColumn("raw", F.coalesce((F.col("chunk_type") == "step_raw").cast("int"), F.lit(0)))
    one = Window.partitionBy("chunk").orderBy(F.desc("raw"), F.desc("filled"), "seq")
    known = rows.where("chunk IS NOT NULL").withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    order = Window.partitionBy("document").orderBy(*[F.asc_nulls_last(p) for p in positions], F.coalesce("chunk", F.lit("")), "seq")
    both = known.unionByName(rows.where("chunk IS NULL"))
    return both.select("document", "chunk", "seq", F.row_number().over(order).alias("place"))


def storage_stats(records: DataFrame) -> DataFrame:
    """Records by kind, which is their key up to the first colon. records: key."""
    return records.groupBy(F.substring_index("key", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def signature_violations(turns: DataFrame, variants: list[str]) -> DataFrame:
    """Cases whose route signature is not the same over all variants, with the variants that have none.

    turns: variant, case, repetition, turn, signature, seq; of one variant's rows the last counts, empty signatures do not."""
    given = turns.where((F.trim("signature") != "") & F.col("variant").isin(variants))
    own = given.groupBy("case", "repetition", "turn", "variant").agg(F.max(F.struct("seq", F.trim("signature").alias("signature"))).alias("s"))
    by_turn = own.groupBy("case", "repetition", "turn").agg(F.collect_set("variant").alias("seen"), F.count_distinct("s.signature").alias("n_signatures"))
    missing = F.array_except(F.array(*map(F.lit, variants)), "seen")
    out = by_turn.select("case", "repetition", "turn", F.array_join(missing, ",").alias("missing"), "n_signatures")
    return out.where("missing <> '' OR n_signatures > 1")


def best_rule(hits: DataFrame, rules: DataFrame, least=0.5) -> DataFrame:
    """The best domain rule of each query among its recalled ones: 0.7 relevance + 0.3 share of symptom keys found.

    Either must reach ``least``; of equal scores the first rank stays. hits: query, text, device, rule, rank, relevance;
    rules: rule, rule_device, keys. A rule without a device suits all."""
    joined = hits.join(rules, "rule")
    suits = (F.coalesce("rule_device", F.lit("")) == "") | F.col("rule_device").eqNullSafe(F.col("device"))
    compact = F.regexp_replace(F.lower("text"), r"\s+", "")
    found = joined.where(suits).withColumn("compact", compact)
    matched = F.filter("keys", lambda k: (F.length(k) > 0) & F.contains(F.col("compact"), k))
    found = found.withColumn("ratio", F.size(matched) / F.greatest(F.size("keys"), F.lit(1)))
    found = found.where((F.col("ratio") > 0) & ((F.col("relevance") >= least) | (F.col("ratio") >= least)))
    found = found.withColumn("score", F.round(F.col("relevance") * 0.7 + F.col("ratio") * 0.3, 6))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "rank")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("query", "rule", "score", F.round("ratio", 6).alias("ratio"))


def promote_tasks(steps: DataFrame, done=("COMPLETED", "AI_PASSED", "SKIPPED")) -> DataFrame:
    """A draft procedure of version 1 for each task whose steps are all done. steps: task, status."""
    all_done = F.bool_and(F.coalesce(F.col("status").isin(*done), F.lit(False)))
    drafts = steps.groupBy("task").agg(F.count("*").alias("total_steps"), all_done.alias("done")).where("done").drop("done")
    return drafts.select("task", "total_steps", F.lit(1).alias("version"), F.lit("DRAFT").alias("status"))


# Labels and words that tell diagnostic chunks.
EXPLICIT_LABELS = ["troubleshooting", "fault_diagnosis", "error_code"]
CONDITIONAL_LABELS = ["step", "procedure", "safety"]
EXCLUDED_LABELS = ["step", "procedure", "parameter", "specification", "toc", "table_of_contents", "image", "image_title", "figure", "caption", "table_row"]
SYMPTOM = (
    "故障|异常|失效|报警|报错|错误码|无法|不能|不工作|振动|抖动|异响|噪声|泄漏|漏油|过热|冒烟|熄火|卡滞|磨损|断裂|松动|偏高|偏低|无响应|"
    "不灵活|不顺畅|损坏|损伤|变形|开裂|硬化|弯曲|齿伤|干涉|发黑|腐蚀|划伤|刮痕|积碳|缺陷|卡住|相对滑动"
)
CAUSE_OR_ACTION = "原因|由于|导致|可能为|可能是|引起|处理|排除|解决|修复|更换|检查|检修|调整|清洁|紧固|重新安装|应当|应先|措施"
CONDITION = "若|如|如果|否则|超出|高于|低于|小于|大于|不符合|未达到"


def diagnostic_chunks(chunks: DataFrame, symptom=SYMPTOM, cause_or_action=CAUSE_OR_ACTION, condition=CONDITION) -> DataFrame:
    """whether a chunk tells a diagnosis, and why. chunks: chunk, label, chunk_type, text; no label counts as text."""
    label = F.lower(F.trim(F.coalesce("label", F.lit("text"))))
    label = F.when(label == "", "text").otherwise(label)
    kind, text = F.lower(F.trim(F.coalesce("chunk_type", F.lit("")))), F.coalesce("text", F.lit(""))
    pair = text.rlike(symptom) & text.rlike(cause_or_action)
    tables = ["table", "table_full"]
    readable = (label == "text") | (label.isin(tables) & kind.isin(tables))
    reason = (
        F.when(label.isin(EXPLICIT_LABELS), "explicit_diagnostic_label")
        .when(label.isin(CONDITIONAL_LABELS) & pair & text.rlike(condition), "conditional_diagnostic_signal_pair")
        .when(label.isin(CONDITIONAL_LABELS + EXCLUDED_LABELS), "excluded_chunk_label")
        .when(readable & pair, "diagnostic_signal_pair")
        .otherwise("no_diagnostic_signal_pair")
    )
    out = chunks.select("chunk", reason.alias("reason"))
    return out.withColumn("selected", ~F.col("reason").isin("excluded_chunk_label", "no_diagnostic_signal_pair"))


def coverage(queries: DataFrame, aspects: DataFrame, conflicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """How far the qualified evidence covers the aspects of each query, the first test that applies deciding.

    queries: query, scope; aspects: query, aspect, supported; conflicts, evidence: query."""
    of_query = aspects.groupBy("query").agg(
        F.count("*").alias("n"), F.count_if("supported").alias("n_supported"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("supported", F.lit(False)), F.col("aspect")))), ",").alias("missing"),
    )
    has = lambda rows, name: rows.select("query").distinct().withColumn(name, F.lit(True))
    rows = queries.join(of_query, "query", "left").join(has(conflicts, "conflict"), "query", "left").join(has(evidence, "qualified"), "query", "left")
    reason = (
        F.when(F.col("scope") == "out_of_scope", "out_of_scope").when(F.col("n").isNull(), "no_valid_aspects").when(F.col("conflict"), "unresolved_conflict")
        .when(F.col("qualified").isNull(), "zero_qualified_evidence").when(F.col("n_supported") == 0, "zero_supported_aspects")
        .when(F.col("n_supported") == F.col("n"), "all_aspects_supported").otherwise("missing_aspects")
    )
    status = (
        F.when(F.col("reason") == "unresolved_conflict", "conflict").when(F.col("reason") == "all_aspects_supported", "complete")
        .when(F.col("reason") == "missing_aspects", "partial").otherwise("unsupported")
    )
    return rows.withColumn("reason", reason).select("query", status.alias("status"), "reason", F.coalesce("missing", F.lit("")).alias("missing"))
