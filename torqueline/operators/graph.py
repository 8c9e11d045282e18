"""The device - component - fault - solution graph as node and edge tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terms import containing


def live(status: Column) -> Column:
    """anything that is not marked deprecated, nulls included."""
    return F.coalesce(status, F.lit("")) != "deprecated"


def stable_id(*parts: Column) -> Column:
    """C11: sha256 of the trimmed, lower-cased parts joined by the unit separator."""
    return F.sha2(F.encode(F.concat_ws("\x1f", *[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]), "UTF-8"), 256)


def diagnosis_paths(owns: DataFrame, causes: DataFrame, solves: DataFrame) -> DataFrame:
    """Device - component - fault - solution paths anchored at components; the other ends may be missing.

    owns: device, component; causes: component, fault; solves: fault, solution."""
    anchors = owns.select("component").union(causes.select("component")).distinct()
    return anchors.join(owns, "component", "left").join(causes, "component", "left").join(solves, "fault", "left").select("device", "component", "fault", "solution")


def isolated(components: DataFrame, owns: DataFrame, devices: DataFrame) -> DataFrame:
    """Components that one of the matched devices owns."""
    return components.join(owns.join(devices.select("device"), "device", "left_semi").select("component"), "component", "left_semi")


def owners(components: DataFrame, owns: DataFrame) -> DataFrame:
    """The devices that own each component."""
    return components.select("component").distinct().join(owns.distinct(), "component")


def scored_paths(paths: DataFrame, component_scores: DataFrame, fault_scores: DataFrame) -> DataFrame:
    """Paths scored by the better of their component and fault. Scores: component or fault, score."""
    out = paths.join(component_scores.withColumnRenamed("score", "cs"), "component", "left").join(fault_scores.withColumnRenamed("score", "fs"), "fault", "left")
    return out.withColumn("score", F.greatest("cs", "fs")).where("score is not null").drop("cs", "fs")


def in_scope(paths: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """The paths inside all lists that are given: documents (the component's, else the device's, else the fault's), sections, chunks (any of the
    component's or the fault's), devices, components, faults, paths, and nodes (all three of a path, a missing fault aside).

    paths: device, component, fault, path, sections and documents as component_document, device_document, fault_document, component_section,
    fault_section, component_chunks, fault_chunks (arrays). A list that is absent lets all pass; an empty one none."""
    none = F.array().cast("array<string>")
    of = lambda name, c: F.coalesce(c.cast("string").isin(allowed[name]) if allowed[name] else F.lit(False), F.lit(False))
    rules = {
        "documents": lambda: of("documents", F.coalesce("component_document", "device_document", "fault_document")), "sections": lambda: of("sections", F.coalesce("component_section", "fault_section")),
        "chunks": lambda: F.arrays_overlap(F.array_union(F.coalesce("component_chunks", none), F.coalesce("fault_chunks", none)), F.array(*map(F.lit, allowed["chunks"])).cast("array<string>")),
        "devices": lambda: of("devices", F.col("device")), "components": lambda: of("components", F.col("component")), "faults": lambda: of("faults", F.col("fault")), "paths": lambda: of("paths", F.col("path")),
        "nodes": lambda: of("nodes", F.col("device")) & of("nodes", F.col("component")) & (F.col("fault").isNull() | of("nodes", F.col("fault"))),
    }
    for name in allowed:
        paths = paths.where(F.coalesce(rules[name](), F.lit(False)))
    return paths


def rerank_paths(paths: DataFrame, top=10) -> DataFrame:
    """K6: name matches first (fault 4, component 2: one name contains the other), then score, then id; ``top`` is 50 at most.

    paths: query, path, fault, component, asked_fault, asked_component, score."""
    kept = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\p{Punct}\p{Z}\p{Cntrl}]+", "")
    met = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    strength = F.when(met(kept("asked_fault"), kept("fault")), 4).otherwise(0) + F.when(met(kept("asked_component"), kept("component")), 2).otherwise(0)
    order = Window.partitionBy("query").orderBy(F.desc("strength"), F.desc("score"), "path")
    return paths.withColumn("strength", strength).withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(top, 50))


def path_tier(score: Column, broken: Column, provenance: Column) -> Column:
    """Low for structural reasons or below .70, high from .85 with full provenance, else medium."""
    return F.when(broken | (F.coalesce(score, F.lit(0.0)) < 0.70), "low").when((score >= 0.85) & provenance, "high").otherwise("medium")


def readiness(counts: DataFrame, policy: DataFrame) -> DataFrame:
    """Violations of a policy. counts: metric, actual; policy: metric, minimum, maximum (either may be null)."""
    out = policy.join(counts, "metric", "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    code = F.when(F.col("actual") < F.col("minimum"), F.concat("metric", F.lit("_low"))).when(F.col("actual") > F.col("maximum"), F.concat("metric", F.lit("_high")))
    return out.withColumn("violation", code)


def graph_metrics(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``metric, actual``: nodes by label, edges by type, complete paths, nodes with a vector, orphans, and the shares of components and faults
    with a vector, of paths with all ids, of paths with document, version, section and chunks, and of named chunks that the store knows.
    A share of nothing is 0.

    nodes: id, label, document, version, section, chunks (array), n_vector; edges: src, dst, type; chunks: chunk, the known ones."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    of = lambda label: nodes.where(F.col("label") == label)
    link = lambda kind: edges.where(F.col("type") == kind)
    labels = {"device_count": "Device", "component_count": "Component", "fault_count": "Fault", "solution_count": "Solution"}
    kinds = {"owns_count": "OWNS", "causes_count": "CAUSES", "has_solution_count": "HAS_SOLUTION"}
    vectors = {"component_embedding_count": "Component", "fault_embedding_count": "Fault"}
    counted = nodes.agg(*[F.count_if(F.col("label") == v).cast("double").alias(k) for k, v in labels.items()], *[F.count_if((F.col("label") == v) & (F.col("n_vector") > 0)).cast("double").alias(k) for k, v in vectors.items()])
    linked = edges.agg(*[F.count_if(F.col("type") == v).cast("double").alias(k) for k, v in kinds.items()])

    def without(label: str, source: str, kind: str) -> DataFrame:
        used = link(kind).join(of(source).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        return of(label).join(used, "id", "left_anti")

    lone_faults = without("Fault", "Component", "CAUSES").agg(F.count("*").cast("double").alias("orphan_fault_count"))
    lone_solutions = without("Solution", "Fault", "HAS_SOLUTION").agg(F.count("*").cast("double").alias("orphan_solution_count"))
    # A fault has as many paths as its components have devices: paths are counted, not listed.
    owners = link("OWNS").join(of("Device").select(F.col("id").alias("src")), "src").join(of("Component").select(F.col("id").alias("dst")), "dst")
    owners = owners.groupBy("dst").agg(F.count("*").alias("paths"), F.count_if(text("src") != "").alias("named"))
    causes = link("CAUSES").join(owners.withColumnRenamed("dst", "src"), "src").groupBy("src", "dst").agg(F.count("*").alias("k"), F.first("paths").alias("paths"), F.first("named").alias("named"))
    sources = F.filter(F.transform(F.coalesce("chunks", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: F.coalesce(c, F.lit("")) != "")
    faults = of("Fault").select(F.col("id").alias("dst"), sources.alias("sources"), ((text("document") != "") & (text("version") != "") & (text("section") != "") & (F.size(sources) > 0)).alias("sourced"))
    paths = causes.join(faults, "dst")
    n = F.col("k") * F.col("paths")
    totals = paths.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("complete_path_count"), F.coalesce(F.sum(F.when((text("src") != "") & (text("dst") != ""), F.col("k") * F.col("named"))), F.lit(0)).cast("double").alias("identity"),
        F.coalesce(F.sum(F.when(F.col("sourced"), n)), F.lit(0)).cast("double").alias("provenance"))
    named = paths.select(F.explode("sources").alias("chunk")).distinct()
    known = named.join(chunks.select("chunk").distinct().withColumn("known", F.lit(1)), "chunk", "left")
    trip = known.agg(F.count("*").cast("double").alias("graph_source_chunk_count"), F.count("known").cast("double").alias("resolved_source_chunk_count"))
    one = counted
    for other in (linked, lone_faults, lone_solutions, totals, trip):
        one = one.crossJoin(other)  # a row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    one = one.withColumns({
        "component_embedding_coverage": share("component_embedding_count", "component_count"), "fault_embedding_coverage": share("fault_embedding_count", "fault_count"),
        "path_identity_coverage": share("identity", "complete_path_count"), "path_provenance_coverage": share("provenance", "complete_path_count"),
        "chunk_round_trip_coverage": share("resolved_source_chunk_count", "graph_source_chunk_count")}).drop("identity", "provenance")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("actual")) for c in one.columns])).alias("m")).select("m.*")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(edges.select(key), key, "left_anti")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """L4: one node per key: first known name by arrival, union of manuals, smallest and largest page. rows: key, name, manual, page, arrival."""
    name = F.min(F.when(F.col("name").isNotNull(), F.struct("arrival", "name")))["name"]
    manuals = F.array_join(F.array_sort(F.collect_set(F.col("manual").cast("string"))), ",")
    return rows.groupBy("key").agg(name.alias("name"), manuals.alias("manuals"), F.min("page").alias("min_page"), F.max("page").alias("max_page"), F.count("*").alias("n"))


def merge_triples(rows: DataFrame, properties: list[str]) -> DataFrame:
    """L4: one node per key from extracted triples: of each property the first value by arrival that is not null, the union of manuals and chunk ids, and
    the smallest and largest page. rows: key, arrival, manual, chunks (array), page and the properties."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in properties]
    chunks = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("chunks", F.array().cast("array<string>"))))))
    return rows.groupBy("key").agg(*firsts, F.array_sort(F.collect_set("manual")).alias("manuals"), chunks.alias("chunks"), F.min("page").alias("min_page"), F.max("page").alias("max_page"))


def removable(nodes: DataFrame, edges: DataFrame, manual: int, hops=3) -> DataFrame:
    """Nodes that a manual's removal deletes: in no other manual, not verified, without task, and without a verified or
    task node within ``hops`` steps along edges. nodes: id, manuals (array), verified, task; edges: src, dst."""
    left = nodes.where(F.array_contains("manuals", manual)).withColumn("rest", F.array_remove("manuals", manual))
    anchored = nodes.where(F.col("verified") | F.col("task").isNotNull()).select(F.col("id").alias("node"))
    candidates = left.where((F.size("rest") == 0) & ~F.col("verified") & F.col("task").isNull()).select("id")
    reach, safe = candidates.select("id", F.col("id").alias("node")), None
    for _ in range(hops):
        reach = reach.join(edges, F.col("node") == F.col("src")).select("id", F.col("dst").alias("node")).distinct()
        found = reach.join(anchored, "node", "left_semi").select("id")
        safe = found if safe is None else safe.unionByName(found)
    return candidates.join(safe.distinct(), "id", "left_anti")


def expiring(causes: DataFrame, solves: DataFrame, solutions: DataFrame, new: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Live solutions of the live faults of each device, without the new ones. causes: device, fault; solutions: solution, status;
    new: solution; faults: fault, status, where known. New faults are left out by leaving them out of ``faults``."""
    if faults is not None:
        causes = causes.join(faults.where(live(F.col("status"))).select("fault"), "fault", "left_semi")
    found = causes.join(solves, "fault").select("device", "solution").distinct()
    return found.join(solutions.where(live(F.col("status"))).select("solution"), "solution", "left_semi").join(new.select("solution"), "solution", "left_anti")


def route_verdicts(verdicts: DataFrame, sure=0.7) -> DataFrame:
    """The best verdict of each solution that is not UNRELATED; a sure REPLACE deprecates, the rest goes to review."""
    best = verdicts.where("verdict <> 'UNRELATED'").groupBy("solution").agg(F.max(F.struct("confidence", "verdict")).alias("b"))
    action = F.when((F.col("b.verdict") == "REPLACE") & (F.col("b.confidence") >= sure), "deprecate").otherwise("review")
    return best.select("solution", F.col("b.verdict").alias("verdict"), F.col("b.confidence").alias("confidence"), action.alias("action"))


def lexical_hits(nodes: DataFrame, terms: DataFrame, top=10) -> DataFrame:
    """K5: nodes by the share of query terms in any property. nodes: id, text (short properties); terms: query, term.

    Terms meet equal substrings of the texts, each text and term once, so neither queries nor nodes pass the driver. Nodes of the same
    texts have the same hits, so of these only the first ``top`` meet the queries."""
    asked = terms.where(F.length("term") > 0).distinct()
    n = asked.groupBy("query").agg(F.count("*").alias("n_terms"))
    held = containing(nodes, "text", asked, "term")
    alike = nodes.select("id", "text").groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    alike = alike.withColumn("k", F.row_number().over(Window.partitionBy("texts").orderBy("id"))).where(F.col("k") <= top)
    first = alike.groupBy("texts").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("least", F.col("ids")[0])
    hits = first.select("least", F.explode("texts").alias("text")).join(held, "text").join(asked, "term").groupBy("query", "least").agg(F.count_distinct("term").alias("hits"))
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hits"), "least"))).where(F.col("place") <= top).drop("place")
    order = Window.partitionBy("query").orderBy(F.desc("hits"), "id")
    ranked = best.join(first.select("least", "ids"), "least").select("query", "hits", F.explode("ids").alias("id")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.join(n, "query").select("query", "id", "hits", F.round(F.col("hits") / F.col("n_terms"), 6).alias("score"), "place")
