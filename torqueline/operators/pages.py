"""Pages, pictures and the tables that follow from changes: layout, lists, candidate fusion, node search, sync and promotion."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import SPACE

#: Layout rules in points.
LEAST_OVERLAP, AFTER_PENALTY, SIDE_WEIGHT, FARTHEST = 0.15, 4.0, 24.0, 180.0


def boxed(box: str) -> Column:
    """Whether a box (x0, top, x1, bottom) has an area."""
    b = F.col(box)
    return F.coalesce((F.size(b) == 4) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))), F.lit(False))


def edge(box: str, n: int) -> Column:
    return F.get(F.col(box), F.lit(n))


def side_overlap(a: str, b: str) -> Column:
    common = F.greatest(F.lit(0.0), F.least(edge(a, 2), edge(b, 2)) - F.greatest(edge(a, 0), edge(b, 0)))
    return common / F.greatest(F.lit(1.0), F.least(edge(a, 2) - edge(a, 0), edge(b, 2) - edge(b, 0)))


def layout_score(chunk: str, image: str) -> Column:
    """How far a chunk is from a picture, less is nearer; null without enough overlap from the side."""
    side = side_overlap(chunk, image)
    gap = F.when(edge(chunk, 3) < edge(image, 1), edge(image, 1) - edge(chunk, 3)).when(edge(chunk, 1) > edge(image, 3), edge(chunk, 1) - edge(image, 3) + AFTER_PENALTY).otherwise(0.0)
    return F.when(side >= LEAST_OVERLAP, gap + (1.0 - side) * SIDE_WEIGHT)


def bind_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Pictures with their nearest chunk of the page (confidence .95) and with chunks of the same procedure for which they are
    as near as any, within the chunk's height (8 to 36 points; confidence .75).

    A member stands on the anchor's side of the picture, at most 180 points away; of a picture inside a chunk it overlaps
    the picture. chunks: document, page, seq, chunk, scope, box, of positioned kinds; images: document, page, image, box."""
    c = chunks.where(boxed("box")).select("document", "page", "seq", "chunk", F.coalesce("scope", F.lit("")).alias("scope"), F.col("box").alias("cbox"))
    i = images.where(boxed("box")).select("document", "page", "image", F.col("box").alias("ibox"))
    pairs = c.join(i, ["document", "page"]).withColumn("score", layout_score("cbox", "ibox")).where("score IS NOT NULL")
    inside = (F.least(edge("cbox", 3), edge("ibox", 3)) > F.greatest(edge("cbox", 1), edge("ibox", 1)))
    side = F.when(edge("cbox", 3) <= edge("ibox", 1), "before").when(edge("cbox", 1) >= edge("ibox", 3), "after").otherwise("overlap")
    away = F.when(side == "before", edge("ibox", 1) - edge("cbox", 3)).when(side == "after", edge("cbox", 1) - edge("ibox", 3)).otherwise(0.0)
    pairs = pairs.withColumn("inside", inside).withColumn("side", side).withColumn("away", away)
    image, nearest = Window.partitionBy("document", "page", "image"), Window.partitionBy("document", "page", "image").orderBy("score", "seq")
    pairs = pairs.withColumn("n", F.row_number().over(nearest)).withColumn("embedded", F.max("inside").over(image))
    anchor = lambda x: F.max(F.when(F.col("n") == 1, F.col(x))).over(image)
    pairs = pairs.withColumn("a_scope", anchor("scope")).withColumn("a_side", anchor("side"))
    fits = F.when(F.col("embedded"), F.col("inside")).otherwise(((F.col("a_side") == "overlap") | (F.col("side") == F.col("a_side"))) & (F.col("away") <= FARTHEST))
    members = pairs.where((F.col("scope") != "") & (F.col("scope") == F.col("a_scope")) & fits)
    best = F.min("score").over(Window.partitionBy("document", "chunk"))
    tie = F.greatest(F.lit(8.0), F.least(F.lit(36.0), edge("cbox", 3) - edge("cbox", 1)))
    members = members.withColumn("best", best).where(F.col("score") <= F.col("best") + tie)
    both = pairs.where("n = 1").select("document", "image", "chunk", F.lit(0.95).alias("confidence")).unionByName(members.select("document", "image", "chunk", F.lit(0.75).alias("confidence")))
    return both.groupBy("document", "image", "chunk").agg(F.max("confidence").alias("confidence"))


def page_lines(blocks: DataFrame, tables: DataFrame, margin=70, share=0.35) -> DataFrame:
    """The text blocks of a page in reading order, without page numbers and repeated lines in its margins and without blocks
    that a table covers by ``share``.

    blocks: document, page, height, text, box; tables: document, page, box."""
    rows = blocks.where("trim(text) <> ''").withColumn("norm", F.lower(F.regexp_replace(F.trim("text"), SPACE, " ")))
    outer = (edge("box", 1) < margin) | (edge("box", 3) > F.col("height") - margin)
    rows = rows.withColumn("outer", boxed("box") & outer)
    repeated = rows.where("outer").groupBy("document", "norm").agg(F.count("*").alias("k")).where("k >= 2").select("document", "norm")
    number = F.col("outer") & F.trim("text").rlike(r"^\d+$") & ((F.trim("text") == F.col("page").cast("string")) | (F.length(F.trim("text")) <= 4))
    kept = rows.join(repeated, ["document", "norm"], "left_anti").where(~number)
    on_page = tables.where(boxed("box")).groupBy("document", "page").agg(F.collect_set("box").alias("tables"))  # a page's own tables, those of one place once
    area = (edge("box", 2) - edge("box", 0)) * (edge("box", 3) - edge("box", 1))

    def covers(t: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(edge("box", 2), F.get(t, F.lit(2))) - F.greatest(edge("box", 0), F.get(t, F.lit(0))))
        y = F.greatest(F.lit(0.0), F.least(edge("box", 3), F.get(t, F.lit(3))) - F.greatest(edge("box", 1), F.get(t, F.lit(1))))
        return x * y / area >= share

    # Each place of a page is tried once, whatever number of blocks stands there.
    places = rows.where(boxed("box")).select("document", "page", "box").distinct()
    covered = places.join(on_page, ["document", "page"]).where(F.exists("tables", covers)).select("document", "page", "box")
    free = kept.join(covered, ["document", "page", "box"], "left_anti")
    order = Window.partitionBy("document", "page").orderBy(F.coalesce(edge("box", 1), F.lit(0.0)), F.coalesce(edge("box", 0), F.lit(0.0)), "norm")
    return free.select("document", "page", F.row_number().over(order).alias("place"), F.trim("text").alias("text"))


def listing(rows: DataFrame, keyword: str | None, columns: list[str], equal: dict[str, object], order: list[Column], page=1, size=10, owner: tuple[str, object] | None = None) -> DataFrame:
    """a page of rows with the keyword in one of ``columns`` and the equal values that are given, in order; with ``owner``
    (column, value) only that user's own."""
    if keyword and keyword.strip():
        test = F.lit(False)
        for c in columns:
            test = test | F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(keyword.strip()))
        rows = rows.where(test)
    for name, value in {**equal, **(dict([owner]) if owner else {})}.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def node_hits(near: DataFrame, nodes: DataFrame, least=0.7) -> DataFrame:
    """K7: the hits of a vector search that are live nodes with a score of ``least`` or more, both tested after the top-k cut.

    near: query, doc, relevance (as of ``retrieval.knn``); nodes: node, label, status. Cases must be approved, others not deprecated."""
    live = F.when(F.col("label") == "CaseRecord", F.col("status") == "APPROVED").otherwise(F.coalesce("status", F.lit("")) != "deprecated")
    return near.where(F.col("relevance") >= least).join(nodes.where(live), F.col("doc") == F.col("node")).select("query", "node", "label", "relevance")


def fuse_candidates(candidates: DataFrame) -> DataFrame:
    """U4: section and graph candidates of a query fused first-fit, sections first: (query, place, members).

    A candidate joins the first group of its document with its section or one of its chunks, unless both have paths and none in common.
    A query's candidates are folded in order. candidates: query, seq, candidate, kind (section or graph), document, section, chunks, paths."""
    none = F.array().cast("array<string>")
    item = F.struct(
        (F.col("kind") == "graph").cast("int").alias("tier"), "seq", F.coalesce("document", F.lit("")).alias("document"), F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("chunks", none).alias("chunks"), F.coalesce("paths", none).alias("paths"), F.array(F.col("candidate").cast("string")).alias("members"))
    rows = candidates.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(groups: Column, c: Column) -> Column:
        def fits(g: Column) -> Column:
            same = ((g["section"] != "") & (g["section"] == c["section"])) | F.arrays_overlap(g["chunks"], c["chunks"])
            apart = (F.size(g["paths"]) > 0) & (F.size(c["paths"]) > 0) & ~F.arrays_overlap(g["paths"], c["paths"])
            return (g["document"] != "") & (g["document"] == c["document"]) & same & ~apart

        at = F.array_position(F.transform(groups, lambda g: F.coalesce(fits(g), F.lit(False))), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(
            g["tier"].alias("tier"), g["seq"].alias("seq"), g["document"].alias("document"), g["section"].alias("section"), F.when(c["tier"] == 1, c["chunks"]).otherwise(g["chunks"]).alias("chunks"),
            F.array_union(g["paths"], c["paths"]).alias("paths"), F.concat(g["members"], c["members"]).alias("members"))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(c)))

    out = rows.select("query", F.posexplode(F.aggregate("items", F.slice("items", 1, 0), step)).alias("place", "g"))
    return out.select("query", "place", F.col("g.members").alias("members"))


def upgrade_queue(diff: DataFrame, nodes: DataFrame) -> DataFrame:
    """What changed chunks ask for: solutions and faults whose chunks were all deleted are deprecated, those that keep one lose the
    reference, those of a modified chunk are reviewed; added chunks are to be extracted.

    diff: chunk, change (deleted, modified, added); nodes: node, chunks (array). One row per node and action, or added chunk."""
    refs = nodes.select("node", F.explode(F.array_distinct("chunks")).alias("chunk"))
    per = refs.join(diff, "chunk", "left").groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("change") == "deleted").alias("gone"), F.count_if(F.col("change") == "modified").alias("new"))
    action = F.when((F.col("gone") > 0) & (F.col("gone") == F.col("n")), "deprecate").when(F.col("new") > 0, "review").when(F.col("gone") > 0, "drop_reference")
    rows = per.select(F.col("node").cast("string").alias("target"), action.alias("action")).where("action IS NOT NULL")
    return rows.unionByName(diff.where("change = 'added'").select(F.col("chunk").cast("string").alias("target"), F.lit("extract").alias("action")))


def promoted_edges(tasks: DataFrame) -> DataFrame:
    """The graph edges that closed tasks bring, each once: device OWNS component, component CAUSES fault (of a named component),
    device HAS_FAULT fault, fault HAS_SOLUTION solution. Promoted and skipped tasks, those without a device and unnamed rows bring none.

    tasks: task, status, promoted, device, extraction (JSON of deviceName, components, faults, solutions)."""
    schema = ("deviceName string, components array<struct<name:string>>, faults array<struct<name:string,relatedComponent:string>>, solutions array<struct<title:string,relatedFault:string>>")
    rows = tasks.where("status = 'CLOSED' AND coalesce(promoted, '') NOT IN ('PROMOTED', 'SKIPPED')").withColumn("x", F.from_json("extraction", schema)).where("x IS NOT NULL")
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.withColumn("device", F.coalesce(named(F.col("x.deviceName")), named(F.col("device")))).where("device IS NOT NULL")
    rows = rows.withColumn("names", F.transform("x.components", lambda c: named(c["name"]))).withColumn("fault_names", F.transform("x.faults", lambda f: named(f["name"])))
    edge_ = lambda src, kind, dst: F.struct(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    none = F.slice(F.array(edge_(F.col("device"), "", F.col("device"))), 1, 0)
    edges = F.flatten(F.array(
        F.coalesce(F.transform("names", lambda c: edge_(F.col("device"), "OWNS", c)), none),
        F.coalesce(F.transform("x.faults", lambda f: edge_(F.when(F.array_contains(F.col("names"), named(f["relatedComponent"])), named(f["relatedComponent"])), "CAUSES", named(f["name"]))), none),
        F.coalesce(F.transform("fault_names", lambda f: edge_(F.col("device"), "HAS_FAULT", f)), none),
        F.coalesce(F.transform("x.solutions", lambda s: edge_(F.when(F.array_contains(F.col("fault_names"), named(s["relatedFault"])), named(s["relatedFault"])), "HAS_SOLUTION", named(s["title"]))), none)))
    return rows.select(F.explode(edges).alias("e")).select("e.*").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def activate_versions(callbacks: DataFrame) -> DataFrame:
    """The version of each manual that is active after parse callbacks in any order, also repeated ones: the newest that was parsed;
    an older or failed one never replaces it. callbacks: manual, document, version, status."""
    newest = callbacks.where("status = 'PARSED'").groupBy("manual").agg(F.max(F.struct("version", "document")).alias("s"))
    return newest.select("manual", F.col("s.version").alias("version"), F.col("s.document").alias("document"))
