"""From questions to recall: plans, variants, aspects, constraints, route filters and aspect support, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import bound, has_any

#: Hints of an intent, in the order in which intents are tried, with the routes and weights of each.
INTENTS = (
    ("image_identification", ("图片", "插图", "图示", "有没有图", "图中", "图里", "图上", "识别", "这是什么", "照片", "示意图", "结构图", "位置图"),
     {"image_summary_keyword": 0.14, "image_summary": 0.16, "image_vector": 0.18, "semantic": 0.03}),
    ("outline", ("目录", "章节", "大纲", "有哪些内容", "包含什么", "手册结构", "章节结构", "有哪些", "都有哪些", "都有什么", "有哪些部件", "有哪些零件",
                 "包含哪些", "包括哪些", "清单", "BOM", "零件表", "配件表", "哪些部件", "哪些零件", "什么部件", "什么零件"),
     {"semantic": 0.03, "keyword": 0.06, "table": 0.08, "table_keyword": 0.06}),
    ("evidence", ("哪里", "在哪", "位置", "插入", "插在", "放在", "装在", "装到", "朝向", "朝上", "朝下", "朝外", "对齐", "标记", "孔", "段"),
     {"semantic": 0.05, "keyword": 0.07, "step_raw": 0.05}),
    ("parameter", ("参数", "规格", "型号", "扭矩", "扭力", "力矩", "锁紧", "间隙", "标准", "数值", "多少", "单位", "压力", "压缩压力", "容量", "粘度", "质量等级", "加注",
                   "N·m", "N路m", "mm", "MPa", "kPa", "电压", "电流", "torque", "spec", "specification", "parameter", "clearance"),
     {"table": 0.18, "table_keyword": 0.12, "keyword": 0.08, "semantic": 0.02}),
    ("safety", ("注意", "注意事项", "警告", "危险", "禁止", "能不能", "能否", "可不可以", "可以吗", "切记", "务必", "防护", "小心"), {"semantic": 0.03, "keyword": 0.06}),
    ("procedure", ("怎么", "如何", "步骤", "流程", "拆", "装", "更换", "维修", "检修", "安装", "调整", "操作"), {"semantic": 0.04, "keyword": 0.07, "step_raw": 0.05}),
    ("diagnosis", ("故障", "原因", "过热", "异响", "漏油", "启动不了", "报警", "异常", "怎么回事", "排除"), {"semantic": 0.04, "keyword": 0.07}),
    ("general", (), {"semantic": 0.03, "keyword": 0.06}),
)
#: Requests for an answer without images.
NO_IMAGES = ("不需要图片", "不要图片", "无需图片", "不用图片", "别返回图片", "不要返回图片", "不要返回任何图片", "不需要图", "不要图", "无需图", "不用图", "不需要配图", "不要配图", "无需配图", "不用配图", "别配图")
#: The plans of an explicit chunk type.
BY_TYPE = {
    "table": ("parameter", {"table": 0.18, "table_keyword": 0.12, "keyword": 0.08}), "image": ("image_identification", {"image_vector": 0.18}),
    "image_summary": ("image_identification", {"image_summary": 0.16}), "outline": ("outline", {"semantic": 0.03, "keyword": 0.06}),
}
#: The chunk type that a route is filtered by.
ROUTE_TYPES = {"table": "table", "table_keyword": "table", "text": "text", "image_vector": "image", "image_summary": "image_summary", "image_summary_keyword": "image_summary", "step_raw": "step_raw"}
#: Directions and actions with their opposites, tried in this order.
DIRECTIONS = (("右", "左"), ("左", "右"))
INSTALL, REMOVE, CONNECT, CUT = ("安装", "装上", "装入", "装配"), ("拆卸", "拆下", "取下", "取出"), ("连接", "接通"), ("断开", "断电")
ACTIONS = ((INSTALL, REMOVE), (REMOVE, INSTALL), (CONNECT, CUT), (CUT, CONNECT))
QUESTION_END = r"(?:分别)?(?:是)?(?:多少|什么|哪些|怎样|怎么|如何)$"
EDGE = r"^[ ,，。;；!?！？]+|[ ,，。;；!?！？]+$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def plan(query: Column, chunk_type: Column | None = None, images: Column | None = None) -> Column:
    """C17: (intent, routes as (route, weight) in order, strict) of a question: by an explicit chunk type, else by the first intent
    with a hint, uploaded images first. A question that asks for no images has no hint at one."""
    def made(intent: str, routes: dict[str, float]) -> Column:
        pairs = F.array(*[F.struct(F.lit(r).alias("route"), F.lit(w).alias("weight")) for r, w in routes.items()])
        return F.struct(F.lit(intent).alias("intent"), pairs.alias("routes"), F.lit(intent != "general").alias("strict"))

    text = F.coalesce(query, F.lit(""))
    kind = F.coalesce(chunk_type if chunk_type is not None else F.lit(""), F.lit(""))
    out = F.when(kind == "", F.lit(None))
    for name, (intent, routes) in BY_TYPE.items():
        out = out.when(kind == name, made(intent, routes))
    out = out.when(kind != "", made("general", INTENTS[-1][2]))
    out = F.when(kind != "", out)
    for n, (intent, hints, routes) in enumerate(INTENTS[:-1]):
        found = has_any(text, hints)
        if n == 0:
            found = found & ~has_any(F.regexp_replace(text, r"\s+", ""), NO_IMAGES)
        out = out.when(found | F.coalesce(images, F.lit(False)) if n == 0 and images is not None else found, made(intent, routes))
    return out.otherwise(made("general", INTENTS[-1][2]))


def route_filters(asked: DataFrame, columns=("category", "tag", "version", "manual_type"), kept=("device_type", "document")) -> DataFrame:
    """the filters of each route of a query, as they are and relaxed. Relaxing drops ``columns`` and never ``kept``; the chunk
    type is the query's own, else the route's, else that of an outline.

    asked: query, intent, route, chunk_type and the filter columns."""
    own = F.create_map(*[x for pair in ROUTE_TYPES.items() for x in map(F.lit, pair)])
    kind = F.coalesce(F.nullif("chunk_type", F.lit("")), own[F.col("route")], F.when(F.col("intent") == "outline", "outline"))
    rows = asked.withColumn("chunk_type", kind).withColumn("relaxed", F.explode(F.array(F.lit(False), F.lit(True))))
    filters = [F.when(~F.col("relaxed"), F.nullif(c, F.lit(""))).alias(c) for c in columns] + [F.nullif(c, F.lit("")).alias(c) for c in kept]
    return rows.select("query", "route", "relaxed", "chunk_type", *filters)


def matching(filters: DataFrame, chunks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """the ready manual chunks that pass a route's filters; a filter without a value lets all pass.

    Chunks meet filters by their document where that is asked for, else by device type, so neither is compared with all."""
    return met(filters, chunks.where("record_type = 'manual' AND status = 'ready'"), columns).select("query", "route", "relaxed", "chunk")


def met(filters: DataFrame, ready: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of both sides, as ``matching`` pairs them; the filters' columns have ``f_`` before their names."""
    free = lambda c: F.col(f"f_{c}").isNull() | (F.col(f"f_{c}") == F.col(c))
    asked = filters.withColumnsRenamed({c: f"f_{c}" for c in columns})
    by_document = asked.where("f_document IS NOT NULL").join(ready, F.col("f_document") == F.col("document"))
    by_device = asked.where("f_document IS NULL").join(ready, F.col("f_device_type") == F.col("device_type"))
    both = by_document.unionByName(by_device)
    for c in columns:
        both = both.where(free(c))
    return both


def matching_summary(filters: DataFrame, chunks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``query, route, relaxed, n, first_chunk, last_chunk``: how many chunks ``matching`` finds, with the smallest and the largest.

    Filters that ask for the same are met once, by the chunks of each combination of values together, so no query meets single chunks."""
    kinds = chunks.where("record_type = 'manual' AND status = 'ready'").groupBy(*columns).agg(F.count("*").alias("n"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    wanted = [f"f_{c}" for c in columns]
    found = met(filters.select(*columns).distinct(), kinds, columns).groupBy(*wanted).agg(F.sum("n").alias("n"), F.min("first").alias("first_chunk"), F.max("last").alias("last_chunk"))
    same = F.lit(True)
    for c, f in zip(columns, wanted, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(f))
    return filters.join(found, same).select("query", "route", "relaxed", "n", "first_chunk", "last_chunk")


def outline_filter(candidates: DataFrame) -> DataFrame:
    """F8: what a query's plan keeps of its candidates. Plans of other intents lose outline chunks; an outline plan keeps outlines,
    section matches, tables and images of the matched sections, without outlines if sections were matched; a query for which
    nothing would be left keeps all.

    candidates: query, intent, chunk, chunk_type, label, routes (array), section, sections (array: the matched ones)."""
    from pyspark.sql import Window

    outline = (F.col("chunk_type") == "outline") | (F.col("label") == "outline")
    matched, inside = F.size("sections") > 0, F.array_contains("sections", F.col("section"))
    section = ~outline & F.array_contains("routes", "section_match")
    image = ~outline & F.col("chunk_type").isin("image", "image_summary") & inside
    table = ~outline & (F.col("chunk_type") == "table") & (~matched | inside)
    rows = candidates.withColumn("outline", F.coalesce(outline, F.lit(False))).withColumn("other", F.coalesce(section | image | table, F.lit(False)))
    query = Window.partitionBy("query")
    any_other, any_outline = F.max("other").over(query), F.max("outline").over(query)
    keep = (
        F.when(F.col("intent") != "outline", ~F.col("outline")).when(matched & any_other, F.col("other"))
        .when(any_outline, F.col("outline") | F.col("other")).otherwise(F.lit(True))
    )
    return rows.withColumn("keep", keep).where("keep").drop("keep", "outline", "other")


def variants(query: Column, component: Column, fault: Column, action: Column, fields: Column, aspects: Column, most=4) -> Column:
    """Up to ``most`` distinct (text, source) views of a question: itself, component and fault, component with action and
    requested fields, aspects. Parts that the question does not contain are left out."""
    view = lambda t, source: F.struct(t.alias("text"), F.lit(source).alias("source"))
    joined = lambda *p: F.array_join(F.array_distinct(F.array_compact(F.concat(*p))), " ")
    strings = lambda v: F.coalesce(v, F.array().cast("array<string>"))

    def parts(text: Column, low: Column) -> Column:
        said = lambda v: F.when(F.contains(low, F.lower(F.trim(v))) & (F.trim(v) != ""), F.trim(v))
        of = lambda v: F.array_compact(F.transform(strings(v), said))
        return F.struct(text.alias("text"), said(component).alias("c"), said(fault).alias("f"), said(action).alias("a"), of(fields).alias("named"), of(aspects).alias("aspects"))

    def made(p: Column) -> Column:
        none = F.slice(F.array(view(p["text"], "")), 1, 0)
        c, f, a, named = F.array(p["c"]), F.array(p["f"]), F.array(p["a"]), p["named"]
        return F.concat(
            F.array(view(p["text"], "original")), F.when(p["c"].isNotNull() & p["f"].isNotNull(), F.array(view(joined(c, f), "component_fault"))).otherwise(none),
            F.when(p["c"].isNotNull() & (p["a"].isNotNull() | (F.size(named) > 0)), F.array(view(joined(c, a, named), "component_action"))).otherwise(none),
            F.transform(p["aspects"], lambda x: view(x, "aspect")),
        )

    def once(views: Column, lows: Column) -> Column:
        return F.filter(views, lambda v, i: (v["text"] != "") & (F.array_position(lows, lows[i]) == i + 1))

    asked = bound(F.trim(F.coalesce(query, F.lit(""))), lambda text: bound(F.lower(text), lambda low: parts(text, low)))
    views = bound(bound(asked, made), lambda v: bound(F.transform(v, lambda x: F.lower(x["text"])), lambda lows: once(v, lows)))
    return F.slice(views, 1, most)  # an empty question contains no part


def compact(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, "")


def canonical_aspect(text: Column) -> Column:
    """An aspect without its question words."""
    text = F.regexp_replace(F.lower(F.trim(text)), QUESTION_END, "")
    return compact(F.regexp_replace(text, r"(?:吗|呢|么)$", ""))


def aspects(query: Column) -> Column:
    """The distinct (aspect, text) parts of a compound question; "respectively" parts are parts of their own, and parts after
    the first take over its leading place."""
    clean = lambda t: F.regexp_replace(t, EDGE, "")
    segments = F.filter(F.transform(F.split(F.trim(F.coalesce(query, F.lit(""))), "[?？;；]+"), clean), lambda s: s != "")

    def respectively(s: Column) -> Column:
        stem = F.trim(F.regexp_replace(F.replace(s, F.lit("分别"), F.lit("")), QUESTION_END, ""))
        parts = F.filter(F.transform(F.split(stem, "和|以及"), lambda p: F.trim(p)), lambda p: p != "")
        return F.when(F.contains(s, F.lit("分别")) & (F.size(parts) > 1), parts).otherwise(F.array(s))

    parts = F.flatten(F.transform(segments, respectively))
    place = F.regexp_extract(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"^(.+?(?:里|中|内))", 1)
    full = F.transform(parts, lambda p, i: clean(F.when((i > 0) & ~p.startswith(place), F.concat(place, p)).otherwise(p)))
    keys = F.transform(full, canonical_aspect)
    once = F.filter(full, lambda p, i: (canonical_aspect(p) != "") & (F.array_position(keys, canonical_aspect(p)) == i + 1))
    return F.transform(once, lambda p: F.struct(F.concat(F.lit("aspect-"), F.left(F.sha2(F.encode(canonical_aspect(p), "UTF-8"), 256), F.lit(16))).alias("aspect"), p.alias("text")))


def constraint_conflicts(query: Column, title: Column, body: Column) -> Column:
    """Directions and actions that a candidate has the opposite of, and not the one asked for."""
    kept = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^0-9a-z一-鿿]+", "")
    q, found = kept(query), F.concat(kept(title), kept(body))
    has, says = (lambda w: F.contains(q, F.lit(w))), (lambda w: F.contains(found, F.lit(w)))
    out, done = [], F.lit(False)
    for want, other in DIRECTIONS:
        here = ~done & has(want) & ~has(other)
        out.append(F.when(here & says(other) & ~says(want), f"direction:{want}->{other}"))
        done = done | has(want)
    done = F.lit(False)
    for want, other in ACTIONS:
        asked, opposite = has_any(q, want), has_any(q, other)
        first = F.when(says(other[0]), other[0])
        for o in other[1:]:
            first = first.when(says(o), o)
        out.append(F.when(~done & asked & ~opposite & ~says(want[0]), F.concat(F.lit(f"action:{want[0]}->"), first)))
        done = done | asked
    return F.array_compact(F.array(*out))


def aspect_support(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each aspect with the evidence of its query that supports it: one contains the other, or, for an aspect of one term,
    four of its 2-grams and 60% of them; of several terms two at least must be met, as they are or by 60% of their 2-grams.

    asked: query, aspect, text; evidence: query, evidence, text. An aspect without evidence has none and stays."""
    grams = lambda t: F.array_distinct(F.transform(F.when(F.length(t) > 1, F.sequence(F.lit(1), F.length(t) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(t, i, F.lit(2))))
    terms = F.filter(F.transform(F.split("text", r"[\s,，、/|;；]+"), compact), lambda t: t != "")
    rows = asked.select("query", "aspect", canonical_aspect(F.col("text")).alias("a"), terms.alias("terms")).withColumn("grams", grams(F.col("a")))
    given = evidence.select("query", "evidence", compact(F.col("text")).alias("c"))
    hits = lambda g, c: F.size(F.filter(g, lambda x: F.contains(c, x)))
    c, n = F.col("c"), F.size("grams")
    one = (n >= 4) & (hits(F.col("grams"), c) >= 4) & (hits(F.col("grams"), c) >= 0.6 * n)
    met = lambda t: F.contains(c, t) | (F.length(t) >= 4) & (hits(grams(t), c) >= 0.6 * F.size(grams(t)))
    several = F.size(F.filter("terms", met)) >= 2
    same = (F.col("a") != "") & (c != "") & (F.contains(c, F.col("a")) | F.contains(F.col("a"), c) | F.when(F.size("terms") <= 1, one).otherwise(several))
    found = rows.join(given, "query").where(same).groupBy("query", "aspect").agg(F.array_join(F.array_sort(F.collect_set(F.col("evidence").cast("string"))), ",").alias("evidence"))
    out = asked.select("query", "aspect").join(found, ["query", "aspect"], "left")
    return out.select("query", "aspect", F.col("evidence").isNotNull().alias("supported"), F.coalesce("evidence", F.lit("")).alias("evidence"))
