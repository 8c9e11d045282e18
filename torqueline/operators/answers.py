"""Answers and their evidence: facts, phrases, order, pictures, keys, claims, warnings and frozen cases."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import all_of, bound

#: Words of refusals and denials, units, and characters and words without meaning of their own.
REFUSALS = ("未找到", "没有找到", "未检索到", "资料不足", "依据不足", "未提供", "没有提供", "无法确定", "无法回答", "不能确定", "不在资料", "不在手册", "no relevant", "not found",
            "does not provide", "not provide", "insufficient", "cannot determine")
DENIALS = ("未提及", "未说明", "未明确说明", "未提供", "没有提及", "没有说明", "没有提供", "不含", "无法确定", "不能确定", "手册未", "资料未")
UNITS = ("mm", "cm", "m", "n·m", "n.m", "nm", "mpa", "kpa", "pa", "v", "a", "kg", "g", "ml", "l", "rpm", "°c", "℃")
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "by", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with")
STOP_CHARS = "的是了和与及或在时后前中内外应需要将用把对其该此为并按如果有被若则必须"
#: Dangers, with the words that bring them up and those that a warning must have.
DANGERS = (
    ("高压电气安全", ("电压", "千伏", "kV", "通电", "电线", "电缆", "配电", "高压", "触电"), ("断电", "验电")),
    ("高温防护", ("排气", "冷却液", "高温", "过热", "涡轮", "锅炉", "蒸汽", "排气管"), ("冷却", "降温", "防烫")),
    ("化学品防护", ("润滑油", "冷却液", "制动液", "溶剂", "清洗剂", "防冻液", "液压油", "机油", "燃油", "柴油", "汽油"), ("防护手套", "护目镜", "手套", "通风")),
    ("重物吊装", ("吊装", "拆卸发动机", "变速箱", "起吊", "起重", "吊车", "千斤顶", "举升"), ("起吊设备", "人员配合", "支撑", "固定")),
    ("旋转部件防护", ("皮带", "齿轮", "风扇", "飞轮", "传动轴", "联轴器", "转子", "叶轮"), ("停机", "断电", "防护罩")),
    ("压力容器/管路安全", ("气压", "液压", "压力容器", "气瓶", "压缩机", "高压油管", "蓄能器"), ("泄压", "减压", "释放")),
    ("电池/电源安全", ("电池", "电瓶", "蓄电池", "锂电池", "充电"), ("断开", "短路", "绝缘")),
)
#: What a request for work looks like, and literals that evidence must hold.
REQUESTS = (
    r"(怎么|如何|怎样|帮我|给我|需要|要不要|能不能).{0,12}(拆|拆卸|装|安装|更换|换|维修|检修|修理|保养|诊断|排查|测量|调整|调节|清洗|处理)",
    r"(拆卸|安装|更换|检修|维修|保养|诊断|排查|测量|调整|调节|清洗).{0,8}(步骤|流程|方法|教程|怎么做|怎么弄)",
    r"(操作步骤|维修步骤|安装步骤|拆卸步骤|更换步骤|检修流程|标准作业|作业指引)", r"(扭矩|力矩|通电|断电|泄压|冷却|高压线).{0,12}(怎么|如何|步骤|操作|检查|测量|拆|装|换)",
)
MEASUREMENT = r"(?i)\d[\d,]*(?:\.\d+)?(?:/\d+(?:\.\d+)?)?\s*(?:(?:[～~\-–—]|±)\s*\d+(?:\.\d+)?)?\s*(?:N\s*[·.]?\s*m|N|mm|cm|km|公里|个月|月|小时|分钟|秒|h|min|℃|°[CF]?|MPa|kPa|V|%|整?圈)"
MODEL = r"(?i)(?:[A-Z]{2,}\s+)?[A-Z]+\d[A-Z0-9-]*(?:-[A-Z0-9-]+)?"
PRECAUTIONS = ("断开负极", "断开蓄电池", "切断电源", "断电", "验电", "泄压", "停止运行", "停机", "禁止启动", "佩戴护目镜", "佩戴防护手套")
FAULT_PAIR = (r"(?:^|\n)\s*(?:\d+[.、]|-|\*)\s*([^：:。\n]{3,30}?(?:故障|失效|损坏|断裂|磨损|过热|过载|短路|泄漏|异响|振动|腐蚀))[：:，,\s]*"
              r"([^。\n]{5,50}?(?:更换|维修|修复|清洗|润滑|紧固|调整|校准|替换|加注|拆卸|检查))")
NUMBER = r"\d+(?:\.\d+)?"


def any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# Facts


def plain(text: Column) -> Column:
    """Lower case, ASCII punctuation and single blanks."""
    text = F.translate(F.lower(F.coalesce(text, F.lit(""))), "～—–－Ｎｍ．，。：；（）", "----nm.,.:;()")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def units_in(text: Column) -> Column:
    short = F.replace(plain(text), F.lit(" "))
    return F.array_compact(F.array(*[F.when(F.contains(short, F.lit(u)), u) for u in UNITS]))


def meaning(text: Column) -> Column:
    """The distinct Latin tokens, Han characters and pairs of neighbouring Han characters that say something."""
    text = plain(text)
    words = F.filter(all_of(text, "[a-z0-9]+"), lambda w: ~w.isin(*STOP_WORDS))
    han = F.regexp_replace(text, f"[^一-鿿]|[{STOP_CHARS}]", "")
    chars = F.filter(F.split(han, ""), lambda c: c != "")
    pairs = F.transform(F.when(F.length(han) > 1, F.sequence(F.lit(1), F.length(han) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(han, i, F.lit(2)))
    return F.array_distinct(F.concat(words, chars, pairs))


def share_of(terms: Column, other: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, other)) / F.size(terms)).otherwise(F.lit(0.0))


def fact_matched(fact: Column, answer: Column) -> Column:
    """A fact stands in an answer as it is; by all its numbers and one of its units; or by three quarters of its terms."""
    f, a = plain(fact), plain(answer)
    numbers, units = all_of(f, NUMBER), units_in(fact)
    numeric = (F.size(F.array_except(numbers, all_of(a, NUMBER))) == 0) & ((F.size(units) == 0) | F.arrays_overlap(units, units_in(answer)))
    pressure = F.contains(f, F.lit("压力")) & F.contains(f, F.lit("升高")) & F.contains(a, F.lit("压力")) & F.contains(a, F.lit("高"))
    return (f == "") | F.contains(a, f) | pressure | F.when(F.size(numbers) > 0, numeric).otherwise(share_of(meaning(fact), meaning(answer)) >= 0.75)


def answer_score(answer: Column, answerable: Column, facts: Column, golden: Column) -> Column:
    """1, .5 or 0. A question without an answer wants a refusal; else all or some of the facts; else the numbers and a unit
    of the golden answer; else three quarters or 35% of its terms."""
    n_facts = F.size(facts)
    met = F.size(F.filter(facts, lambda f: fact_matched(f, answer)))
    numbers = all_of(plain(golden), NUMBER)
    n_met = F.size(F.filter(numbers, lambda x: F.array_contains(all_of(plain(answer), NUMBER), x)))
    unit = (F.size(units_in(golden)) == 0) | F.arrays_overlap(units_in(golden), units_in(answer))
    share = share_of(meaning(golden), meaning(answer))
    three = lambda full, half: F.when(full, 1.0).when(half, 0.5).otherwise(0.0)
    return (
        F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", 0.0).when(~answerable, three(any_in(plain(answer), REFUSALS), F.lit(False)))
        .when(n_facts > 0, three(met == n_facts, met > 0)).when(F.trim(F.coalesce(golden, F.lit(""))) == "", 0.0)
        .when(F.size(numbers) > 0, three((n_met == F.size(numbers)) & unit, n_met > 0)).otherwise(three(share >= 0.75, share >= 0.35))
    )


def failure_type(score: Column, answerable: Column, has_gold: Column, hit: Column, hallucinated: Column) -> Column:
    """Why a case failed; ``pass`` if it did not."""
    return (
        F.when((score >= 1) & (hit | ~answerable | ~has_gold), "pass").when(~answerable & hallucinated, "no_answer_false_positive").when((score >= 1) & ~hit, "retrieval_miss_answer_correct")
        .when(answerable & ~hit, "retrieval_miss").when(score == 0.5, "partial_answer").otherwise("answer_mismatch")
    )


# Phrases and order


def phrase(text: Column) -> Column:
    """Without case, blanks, punctuation and filler words."""
    text = F.translate(F.lower(F.coalesce(text, F.lit(""))), "～—–×", "---x")
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("℃"), F.lit("°c")), r"\s+", ""), "[，。；：、,.;:()\\[\\]（）【】“”\"'`|=]", "")
    return F.regexp_replace(F.regexp_replace(text, r"φ(\d+)个(\d+)", "$1个φ$2"), "包括|包含|分别", "")


def han_of(text: Column) -> Column:
    return F.array_distinct(all_of(text, "[一-鿿]"))


def phrase_matched(wanted: Column, answer: Column) -> Column:
    """A phrase stands in an answer as it is; as "first x then y" in that order; or with all its numbers and 80% of its Han
    characters, if it has four of them."""
    w, a = phrase(wanted), phrase(answer)
    x, y = F.regexp_extract(w, "^先(.*?)再(.*)$", 1), F.regexp_extract(w, "^先(.*?)再(.*)$", 2)
    at = F.position(x, a)
    ordered = (x != "") & (y != "") & (at > 0) & (F.position(y, a, at + F.length(x)) > 0)
    numbers = F.forall(all_of(w, NUMBER), lambda n: F.contains(a, n))
    han = han_of(w)
    overlap = F.size(F.filter(han, lambda c: F.contains(a, c))) >= 0.8 * F.size(han)
    return (w == "") | F.contains(a, w) | ordered | numbers & (F.size(all_of(w, "[一-鿿]")) >= 4) & overlap


def forbidden_matched(claim: Column, answer: Column) -> Column:
    """A forbidden claim stands in an answer, not denied in the 16 characters before it; claims of fewer than four Han
    characters without a digit or letter say nothing."""
    w, a = phrase(claim), phrase(answer)
    generic = ~w.rlike("[0-9a-z]") & (F.size(all_of(w, "[一-鿿]")) < 4)
    at = F.position(w, a)
    before = F.substr(a, F.greatest(at - 16, F.lit(1)), F.least(at - 1, F.lit(16)))
    return (w != "") & ~generic & (at > 0) & ~any_in(before, DENIALS)


def in_order(snippets: Column, answer: Column) -> Column:
    """Whether every snippet stands in the answer after the one before it, and how many do: (passed, met).

    A snippet of six characters, four of them Han, may also stand with others between its own, over 1.6 times its length or
    eight characters more."""
    a = phrase(answer)
    begin = F.struct(F.lit(1).alias("at"), F.lit(0).alias("met"), F.lit(True).alias("passed"))

    def loose(w: Column) -> Column:
        """The places (begin, end) of the first spread-out occurrence from ``at`` on, as a regular expression."""
        return F.array_join(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "(?s:.*?)")

    def step(acc: Column, w: Column) -> Column:
        exact = F.position(w, a, acc["at"])
        spread = F.when((F.length(w) >= 6) & (F.size(all_of(w, "[一-鿿]")) >= 4), F.coalesce(F.regexp_substr(F.substr(a, acc["at"]), loose(w)), F.lit(""))).otherwise(F.lit(""))
        near = (spread != "") & (F.length(spread) <= F.greatest(F.length(w) + 8, F.floor(F.length(w) * 1.6)))
        at = F.when(exact > 0, exact).when(near, F.position(spread, a, acc["at"])).otherwise(0)
        met = F.struct((at + F.length(w)).cast("int").alias("at"), (acc["met"] + 1).alias("met"), F.lit(True).alias("passed"))
        lost = F.struct(acc["at"].alias("at"), acc["met"].alias("met"), F.lit(False).alias("passed"))
        return F.when(~acc["passed"], acc).when(at > 0, met).otherwise(lost)

    wanted = F.filter(F.transform(snippets, phrase), lambda w: w != "")
    return F.aggregate(wanted, begin, step, lambda acc: F.struct(acc["passed"].alias("passed"), acc["met"].alias("met")))


# Pictures and evidence keys


def picture_check(expected: Column, order: Column, forbidden: Column, found: Column) -> Column:
    """(required, recall, precision, forbidden_pass, order_pass, passed) of the pages of an answer's pictures.

    All are arrays of pages; a page counts once, where it stands first. Without expected pages nothing should be found."""
    none = F.array().cast("array<long>")
    wanted, banned, seen = (F.array_distinct(F.coalesce(c.cast("array<long>"), none)) for c in (expected, forbidden, found))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(F.array_distinct(F.coalesce(order.cast("array<long>"), none)))
    both = F.size(F.array_intersect(wanted, seen))
    empty = F.when(F.size(seen) == 0, 1.0).otherwise(0.0)
    recall = F.when(F.size(wanted) > 0, both / F.size(wanted)).otherwise(empty)
    precision = F.when(F.size(wanted) == 0, empty).when(F.size(seen) > 0, both / F.size(seen)).otherwise(0.0)
    clean = ~F.arrays_overlap(seen, banned)
    line = F.when(F.size(F.coalesce(order.cast("array<long>"), none)) > 0, order.cast("array<long>")).otherwise(wanted)
    ordered = (F.size(line) == 0) | (F.filter(seen, lambda p: F.array_contains(line, p)) == line)
    required = (F.size(wanted) > 0) | (F.size(banned) > 0)
    passed = ~required | (recall >= 1) & (precision >= 1) & clean & ordered
    return F.struct(required.alias("required"), F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), clean.alias("forbidden_pass"), ordered.alias("order_pass"), passed.alias("passed"))


def picture_counts(expected_ids: Column, expected_pages: Column, forbidden: Column, ids: Column, pages: Column, low: Column, high: Column) -> Column:
    """(recall, precision, count_pass, forbidden_pass) of found pictures by their ids where some are expected, else by pages; both are 1 where
    nothing is. The number found lies between ``low`` and ``high``, where they are given."""
    none = F.array().cast("array<string>")
    want_ids, want_pages, banned, got_ids, got_pages = (F.array_distinct(F.coalesce(c.cast("array<string>"), none)) for c in (expected_ids, expected_pages, forbidden, ids, pages))
    by_id = F.size(want_ids) > 0
    wanted, got = F.when(by_id, want_ids).otherwise(want_pages), F.when(by_id, got_ids).otherwise(got_pages)
    both = F.size(F.array_intersect(wanted, got))
    recall = F.when(F.size(wanted) > 0, both / F.size(wanted)).otherwise(1.0)
    precision = F.when(F.size(wanted) == 0, 1.0).when(F.size(got) > 0, both / F.size(got)).otherwise(0.0)
    counted = F.coalesce(F.size(got) >= low, F.lit(True)) & F.coalesce(F.size(got) <= high, F.lit(True))
    return F.struct(F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), counted.alias("count_pass"), (~F.arrays_overlap(got_pages, banned)).alias("forbidden_pass"))


def step_pictures(steps: Column, answer: Column, pages: Column) -> Column:
    """The steps that fail: whose text the answer does not have, or whose picture was not found; (step, page, reason) of each, in order.

    steps: array of (step, page); a step without text or page only needs the other."""
    seen = F.coalesce(pages.cast("array<long>"), F.array().cast("array<long>"))
    failure = lambda s, why: F.named_struct(F.lit("step"), F.trim(F.coalesce(s["step"], F.lit(""))), F.lit("page"), s["page"].cast("long"), F.lit("reason"), F.lit(why))
    missing = lambda s: F.when((F.trim(F.coalesce(s["step"], F.lit(""))) != "") & ~phrase_matched(s["step"], answer), failure(s, "step"))
    unseen = lambda s: F.when(s["page"].isNotNull() & ~F.array_contains(seen, s["page"].cast("long")), failure(s, "page"))
    return F.array_compact(F.flatten(F.transform(steps, lambda s: F.array(missing(s), unseen(s)))))


def evidence_keys(items: DataFrame) -> DataFrame:
    """The keys that an item answers to, in order: itself, id, id tail, anchor, parent, and section with type or label and page.

    items: query, rank, chunk, anchor, parent, section, kind, label, page."""
    given = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    with_ = lambda p, v: F.when(v.startswith(p + ":"), v).otherwise(F.concat(F.lit(p + ":"), v))
    tail = F.when(F.contains(given("chunk"), F.lit(":")), F.nullif(F.regexp_replace(given("chunk"), "^[^:]*:", ""), F.lit("")))
    placed = lambda c: F.concat(given("section"), F.lit("|"), given(c), F.lit("|"), given("page"))
    keys = F.array_distinct(F.array_compact(F.array(
        given("chunk"), with_("id", given("chunk")), with_("id_tail", tail), with_("anchor", given("anchor")), with_("parent", given("parent")),
        with_("section_page_type", placed("kind")), with_("section_page_label", placed("label")))))
    return items.select("query", "rank", F.posexplode(keys).alias("n", "key"))


def first_hit(items: DataFrame, golden: DataFrame) -> DataFrame:
    """The first rank with a golden key and that key: explicit keys first, then ids, each also as id and by its tail.

    golden: query, key, explicit."""
    keys = evidence_keys(items)
    ids = golden.where("NOT explicit AND trim(key) <> ''")
    forms = F.array_compact(F.array("key", F.concat(F.lit("id:"), "key"), F.when(F.contains("key", F.lit(":")), F.concat(F.lit("id_tail:"), F.regexp_replace("key", "^[^:]*:", "")))))
    wide = ids.select("query", F.explode(forms).alias("key")).unionByName(golden.where("explicit").select("query", "key")).select("query", "key", F.lit(1).alias("tier"))
    own = golden.where("explicit").select("query", "key", F.lit(0).alias("tier"))
    found = keys.join(wide.unionByName(own).distinct(), ["query", "key"]).groupBy("query").agg(F.min(F.struct("tier", "rank", "n", "key")).alias("s"))
    return golden.select("query").distinct().join(found, "query", "left").select("query", F.col("s.rank").alias("rank"), F.coalesce("s.key", F.lit("")).alias("key"))


def ledger(entries: DataFrame) -> DataFrame:
    """Evidence once by id, in the order of arrival: the first entry, of manual ones the preferred (a raw step, then most
    structural fields, then the first), with a digest of each scope's ledger. Entries without an id or known source go.

    entries: scope, seq, evidence, source, raw, filled, body."""
    known = entries.where(F.col("source").isin("manual", "domain_rule", "graph") & (F.trim("evidence") != ""))
    of_id = Window.partitionBy("scope", "evidence")
    rows = known.withColumn("first", F.min(F.struct("seq", "source")).over(of_id)).where(
        (F.col("seq") == F.col("first.seq")) | (F.col("first.source") == "manual") & (F.col("source") == "manual"))
    best = of_id.orderBy(F.desc("raw"), F.desc("filled"), "seq")
    one = rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("scope", F.col("first.seq").alias("place"), "evidence", "source", "body")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence", "source", "body"))), lambda e: F.concat_ws("\u001f", e["evidence"], e["source"], e["body"]))
    return one.groupBy("scope").agg(F.count("*").alias("n"), F.sha2(F.encode(F.array_join(listed, "\u001e"), "UTF-8"), 256).alias("digest"))  # a scope's own evidence


# Claims, warnings and pairs


def literals(claim: Column) -> Column:
    """What evidence of a claim must hold word for word: measurements, models and precautions, without case and blanks."""
    squeezed = lambda t: F.lower(F.regexp_replace(t, r"\s+", ""))
    words = F.filter(F.array(*map(F.lit, PRECAUTIONS)), lambda w: F.contains(claim, w))
    return F.array_distinct(F.transform(F.concat(all_of(claim, MEASUREMENT), all_of(claim, MODEL), words), squeezed))


def grounded(claims: DataFrame, evidence: DataFrame, least=0.35) -> DataFrame:
    """``query, claim, n_literals, unmatched, similarity, verified``: a claim with literals is verified if evidence of its query
    holds each of them, one without if its vector is as near as ``least`` to one of the evidence, by cosine.

    ``similarity`` is the largest cosine of a claim without literals, 0 without evidence, with four decimals; vectors that are null
    or zero have none. claims: query, claim, text, vec; evidence: query, text, vec; of one query there are few of both."""
    squeezed = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    given = F.col("vec").cast("array<double>")
    vec = bound(F.nullif(F.sqrt(dot(given, given)), F.lit(0.0)), lambda norm: F.transform(given, lambda x: x / norm))
    # A row for each literal, or one with the vector of a claim without.
    rows = claims.select("query", "claim", "vec", literals(F.col("text")).alias("literals")).withColumn("n", F.size("literals"))
    rows = rows.select("query", "claim", "n", F.explode_outer("literals").alias("literal"), F.when(F.col("n") == 0, vec).alias("own"))
    pairs = rows.join(evidence.select("query", squeezed.alias("body"), vec.alias("vec")), "query", "left")
    cosine = F.when(F.size("own") == F.size("vec"), dot(F.col("own"), F.col("vec")))
    best = F.max(F.nullif(cosine, F.lit(float("nan"))))
    each = pairs.groupBy("query", "claim", "n", "literal").agg(F.max(F.contains("body", F.col("literal"))).alias("held"), best.alias("similarity"))
    lacks = F.when(~F.coalesce("held", F.lit(False)), F.col("literal"))
    out = each.groupBy("query", "claim", "n").agg(F.array_sort(F.collect_list(lacks)).alias("unmatched"), F.max("similarity").alias("similarity"))
    similarity = F.when(F.col("n") == 0, F.coalesce("similarity", F.lit(0.0)))
    verified = F.when(F.col("n") > 0, F.size("unmatched") == 0).otherwise(F.coalesce(F.col("similarity") >= least, F.lit(False)))
    return out.select("query", "claim", F.col("n").cast("long").alias("n_literals"), "unmatched", F.round(similarity, 4).alias("similarity"), verified.alias("verified"))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def danger_audit(query: Column, answer: Column, most=2) -> Column:
    """C20: (triggered, missing) dangers of an answer to a request for work; ``missing`` are up to ``most`` with a warning that
    lacks a word."""
    asked = F.lit(False)
    for pattern in REQUESTS:
        asked = asked | query.rlike(pattern)
    seen = F.array_compact(F.array(*[F.when(any_in(answer, words), name) for name, words, _ in DANGERS]))
    lacks = F.array_compact(F.array(*[F.when(any_in(answer, words) & ~F.forall(F.array(*map(F.lit, needed)), lambda w: F.contains(answer, w)), name) for name, words, needed in DANGERS]))
    none = F.array().cast("array<string>")
    return F.struct(F.when(asked, seen).otherwise(none).alias("triggered"), F.when(asked, F.slice(lacks, 1, most)).otherwise(none).alias("missing"))


def fault_pairs(answer: Column) -> Column:
    """The distinct (fault, solution) pairs of an answer's list items."""
    faults, ways = (F.regexp_extract_all(answer, F.lit(FAULT_PAIR), i) for i in (1, 2))
    pairs = F.zip_with(faults, ways, lambda f, s: F.struct(F.trim(f).alias("fault"), F.trim(s).alias("solution")))
    return F.array_distinct(F.filter(pairs, lambda p: (F.length(p["fault"]) >= 2) & (F.length(p["solution"]) >= 2)))


# Frozen cases and gates


def freeze_issues(cases: DataFrame) -> DataFrame:
    """What keeps cases from being frozen: (case, code) of missing or repeated ids, fewer than three distinct people, open
    reviews and leaks. cases: case, author, reviewer_a, reviewer_b, status, leaked."""
    people = F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in ("author", "reviewer_a", "reviewer_b")]))
    n = F.count("*").over(Window.partitionBy(F.trim("case")))
    rows = cases.withColumn("n", n)
    codes = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("case"), F.lit("")) == "", "missing_case_id").when(F.col("n") > 1, "duplicate_case_id"), F.when(F.size(F.array_distinct(people)) < 3, "reviewers_not_distinct"),
        F.when(F.coalesce("status", F.lit("")) != "resolved", "not_resolved"), F.when(F.coalesce("leaked", F.lit(False)), "leaked")))
    return rows.select("case", F.explode(codes).alias("code"))


#: Fields of a case that hold its answer or the review, and those that describe it; a question alone has none of them.
GOLD = ("gold_answer", "golden_answer", "gold_evidence", "qrels", "required_nuggets", "optional_nuggets", "forbidden_claims", "expected_step_order", "expected_images", "expected_image_order",
        "step_image_mapping", "forbidden_images", "claim_constraints", "conflict_constraints", "answerable", "author_id", "reviewer_a_id", "reviewer_b_id", "review_status", "review_notes")
ABOUT = ("schema_version", "split", "question_type", "graph_dependency", "difficulty", "question_origin", "target_section", "target_pages", "expected_scope", "expected_coverage_status", "source_request_mode",
         "source_document", "document_id", "document_version", "group", "task_type", "trap_type", "claim_constraint_count", "has_forbidden_without_evidence")


def frozen_parts(cases: DataFrame) -> dict[str, DataFrame]:
    """What a frozen set consists of: questions without any field that gives an answer away, answers, relevant evidence, sign-offs and the
    whole cases to score by. cases: case_id, and of the fields in ``GOLD`` and ``ABOUT`` those that there are."""
    given = lambda *names: cases.select("case_id", *[F.col(c) if c in cases.columns else F.lit(None).cast("string").alias(c) for c in names])
    return {
        "questions": cases.drop(*GOLD, *ABOUT), "gold": given("gold_answer"), "qrels": given("gold_evidence"),
        "review_signoff": given("author_id", "reviewer_a_id", "reviewer_b_id", "review_status"), "scoring_cases": cases,
    }


def golden_cases(owns: DataFrame, procedures: DataFrame, solutions: DataFrame) -> DataFrame:
    """Two recall cases of each device's component, with and without the device's name, that expect the component and its
    first three solutions, procedures first. owns: device, component; procedures, solutions: component, solution."""
    both = procedures.withColumn("tier", F.lit(0)).unionByName(solutions.withColumn("tier", F.lit(1))).where("solution IS NOT NULL").groupBy("component", "solution").agg(F.min("tier").alias("tier"))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy("tier", "solution"))).where("n <= 3")
    known = first.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "solution"))), lambda s: s["solution"]), ",").alias("expected"))
    rows = owns.distinct().join(known, "component", "left")
    kinds = F.explode(F.array(F.lit("recall_with_device"), F.lit("recall_no_device"))).alias("case_type")
    rows = rows.select("device", "component", F.coalesce("expected", F.lit("")).alias("expected"), kinds)
    return rows.withColumn("keyword", F.when(F.col("case_type") == "recall_with_device", F.col("device")).otherwise(""))


def mechanism_gate(turns: DataFrame, zero: dict[str, list[str]], required_variant: str, required: list[str]) -> DataFrame:
    """Per check its status, turns, failed turns: the ``zero`` counters of a variant must all be 0, the ``required`` ones of
    the required cases above 0, with a graph id among the bindings; a check without a turn does not apply.

    turns: variant, dependency, bindings (JSON array of {emitted, evidence_ids}) and the counters."""
    ids = F.from_json(F.coalesce("bindings", F.lit("[]")), "array<struct<emitted:boolean,evidence_ids:array<string>>>")
    bound = F.exists(F.coalesce(ids, F.from_json(F.lit("[]"), "array<struct<emitted:boolean,evidence_ids:array<string>>>")), lambda b: F.coalesce(b["emitted"], F.lit(True)) & F.exists(F.coalesce(b["evidence_ids"], F.array().cast("array<string>")), lambda e: e.startswith("graph:")))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    checks = []
    for variant, counters in zero.items():
        bad = F.lit(False)
        for c in counters:
            bad = bad | (value(c) != 0)
        checks.append(turns.where(F.col("variant") == variant).select(F.lit(f"{variant}_zero_activity").alias("check"), bad.alias("bad")))
    lacks = ~bound
    for c in required:
        lacks = lacks | (value(c) <= 0)
    wanted = (F.col("variant") == required_variant) & (F.lower(F.trim("dependency")) == "required")
    checks.append(turns.where(wanted).select(F.lit(f"{required_variant}_required_chain").alias("check"), lacks.alias("bad")))
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    out = rows.groupBy("check").agg(F.count("*").alias("turns"), F.count_if("bad").alias("failed"))
    names = turns.sparkSession.createDataFrame([(f"{v}_zero_activity",) for v in zero] + [(f"{required_variant}_required_chain",)], "check string")
    out = names.join(out, "check", "left").select("check", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("failed", F.lit(0)).alias("failed"))
    return out.withColumn("status", F.when(F.col("turns") == 0, "not_applicable").when(F.col("failed") > 0, "failed").otherwise("passed"))


def claim_sources(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that a claim allows: a manual by document, version, page range and any chunk; a graph path by all chunk and
    node ids; a rule by id and status.

    claims: claim, query, source, document, version, page_from, page_to, chunks, nodes, rule, status; evidence: query, evidence, source
    and the same with ``page``."""
    theirs = evidence.select("query", "evidence", "source", *[F.col(c).alias(f"e_{c}") for c in ("document", "version", "page", "chunks", "nodes", "rule", "status")])
    free = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    fits = lambda c: free(c) | (F.col(c) == F.col(f"e_{c}"))
    none = F.array().cast("array<string>")
    chunks, nodes = F.coalesce("chunks", none), F.coalesce("nodes", none)
    page = F.col("page_from").isNull() | F.col("e_page").between(F.col("page_from"), F.coalesce("page_to", "page_from"))
    manual = fits("document") & fits("version") & page & ((F.size(chunks) == 0) | F.arrays_overlap(chunks, F.coalesce("e_chunks", none)))
    graph = (F.size(F.array_except(chunks, F.coalesce("e_chunks", none))) == 0) & (F.size(F.array_except(nodes, F.coalesce("e_nodes", none))) == 0)
    rule = fits("rule") & fits("status")
    ok = F.when(F.col("source") == "manual", manual).when(F.col("source") == "graph", graph).when(F.col("source") == "rule", rule)
    return claims.join(theirs, ["query", "source"]).where(F.coalesce(ok, F.lit(False))).select("claim", "evidence")


def refresh_gold(golden: DataFrame, paths: DataFrame) -> DataFrame:
    """The one path that each graph gold source now stands for, the exact fault name first; else why there is none.

    golden: gold, component, fault, document, version, device; paths: path and the same with ``complete``. Gold without version or
    device fits any."""
    # Gold and paths that agree in all of this are one kind each, and kinds meet.
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    keys = ["component", "document", "fault", "version", "device"]
    mine = golden.select("gold", "component", "document", F.lower("fault").alias("fault"), blank("version"), blank("device"))
    theirs = paths.groupBy("component", "document", F.lower("fault").alias("p_fault"), F.col("version").alias("p_version"), F.col("device").alias("p_device"))
    theirs = theirs.agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("complete").alias("complete"))
    fits = lambda c: (F.col(c) == "") | (F.col(c) == F.col(f"p_{c}"))
    met = mine.select(keys).distinct().join(theirs, ["component", "document"]).where(fits("version") & fits("device") & F.contains("p_fault", F.col("fault")))
    together = lambda rows: rows.agg(F.sum("n").alias("n"), F.min("path").alias("path"), F.min("complete").alias("complete"))
    of_kind = together(met.groupBy(*keys, (F.col("p_fault") == F.col("fault")).cast("int").alias("exact")))
    found = mine.join(of_kind, keys)
    top = Window.partitionBy("gold")
    one = together(found.withColumn("top", F.max("exact").over(top)).where("exact = top").groupBy("gold"))
    out = golden.select("gold").distinct().join(one, "gold", "left")
    issue = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(~F.col("complete"), "incomplete_provenance").otherwise("")
    return out.select("gold", F.when(issue == "", F.col("path")).alias("path"), issue.alias("issue"))


def claim_state(claims: DataFrame) -> DataFrame:
    """Whether an answer asserts a claim: all its terms stand in one clause that does not deny it, with all its numbers.

    claims: claim, terms (array), numbers (array), answer."""
    clauses = F.split(F.lower(F.coalesce("answer", F.lit(""))), "[。；;！？!?\n，,]")
    said = F.exists(clauses, lambda c: F.forall("terms", lambda t: F.contains(c, F.lower(t))) & ~any_in(c, DENIALS))
    whole = F.forall("numbers", lambda n: F.array_contains(all_of(F.lower(F.coalesce("answer", F.lit(""))), NUMBER), n))
    return claims.select("claim", (said & (F.size("terms") > 0)).alias("said"), whole.alias("numbers_met"), (said & whole & (F.size("terms") > 0)).alias("asserted"))
