"""Usage analytics: reading dwell, popularity, recommendations, task status and quiz mastery."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType


def dwell(beats: DataFrame, session="session_id", user="user_id", manual="manual_id", ts="ts", cap=30, gap=300) -> DataFrame:
    """Whole seconds since the last beat of a session, capped; a pause over ``gap`` starts a new session and counts nothing.

    Gives ``session, user, manual, ts, seconds``; the first beat of a session has 0."""
    order = Window.partitionBy(session).orderBy(ts, user, manual)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    passed = micros - F.lag(micros).over(order)
    whole = F.floor(passed / 1_000_000)
    seconds = F.when(whole.isNull() | (whole > gap), 0).otherwise(F.least(whole, F.lit(cap)))
    return beats.select(F.col(session).alias("session"), F.col(user).alias("user"), F.col(manual).alias("manual"), F.col(ts).alias("ts"), seconds.cast("long").alias("seconds"))


def daily_reads(dwelled: DataFrame, at_least=60) -> DataFrame:
    """Seconds per user, manual and day, and whether that day counts as a valid read."""
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai")).alias("day")
    out = dwelled.groupBy("user", "manual", day).agg(F.sum("seconds").alias("seconds"))
    return out.withColumn("counted", F.col("seconds") >= at_least)


def progress(dwelled: DataFrame, at_least=60) -> DataFrame:
    """Each beat with the running seconds of its user, manual and day, and whether it made the day a valid read."""
    day = F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd")
    so_far = Window.partitionBy("user", "manual", "day").orderBy("ts", "session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dwelled.withColumn("day", day).withColumn("day_seconds", F.sum("seconds").over(so_far))
    return out.withColumn("counted_now", (F.col("day_seconds") >= at_least) & (F.col("day_seconds") - F.col("seconds") < at_least))


def period_keys(ts: Column) -> dict[str, Column]:
    """Day, ISO week and month keys in the business zone."""
    local = F.from_utc_timestamp(ts, "Asia/Shanghai")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))
    return {"day": F.date_format(local, "yyyyMMdd"), "week": week, "month": F.date_format(local, "yyyyMM"), "total": F.lit("all")}


def popularity(reads: DataFrame, live: DataFrame, item: str, ts: str, kind="day", top=10, most=100) -> DataFrame:
    """K8: items by reads in each period; the list is cut at ``top`` first and items that are no longer live are left out then."""
    counts = reads.groupBy(period_keys(F.col(ts))[kind].alias("period"), F.col(item).alias("item")).agg(F.count("*").alias("reads"))
    order = Window.partitionBy("period").orderBy(F.desc("reads"), "item")
    cut = counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= min(top, most))
    return cut.join(live.select(F.col(live.columns[0]).alias("item")), "item", "left_semi")


def status_distribution(tasks: DataFrame, status: str, known: list[str], closed: str, by: str | None = None) -> DataFrame:
    """A1: a count per known status, zeros included, and the completion rate in percent with one decimal, half up."""
    groups = [F.col(by).alias("owner")] if by else []
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in known]
    done = F.count_if(F.col(status) == closed).cast("decimal(20,0)")
    rate = F.coalesce(F.round(F.try_divide(done * 100, F.count("*").cast("decimal(20,0)")), 1), F.lit(0)).cast("double")
    return tasks.groupBy(*groups).agg(*counts, F.count("*").alias("n"), rate.alias("completion_rate"))


def totals(**tables: DataFrame) -> DataFrame:
    """A2: the number of rows of each table, as ``name, n``."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Most live manuals that are broadcast to the links.
BROADCAST_LIVE = 1_000_000


def live_links(links: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct links of live manuals, with what else ``live`` has; links stay where they are unless there are very many manuals."""
    few = live.count() <= BROADCAST_LIVE
    return links.select("device", "manual").distinct().join(F.broadcast(live) if few else live, "manual")


def own_device_scores(tasks: DataFrame, links: DataFrame, live: DataFrame, since, points=3.0) -> DataFrame:
    """Manuals of the devices in a user's tasks since a time, once each; those of a device move as one array.

    tasks: user, device, created; links: device, manual."""
    recent = tasks.where((F.col("created") >= since) & F.col("device").isNotNull()).select("user", "device").distinct()
    of_device = live_links(links, live.select("manual").distinct()).groupBy("device").agg(F.collect_list("manual").alias("m"))
    found = recent.join(of_device, "device").groupBy("user").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"))
    return found.select("user", F.explode("m").alias("manual")).withColumn("score", F.lit(points))


def in_words(kind: DataType) -> tuple[Callable, Callable, Callable]:
    """The word of an id, its bit there, and the ids of a word's bits: 64 whole numbers to a word, and one id of another kind."""
    if not isinstance(kind, IntegralType):
        return lambda m: m, lambda m: F.lit(1).cast("long"), lambda w, b: F.when(b != 0, F.array(w)).otherwise(F.array().cast(ArrayType(kind)))
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(m, F.lit(64)).cast("int"))
    at = F.array(*map(F.lit, range(64)))
    return lambda m: F.shiftright(m.cast("long"), 6), bit, lambda w, b: F.transform(F.filter(at, lambda i: F.getbit(b, i) == 1), lambda i: (w * 64 + i).cast(kind))


def same_site_scores(owned: DataFrame, sites: DataFrame, links: DataFrame, live: DataFrame, scored: DataFrame, points=1.5, top: int | None = None) -> DataFrame:
    """Manuals of devices at the sites of a user's devices, without own devices and manuals scored already.

    owned: user, device; sites: device, site. A site is one row with its sorted manuals and those of each device, and a user's sites meet
    it with the user's own devices there, so links move by device and by site once each and pairs of user and manual do not move as rows.
    Manuals with whole-number ids go from a site to its users as 64 to a word. With ``top`` a site gives only its first ``top`` manuals
    that are left for the user, as no others can be among the user's first ``top`` by id; where ``live`` has a boolean ``apart``, these and the others are cut each by themselves."""
    apart = F.col("apart") if "apart" in live.columns else F.lit(False)
    sites = sites.select("device", "site").distinct()
    linked = live_links(links, live.select("manual", apart.alias("apart")).distinct())
    # By a fixed number of parts, as a part meets users and does much more than its bytes tell.
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = sites.join(linked, "device").repartition(tasks, "site").withColumn("n", F.count("*").over(Window.partitionBy("site", "manual")))
    # All groupings below stay in the parts by site.
    of_device = each.groupBy("site", "device").agg(F.collect_list(F.struct("manual", "n", "apart")).alias("l"))
    of_site = of_device.groupBy("site").agg(F.collect_list(F.struct("device", "l")).alias("devices"))
    at = owned.distinct().join(sites, "device").groupBy("user", "site").agg(F.collect_list("device").alias("own"))
    # A manual counts where a site has a device of it that is not the user's own; one of n devices is gone if the user has n of them.
    mine = F.flatten(F.transform(F.filter("devices", lambda x: F.array_contains("own", x["device"])), lambda x: F.filter(x["l"], lambda y: y["n"] <= F.size("own"))))
    alone = lambda x: (x["n"] == 1) | (F.size(F.filter("mine", lambda y: y["manual"] == x["manual"])) >= x["n"])
    gone = F.transform(F.filter("mine", alone), lambda x: x["manual"])
    if top:
        at_site = F.flatten(F.transform("devices", lambda x: x["l"]))
        sorted_ids = lambda test: F.array_sort(F.array_distinct(F.transform(F.filter(at_site, test), lambda x: x["manual"])))
        of_site = of_site.select("site", "devices", sorted_ids(lambda x: x["apart"]).alias("first"), sorted_ids(lambda x: ~x["apart"]).alias("rest"))
        done = scored.groupBy("user").agg(F.collect_set("manual").alias("done"))
        known = F.coalesce("done", F.array().cast(done.schema["done"].dataType))
        met = at.join(done, "user", "left").join(of_site, "site").withColumn("mine", mine).withColumn("gone", F.concat(known, gone))
        few = met.select("user", *[F.slice(F.array_except(c, "gone"), 1, top).alias(c) for c in ("first", "rest")])
        of_user = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, top)
        found = few.groupBy("user").agg(F.concat(of_user("first"), of_user("rest")).alias("m"))
    else:
        kind = linked.schema["manual"].dataType
        word, bits, opened = in_words(kind)
        words = lambda rows, by: rows.groupBy(by, word(F.col("manual")).alias("w")).agg(F.bit_or(bits(F.col("manual"))).alias("b")).groupBy(by).agg(F.collect_list(F.struct("w", "b")).alias("words"))
        met = at.join(of_site.join(words(of_device.select("site", F.inline("l")), "site"), "site"), "site").withColumn("mine", mine).withColumn("gone", gone)
        lost = lambda x: F.aggregate(F.filter("gone", lambda m: word(m) == x["w"]), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(bits(m)))
        kept = F.transform("words", lambda x: F.struct(x["w"].alias("w"), x["b"].bitwiseAND(F.bitwise_not(lost(x))).alias("b")))
        # As it is named twice, ``gone`` is not made anew for each word.
        near = met.select("user", F.when(F.size("gone") > 0, kept).otherwise(F.col("words")).alias("words"), F.lit(True).alias("near"))
        both = near.unionByName(words(scored.where("manual IS NOT NULL"), "user").withColumn("near", F.lit(False))).repartition(tasks, "user")
        one = lambda test: F.coalesce(F.bit_or(F.when(test, F.col("b"))), F.lit(0).cast("long"))
        # Outer, else the test for empty arrays goes down into the join and makes them once more.
        left = both.select("user", "near", F.inline_outer("words")).groupBy("user", "w").agg(one(F.col("near")).alias("b"), one(~F.col("near")).alias("done"))
        found = left.select("user", opened(F.col("w"), F.col("b").bitwiseAND(F.bitwise_not("done"))).alias("m"))
    return found.select("user", F.explode("m").alias("manual")).withColumn("score", F.lit(points))


def recommend(own: DataFrame, near: DataFrame, users: DataFrame, live: DataFrame, now: Column, top=5, bonus=1.0, days=7) -> DataFrame:
    """K9: best manuals of each user with the reason; manuals updated within ``days`` get ``bonus`` more; users with fewer get the
    newest live ones at score 0. own, near: user, manual, score; live: manual, created, updated.

    ``near`` must hold a user's first ``top`` manuals of either kind, updated lately or not."""
    why = own.withColumn("why", F.lit("检修设备")).unionByName(near.withColumn("why", F.lit("同区域设备"))).join(live.select("manual", "updated"), "manual")
    fresh = F.coalesce(F.col("updated") > now - F.make_interval(days=F.lit(days)), F.lit(False))
    scores = why.withColumn("score", F.col("score") + F.when(fresh, bonus).otherwise(0.0)).withColumn("reason", F.concat_ws("、", "why", F.when(fresh, "近期更新")))
    order = Window.partitionBy("user").orderBy(F.desc("score"), "manual")
    ranked = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    newest = live.orderBy(F.desc("created"), "manual").limit(2 * top).select("manual", "created").collect()  # enough to fill any list
    kind = live.schema["manual"].dataType
    fill = F.array(*[F.struct(F.lit(r["manual"]).cast(kind).alias("manual"), F.lit(r["created"]).cast("timestamp").alias("created")) for r in newest])
    fill = fill.cast(f"array<struct<manual:{kind.simpleString()},created:timestamp>>")
    # A user's own rows are one array, which the newest fill up, so that what they follow from is computed once.
    best = ranked.groupBy("user").agg(F.collect_list(F.struct("manual", "score", "reason", F.lit(None).cast("timestamp").alias("created"))).alias("best"))
    all_users = users.select("user").distinct().withColumn("fill", fill).join(best, "user", "full")
    taken = F.coalesce(F.transform("best", lambda x: x["manual"]), F.array().cast(f"array<{kind.simpleString()}>"))
    spare = F.transform(F.filter("fill", lambda x: ~F.array_contains("taken", x["manual"])), lambda x: F.struct(x["manual"].alias("manual"), F.lit(0.0).alias("score"), F.lit("最新手册").alias("reason"), x["created"].alias("created")))
    both = all_users.withColumn("taken", taken).withColumn("spare", spare)
    none = F.array().cast(both.schema["spare"].dataType)
    both = both.select("user", F.inline(F.concat(F.coalesce("best", none), F.coalesce("spare", none))))
    order = Window.partitionBy("user").orderBy(F.desc("score"), F.desc_nulls_last("created"), "manual")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("user", "manual", "score", "reason", "place")


def device_overview(devices: DataFrame, owns: DataFrame, has_fault: DataFrame) -> DataFrame:
    """A3: distinct components and faults of each device; owns: device, component; has_fault: component, fault."""
    faults = owns.distinct().join(has_fault.distinct(), "component", "left").groupBy("device").agg(F.countDistinct("component").alias("components"), F.countDistinct("fault").alias("faults"))
    return devices.select("device").join(faults, "device", "left").select("device", F.coalesce("components", F.lit(0)).alias("components"), F.coalesce("faults", F.lit(0)).alias("faults"))


def mastery(answers: DataFrame) -> DataFrame:
    """A10: correct, total, last time and rate (two decimals) of each user and topic; blank topics count nowhere.

    answers: user, topic, correct (boolean), at."""
    known = answers.where(F.trim(F.coalesce("topic", F.lit(""))) != "")
    rate = F.round(F.count_if("correct").cast("decimal(20,0)") / F.count("*").cast("decimal(20,0)"), 2).cast("double")
    return known.groupBy("user", "topic").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.max("at").alias("last_at"), rate.alias("rate"))


def weakest_topics(topics: DataFrame, mastered: DataFrame, top=3) -> DataFrame:
    """Topics of each user by ascending rate, unseen ones (-1) first. topics: user, topic, position."""
    rate = topics.join(mastered.select("user", "topic", "rate"), ["user", "topic"], "left").withColumn("rate", F.coalesce("rate", F.lit(-1.0)))
    order = Window.partitionBy("user").orderBy("rate", "position", "topic")
    return rate.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("user", "topic", "rate", "place")


def canonical_choice(answer: Column) -> Column:
    """A multiple-choice answer as its sorted set of letters; null for a blank one."""
    letters = F.filter(F.transform(F.split(answer, "[,，、;\\s]+"), lambda a: F.upper(F.trim(a))), lambda a: a != "")
    return F.when(F.size(letters) > 0, F.array_join(F.array_sort(F.array_distinct(letters)), ","))


def grade(answers: DataFrame) -> DataFrame:
    """Adds ``correct``: sets are compared for multiple choice, text without case otherwise; blank answers are wrong.

    answers: kind ('multiple' or other), expected, given."""
    several = F.coalesce(canonical_choice(F.col("expected")) == canonical_choice(F.col("given")), F.lit(False))
    one = F.coalesce((F.trim("given") != "") & (F.lower(F.trim("given")) == F.lower(F.trim("expected"))), F.lit(False))
    return answers.withColumn("correct", F.when(F.col("kind") == "multiple", several).otherwise(one))


def latest_reads(reads: DataFrame, live: DataFrame) -> DataFrame:
    """The last read of each user and manual, of live manuals. reads: user, manual, ts."""
    return reads.groupBy("user", "manual").agg(F.max("ts").alias("last_read")).join(live.select("manual"), "manual", "left_semi")


def session_scores(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session, score, total``: right answers and questions of each session that is ready to be handed in; one without questions
    has 0 of 0. questions: session, kind, expected, given; sessions: session, status."""
    graded = grade(questions).groupBy("session").agg(F.count_if("correct").alias("score"), F.count("*").alias("total"))
    ready = sessions.where("status = 'READY'").select("session").distinct()
    return ready.join(graded, "session", "left").select("session", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("total", F.lit(0)).alias("total"))


def recent_activities(logs: DataFrame, limit: int, name="system") -> DataFrame:
    """The newest 1 to 50 entries of the log; ones without a user are the system's. logs: id, user, action, status, at."""
    newest = logs.orderBy(F.desc("at"), F.desc("id")).limit(max(1, min(limit, 50)))
    return newest.select("id", F.coalesce("user", F.lit(name)).alias("user"), "action", "status", "at")
