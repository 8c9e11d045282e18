"""Which claims an answer makes, which of them its evidence supports, and how it treats evidence that disagrees.

Texts and patterns are compared by letters and digits alone, in normal form and lower case; a pattern's numbers must stand in the
text as numbers of their own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import REFUSALS
from .chunking import nfkc

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Numbers that no digit goes on with; a comma is a decimal point.
NUMBER = r"(?<!\d)\d+(?:[.,]\d+)?(?!\d)"
CLAUSE_END = r"[\r\n.!?;。！？；]+"
#: What a source is told by; the first four of a graph path hold all that is asked for, its paths exactly that.
SOURCE = "source string, document string, version string, pages array<int>, chunks array<string>, nodes array<string>, relations array<string>, paths array<string>, rule string, status string"
MARK = "\u0001"


def folded(text: Column) -> Column:
    """Normal form and lower case, one way to write a frequent slip."""
    return F.replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), F.lit("跟换"), F.lit("更换"))


def keyed(text: Column) -> Column:
    """(key, numbers) of a folded text."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))
    return F.named_struct(F.lit("key"), F.regexp_replace(text, NOT_WORD, ""), F.lit("numbers"), numbers)


def patterns(column: Column) -> Column:
    """(key, numbers) of each pattern; all are brought to normal form at once."""
    joined = folded(F.array_join(F.coalesce(column, F.array().cast("array<string>")), MARK))
    return F.when(F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0, F.transform(F.split(joined, MARK), keyed)).otherwise(F.array().cast("array<struct<key:string,numbers:array<string>>>"))


def matches(p: Column, text: Column) -> Column:
    return (p["key"] == "") | (F.contains(text["key"], p["key"]) & (F.size(F.array_except(p["numbers"], text["numbers"])) == 0))


def any_matches(ps: Column, text: Column) -> Column:
    return F.exists(ps, lambda p: matches(p, text))


def denies(clause: Column) -> Column:
    key, found = F.regexp_replace(clause, NOT_WORD, ""), F.lit(False)
    for word in REFUSALS:
        found = found | F.contains(key, F.regexp_replace(F.lower(F.lit(word)), NOT_WORD, ""))
    return found


def asserted(ps: Column, clauses: Column) -> Column:
    """Whether a clause that denies nothing says one of the patterns. clauses: (key, numbers, denies)."""
    return F.exists(ps, lambda p: F.exists(clauses, lambda c: matches(p, c) & ~c["denies"]))


def source_allowed(e: Column, s: Column) -> Column:
    """Whether evidence is of an allowed source: a manual by document, version, pages and any chunk; a graph path by document,
    version, pages, all chunks, nodes and relations, and exactly its paths; a rule by id and status. What a source leaves open
    fits all; two pages of evidence are its first and last."""
    none = lambda c, kind="string": F.coalesce(c, F.array().cast(f"array<{kind}>"))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    fits = lambda f: blank(s[f]) | (s[f] == e[f])
    filled = lambda c: F.filter(none(c), lambda x: ~blank(x))
    holds = lambda f: F.size(F.array_except(filled(s[f]), filled(e[f]))) == 0
    wanted, own = none(s["pages"], "int"), F.array_distinct(none(e["pages"], "int"))
    low, high = F.array_min(own), F.array_max(own)
    page = (F.size(wanted) == 0) | F.when(F.size(own) == 2, F.exists(wanted, lambda p: (p >= low) & (p <= high))).otherwise(F.arrays_overlap(wanted, own))
    exact = (F.size(none(s["paths"])) == 0) | (F.array_sort(F.array_distinct(filled(s["paths"]))) == F.array_sort(F.array_distinct(filled(e["paths"]))))
    manual = fits("document") & fits("version") & page & ((F.size(none(s["chunks"])) == 0) | F.arrays_overlap(none(s["chunks"]), none(e["chunks"])))
    graph = fits("document") & fits("version") & page & holds("chunks") & holds("nodes") & holds("relations") & exact
    rule = fits("rule") & fits("status")
    ok = F.when(s["source"] == "manual", manual).when(s["source"] == "graph", graph).when(s["source"] == "domain_rule", rule)
    return (s["source"] == e["source"]) & F.coalesce(ok, F.lit(False))


def read_evidence(evidence: DataFrame) -> DataFrame:
    names = [part.split()[0] for part in SOURCE.split(", ")]
    return evidence.select("case", "evidence", "qualification", "eligible", "bound", F.struct(*names).alias("e"), folded(F.col("text")).alias("text")).withColumn("text", keyed(F.col("text")))


def read_answers(answers: DataFrame) -> DataFrame:
    """``case, text, clauses`` of ``case, answer``."""
    rows = answers.select("case", folded(F.col("answer")).alias("said"))
    parts = F.filter(F.split("said", CLAUSE_END), lambda c: F.trim(c) != "")
    clause = lambda c: F.named_struct(F.lit("key"), keyed(c)["key"], F.lit("numbers"), keyed(c)["numbers"], F.lit("denies"), denies(c))
    return rows.select("case", keyed(F.col("said")).alias("text"), F.transform(parts, clause).alias("clauses"))


def observe_claims(claims: DataFrame, answers: DataFrame, evidence: DataFrame, binding=False) -> DataFrame:
    """``case, claim, supported, asserted, disclosed, forbidden, issues``.

    A claim is supported by qualified evidence of an allowed source that says one of its evidence patterns; with ``binding``, a claim that
    allows graph sources needs a bound one among those. issues: why it is not supported; what the answer lacks though it is, or
    says though it is not. claims: case, claim, answer_patterns, evidence_patterns, disclosures, forbidden, sources (array of structs as
    ``SOURCE``); answers: case, answer; evidence: case, evidence, qualification, eligible, bound, text and what ``SOURCE`` names."""
    wanted = claims.select("case", "claim", "sources", *[patterns(F.col(c)).alias(c) for c in ("answer_patterns", "evidence_patterns", "disclosures", "forbidden")])
    given = read_evidence(evidence).where("qualification = 'qualified'")
    near = wanted.select("case", "claim", "sources", "evidence_patterns").join(given, "case").where(any_matches(F.col("evidence_patterns"), F.col("text")))
    allowed = F.exists("sources", lambda s: source_allowed(F.col("e"), s))
    met = near.groupBy("case", "claim").agg(F.lit(True).alias("text_met"), F.max(allowed).alias("allowed"), F.max(allowed & (F.col("e.source") == "graph") & F.coalesce("bound", F.lit(False))).alias("graph_bound"))
    rows = wanted.join(met, ["case", "claim"], "left").join(read_answers(answers), "case", "left")
    known = F.coalesce("allowed", F.lit(False))
    of_graph = F.exists("sources", lambda s: s["source"] == "graph")
    unbound = F.lit(binding) & known & of_graph & ~F.coalesce("graph_bound", F.lit(False))
    supported, said = known & ~unbound, F.coalesce(asserted(F.col("answer_patterns"), F.col("clauses")), F.lit(False))
    disclosed, forbidden = F.coalesce(any_matches(F.col("disclosures"), F.col("text")), F.lit(False)), F.coalesce(asserted(F.col("forbidden"), F.col("clauses")), F.lit(False))
    issues = F.array_compact(F.array(
        F.when(unbound, "final_binding_missing"),
        F.when(F.size("evidence_patterns") == 0, "evidence_patterns_missing").when(F.col("text_met").isNull(), "evidence_pattern_missing")
        .when(F.size("sources") == 0, "allowed_sources_missing").when(~known, "allowed_source_missing"),
        F.when(supported & ~said, "answer_pattern_missing"), F.when(~supported & (said | forbidden), "unsupported_completion")))
    return rows.select("case", "claim", supported.alias("supported"), said.alias("asserted"), disclosed.alias("disclosed"), forbidden.alias("forbidden"), issues.alias("issues"))


def observe_conflicts(conflicts: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``case, conflict, n_found, distinct, passed``: how many alternatives have evidence, whether two of them have different
    evidence, and whether the answer then discloses the conflict and gives the value and unit of each that has some.

    Two alternatives have different evidence unless both have one and the same. conflicts: case, conflict, disclosures, alternatives (array of
    values, units, sources)."""
    # All meet by case: what the answer tells first, then the evidence that fits an alternative.
    said = conflicts.join(read_answers(answers).select("case", F.col("text").alias("said")), "case", "left")
    rows = said.select("case", "conflict", "said", patterns(F.col("disclosures")).alias("disclosures"), F.posexplode_outer("alternatives").alias("i", "a"))
    rows = rows.select("case", "conflict", "said", "disclosures", "i", patterns(F.col("a.values")).alias("values"), patterns(F.col("a.units")).alias("units"), F.col("a.sources").alias("sources"))
    says = lambda text: any_matches(F.col("values"), F.col(text)) & any_matches(F.col("units"), F.col(text))
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select("case", "conflict", "i", "values", "units", "sources", no(says("said")).alias("told"), no(any_matches(F.col("disclosures"), F.col("said"))).alias("disclosed"))
    given = read_evidence(evidence).where("eligible AND qualification IN ('qualified', 'reference_only')").select(F.col("case").alias("of"), "evidence", "e", "text")
    fits = F.col("i").isNotNull() & says("text") & F.exists("sources", lambda s: source_allowed(F.col("e"), s))
    met = rows.join(given, (F.col("case") == F.col("of")) & fits, "left")
    each = met.groupBy("case", "conflict", "i", "told", "disclosed").agg(F.min("evidence").alias("low"), F.max("evidence").alias("high"))
    out = each.groupBy("case", "conflict").agg(
        F.count("low").alias("n_found"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("low").isNull() | F.col("told")).alias("all_told"), F.max("disclosed").alias("disclosed"))
    distinct = F.coalesce((F.col("n_found") >= 2) & (F.col("low") != F.col("high")), F.lit(False))
    return out.select("case", "conflict", "n_found", distinct.alias("distinct"), (distinct & F.col("disclosed") & F.col("all_told")).alias("passed"))
