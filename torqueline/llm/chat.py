"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "### " role mark ": " body "</turn>\\n"
    mark         := "" (body as it is) | "\\" (body escaped)

``###`` and ``</turn>`` are the control strings. Rendering first leaves every body as it is, parses the turn again and
compares; a turn that does not come back identical is escaped (backslash to ``\\b``, ``<`` to ``\\l``, ``#`` to ``\\h``)
and parsed once more. The whole rendered conversation is parsed and compared with its source at the end. Roles are always escaped, with ``:`` as ``\\c`` besides.

Defined cases: null text or role counts as empty; rows of one conversation are ordered by turn (null first), then role,
then text, so ties and repeated rows have one result and all stay; a null conversation id is a conversation of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPED = "### ", "</turn>", "\\"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def render(role: Column, text: Column, escaped: bool) -> Column:
    body, mark = (escape(text), ESCAPED) if escaped else (text, "")
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(mark + ": "), body, F.lit(CLOSE + "\n"))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, body, escaped); null if it breaks the grammar."""
    pieces = F.split(rendered, CLOSE + "\n", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        body = F.substr(piece, F.length(head) + 3)
        marked = head.endswith(ESCAPED)
        role = F.substr(head, F.lit(len(OPEN) + 1), F.length(head) - len(OPEN) - F.when(marked, 1).otherwise(0))
        return F.struct(
            unescape_role(role).alias("role"), F.when(marked, unescape(body)).otherwise(body).alias("text"), body.alias("body"), marked.alias("escaped")
        )

    stray = F.exists(turns, lambda p: ~p.startswith(OPEN) | F.substr(p, F.lit(2)).contains("###") | p.contains(CLOSE))
    whole = F.element_at(pieces, -1) == ""
    return F.when(whole & ~stray, F.transform(turns, turn))


def same(parsed: Column, role: Column, text: Column) -> Column:
    """Whether a parse gave exactly this one turn."""
    first = F.get(parsed, F.lit(0))
    return F.coalesce((F.size(parsed) == 1) & (first["role"] == role) & (first["text"] == text), F.lit(False))


def format_conversations(
    rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", loss_role="assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_runs, n_escaped``.

    ``loss_runs`` is the loss mask over ``formatted`` as an array of (skip, keep) run lengths in code points, one per turn:
    the kept runs hold the bodies of ``loss_role`` and nothing else."""
    rows = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    plain, safe = render(F.col("role"), F.col("text"), False), render(F.col("role"), F.col("text"), True)
    rows = rows.withColumn("first", plain).withColumn("escaped", ~same(parse(F.col("first")), F.col("role"), F.col("text")))
    rows = rows.withColumn("rendered", F.when(F.col("escaped"), safe).otherwise(F.col("first")))
    back = same(parse(F.col("rendered")), F.col("role"), F.col("text"))
    rows = rows.withColumn("rendered", F.when(back, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn does not survive its round trip"))))
    body = F.length(F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    tail = len(CLOSE) + 1
    rows = rows.withColumn("keep", F.when(F.col("role") == loss_role, body).otherwise(F.lit(0)))
    rows = rows.withColumn("skip", F.length("rendered") - F.when(F.col("role") == loss_role, body + tail).otherwise(F.lit(0)))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered", "skip", "keep", "escaped")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"))
    out = out.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    said = lambda of: F.transform(of, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = F.coalesce(said(parse(F.col("formatted"))) == said("turns"), F.lit(False))
    # The closing string after a kept body is skipped at the start of the next run.
    closing = F.transform("turns", lambda t, i: F.when((i > 0) & (F.get("turns", i - 1)["role"] == loss_role), tail).otherwise(0))
    return out.select(
        "conv_id",
        F.when(whole, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"),
        F.zip_with("turns", closing, lambda t, c: F.struct((t["skip"] + c).alias("skip"), t["keep"].alias("keep"))).alias("loss_runs"),
        F.size(F.filter("turns", lambda t: t["escaped"])).cast("long").alias("n_escaped"),
    )


def under_mask(formatted: Column, runs: Column) -> Column:
    """The stretches of ``formatted`` that the mask keeps, one per turn, cut out by its run lengths alone."""
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, run: Column) -> Column:
        start = acc["at"] + run["skip"]
        return F.struct((start + run["keep"]).alias("at"), F.concat(acc["kept"], F.array(F.substr(formatted, start, run["keep"]))).alias("kept"))

    return F.aggregate(runs, none, step)["kept"]


def read_back(formatted: DataFrame, loss_role="assistant") -> DataFrame:
    """Parses ``formatted`` again and gives ``conv_id, turns, loss_text``.

    ``loss_text`` is what stands under the mask, unescaped where the mark of its turn says so."""
    turns = formatted.withColumn("turns", F.coalesce(parse(F.col("formatted")), F.raise_error(F.lit("not a rendered conversation"))))
    kept = turns.withColumn("kept", under_mask(F.col("formatted"), F.col("loss_runs")))
    plain = lambda body, turn: F.when(turn["escaped"], unescape(body)).otherwise(body)
    return kept.withColumn("loss_text", F.array_join(F.zip_with("kept", "turns", plain), "")).drop("kept")
