"""Chat formatting by event sourcing: logs of a conversation are folded to its messages, then rendered.

Events of a log: ``message`` starts a turn with a whole text, ``delta`` appends to it, ``edit`` replaces its text,
``regenerate`` starts it anew and takes back every later turn that had begun before. Everything here is DataFrame code.

Rendered turn: ``### <role>: <text></turn>`` and a line feed. In roles and texts a backslash is doubled, a
backslash goes into each ``</turn>`` and between the signs of each ``###``, and in roles behind each colon that a
blank follows. Doubling leaves runs of even length, so a lone backslash there comes from escaping: reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisurface.functions.types import let
from apisurface.llm.frames import pick

RESETS = ("message", "edit", "regenerate")
END = "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marked = F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(marked, "#(?=##)", "#\\\\")


def unescape(text: Column) -> Column:
    joined = F.regexp_replace(text, r"#\\(?=#)", "#")
    closed = F.replace(joined, F.lit("<\\/turn>"), F.lit("</turn>"))
    return F.replace(closed, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ":(?= )", ":\\\\")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(?= )", ":"))


def fold_turns(
    events: DataFrame, conv: str = "conv_id", seq: str = "seq", turn: str = "turn", kind: str = "kind", role: str = "role", text: str = "text"
) -> DataFrame:
    """Final messages: ``conv_id``, ``turn``, ``role``, ``text``, one row for each turn that stands.

    Events are folded by turn first, so a conversation with many deltas is spread over tasks; only its finished turns meet.
    A turn's text is that of its last reset with all deltas behind it; its role is the last that is not null, else empty.
    A regeneration takes back later turns whose last reset came before it. Null texts are empty, null kinds are messages,
    other kinds do nothing, a null sequence number comes first, events of equal number are ordered by kind, role
    and text. Null ids and turns form groups of their own. No events give no rows.
    """
    e = pick(events, conv_id=conv, seq=seq, turn=turn, kind=kind, role=role, text=text)
    event = F.struct(
        F.col("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    folded = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    places = F.transform("log", lambda x, i: F.when(x["kind"].isin(*RESETS), i + 1).otherwise(0))
    folded = folded.withColumn("start", F.greatest(F.array_max(places), F.lit(1)))
    live = F.filter(
        F.slice("log", F.col("start"), F.size("log")), lambda x: x["kind"].isin(*RESETS, "delta")
    )
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    again = F.filter("log", lambda x: x["kind"] == "regenerate")
    turns = folded.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
        F.element_at("log", F.col("start"))["seq"].alias("begun"),
        F.try_element_at(again, F.lit(-1))["seq"].alias("again"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("again").over(earlier)
    return turns.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("begun") > F.col("cut"))).select(
        "conv_id", "turn", "role", "text"
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id``, ``formatted``, and ``loss_spans``: begin (from 0) and length of each learned text, in code points.

    Takes what ``fold_turns`` gives. The spans cover the escaped text of each turn whose role is in ``learn``, not its header or end.
    """
    turn = F.struct("turn", "role", "text")
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("### "), escape_role(t["role"]), F.lit(": ")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learned"),
        ),
    )
    pieces = grouped.select("conv_id", piece.alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin, size = state["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct(
            (begin + size + len(END)).alias("at"),
            F.when(p["learned"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate("pieces", zero, add)["spans"]
    shown = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    return pieces.select("conv_id", F.array_join(shown, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a rendered conversation."""
    parts = F.split(formatted, END, -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        whole,
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, "(?s)^### (.*?): ", 1)).alias("role"),
            unescape(F.regexp_replace(p, "(?s)^### .*?: ", "")).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""

    def texts(whole: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substring(whole, s["start"] + 1, s["length"])))

    return F.array_join(let(formatted, texts), "")
