"""Chat formatting with a grammar round trip (operator 9), in DataFrame functions only.

Rendered form of one conversation, turns in order::

    user       <s>[INST] TEXT [/INST]
    assistant   TEXT</s>
    any other  <<ROLE:NAME>>TEXT<</ROLE>>

A text that holds a control string would be read wrongly. So every text is escaped: the escape
character (U+001A) doubles into ``E0``, and the characters ``[`` ``<`` ``:`` ``>`` that begin or end a
control string become ``E1`` .. ``E4`` when, and only when, the plain text does not survive the round
trip: rendering is parsed back, compared with the source, and conflicting texts are escaped until both
agree. One escape removes every character a control string needs, so the second pass always agrees.

The loss mask is a list of spans of the rendered text (code points, end exclusive): the assistant texts, without
their control strings. Training text is what these spans cut out of the rendering, unescaped.

Edge cases: null text is empty, null role is the empty role; turns with equal number are ordered by
role and text; a conversation is one output row, so it is the only group that is gathered. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "\x1a"
#: Control strings of the template (fixed values of the format).
OPEN_USER, CLOSE_USER, OPEN_ASSISTANT, CLOSE_ASSISTANT = "<s>[INST] ", " [/INST]", " ", "</s>"
OPEN_ROLE, MID_ROLE, CLOSE_ROLE = "<<ROLE:", ">>", "<</ROLE>>"
_ESCAPES = ((ESC, "0"), ("[", "1"), ("<", "2"), (":", "3"), (">", "4"))

#: One turn of a rendering: the three forms, each up to its closing control string.
_TURN = (
    r"(?s)<s>\[INST\] (?:(?! \[/INST\]).)*+ \[/INST\]"
    r"|<<ROLE:(?:(?!>>).)*+>>(?:(?!<</ROLE>>).)*+<</ROLE>>"
    r"| (?:(?!</s>).)*+</s>"
)


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(ESC + code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(ESC + code), F.lit(plain))
    return text


def _turn(role: Column, text: Column, name: Column) -> Column:
    """A rendered turn; role decides the form, name is the role as written."""
    return (
        F.when(role == "user", F.concat(F.lit(OPEN_USER), text, F.lit(CLOSE_USER)))
        .when(role == "assistant", F.concat(F.lit(OPEN_ASSISTANT), text, F.lit(CLOSE_ASSISTANT)))
        .otherwise(F.concat(F.lit(OPEN_ROLE), name, F.lit(MID_ROLE), text, F.lit(CLOSE_ROLE)))
    )


def _between(turn: Column, before: str | Column, after: str) -> Column:
    start = F.lit(len(before)) if isinstance(before, str) else before
    return turn.substr(start + 1, F.length(turn) - start - len(after))


def parse_turns(rendered: Column) -> Column:
    """Deterministic parser: array of (role, text), still escaped, from a rendering."""

    def one(turn: Column) -> Column:
        other = F.instr(turn, MID_ROLE)
        return (
            F.when(
                F.startswith(turn, F.lit(OPEN_USER)),
                F.struct(F.lit("user").alias("role"), _between(turn, OPEN_USER, CLOSE_USER).alias("text")),
            )
            .when(
                F.startswith(turn, F.lit(OPEN_ASSISTANT)),
                F.struct(F.lit("assistant").alias("role"), _between(turn, OPEN_ASSISTANT, CLOSE_ASSISTANT).alias("text")),
            )
            .otherwise(
                F.struct(
                    turn.substr(F.lit(len(OPEN_ROLE) + 1), other - len(OPEN_ROLE) - 1).alias("role"),
                    _between(turn, other + len(MID_ROLE) - 1, CLOSE_ROLE).alias("text"),
                )
            )
        )

    return F.transform(F.regexp_extract_all(rendered, F.lit(_TURN), F.lit(0)), one)


def _plain(turns: Column) -> Column:
    """Turns as parsed, with their escapes undone."""
    return F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and as read back from it turns (role, text) and loss_spans (start, end)."""
    c = conversations.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The round trip of one turn: does its own rendering read back as this turn and nothing else?
    alone = _turn(F.col("role"), F.col("text"), F.col("role"))
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    # A lone escape character would be undone by the reader, so it must not survive as plain text.
    agrees = _plain(parse_turns(alone)).eqNullSafe(source) & (F.array_join(F.regexp_extract_all(alone, F.lit(_TURN), F.lit(0)), "") == alone)
    escaped = _turn(F.col("role"), escape(F.col("text")), escape(F.col("role")))
    rendered = c.select("conv_id", "turn", "role", "text", F.when(agrees, alone).otherwise(escaped).alias("piece"))
    return (
        rendered.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("rows"))
        .select("conv_id", F.array_join(F.col("rows.piece"), "").alias("formatted"), F.struct(F.col("rows.role").alias("role"), F.col("rows.text").alias("text")).alias("source"))
        .withColumn("turns", _plain(parse_turns(F.col("formatted"))))
        # The whole conversation is compared once more; if pieces of turns joined into a control string, all are escaped.
        .withColumn("same", (F.col("turns.role") == F.col("source.role")) & (F.col("turns.text") == F.col("source.text")))
        .withColumn(
            "formatted",
            F.when(F.col("same"), F.col("formatted")).otherwise(
                F.array_join(F.zip_with("source.role", "source.text", lambda r, t: _turn(r, escape(t), escape(r))), "")
            ),
        )
        .select("conv_id", "formatted", F.when(F.col("same"), F.col("turns")).otherwise(_plain(parse_turns(F.col("formatted")))).alias("turns"))
        .withColumn("loss_spans", loss_spans(F.col("formatted")))
    )


def loss_spans(formatted: Column) -> Column:
    """Loss mask: array of (start, end) of the assistant texts in a rendering, in order; both in code points."""
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.startswith(p, F.lit(OPEN_ASSISTANT)).alias("own")))

    def add(state: Column, piece: Column) -> Column:
        end = state["end"] + piece["n"]
        span = F.struct((state["end"] + len(OPEN_ASSISTANT)).alias("start"), (end - len(CLOSE_ASSISTANT)).alias("end"))
        return F.struct(end.alias("end"), F.when(piece["own"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(sizes, F.struct(F.lit(0).alias("end"), none.alias("spans")), add, lambda s: s["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped: every assistant text once, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, read from the turns and the loss mask that were parsed out of it."""
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
