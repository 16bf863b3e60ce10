r"""Conversations as text, checked by reading the text back.

Each turn becomes one segment, ``<s>`` role ``[INST]`` text ``[/INST]</s>``, and a conversation's
text is its segments one after the other.  The parser cuts at the four control strings, takes the
pieces in fours, and removes one backslash from what looks like an escaped control string.  It is
deterministic: a text is a conversation only if its pieces, put together again, give that text.

A turn is first rendered as it is.  If reading it back gives anything but that turn (a control
string or an escaped one inside), its content is escaped, one backslash for each conflict, and read
back again; what then still differs stops the job.  Content without conflicts is never touched.

Expressions only: rows are rendered where they are read, and one shuffle by conversation brings the
segments together, as the text of a conversation is one value.

Null roles and texts count as empty.  Turns are ordered by turn (null first), then role and text, so
repeated rows stay and have a fixed order.  A null id is a conversation of its own.  Input columns named like
those that ``format_turns`` adds give way to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.aside import Aside

#: The control strings of the template.
OPEN, BODY, BODY_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
CONFLICTS = ((r"<(\\*)(/?s>)", "<"), (r"\[(\\*)(/?INST\])", "["))
ESCAPED = ((r"<\\(\\*)(/?s>)", "<"), (r"\[\\(\\*)(/?INST\])", "["))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    for pattern, first in CONFLICTS:
        text = F.regexp_replace(text, pattern, first + r"\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for pattern, first in ESCAPED:
        text = F.regexp_replace(text, pattern, first + "$1$2")
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(BODY_END + CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a text as structs of role and text; null if it isn't a conversation."""

    def turns(pieces: Column) -> Column:
        count = ((F.size(pieces) - 1) / 4).cast("int")
        raw = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get(pieces, 4 * i + 1).alias("role"), F.get(pieces, 4 * i + 2).alias("text")))
        return F.when(F.size(pieces) > 4, raw)

    def checked(raw: Column) -> Column:
        again = F.array_join(F.transform(raw, lambda t: render(t["role"], t["text"])), "")
        return F.when(again == formatted, F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))

    return let(let(F.split(formatted, CONTROL, -1), turns), checked)


def _reads_back(segment: Column, role: Column, text: Column) -> Column:
    return F.coalesce(parse(segment) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def format_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """All columns and ``segment``, ``loss_start``, ``loss_stop``, ``escaped``.

    The loss mask covers the text of the assistant's turns, as a range of code points of the segment;
    other turns have an empty range.
    """
    own = Aside(df)
    role_, text_ = (F.coalesce(F.col(own.of(c)), F.lit("")) for c in (role, text))
    plain = _reads_back(render(role_, text_), role_, text_)
    out = own.rows.withColumn("escaped", ~plain)
    role_shown = F.when(F.col("escaped"), escape(role_)).otherwise(role_)
    text_shown = F.when(F.col("escaped"), escape(text_)).otherwise(text_)
    shown = render(role_shown, text_shown)
    kept = F.when(~F.col("escaped") | _reads_back(shown, role_, text_), shown).otherwise(F.raise_error(F.lit("a turn can't be read back")).cast("string"))
    start = F.length(role_shown) + len(OPEN) + len(BODY)
    start = F.when(role_ == "assistant", start).otherwise(F.lit(0))
    stop = F.when(role_ == "assistant", start + F.length(text_shown)).otherwise(F.lit(0))
    return own.back(out.withColumns({"segment": kept, "loss_start": start, "loss_stop": stop}), "segment", "loss_start", "loss_stop", "escaped")


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: the key, ``segments`` in order and ``loss``, a range for each segment."""
    rows = format_turns(df.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text")), "_role", "_text")
    turns = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_turn", F.coalesce("_role", F.lit("")), F.coalesce("_text", F.lit("")), "segment", "loss_start", "loss_stop"))).alias("turns"))
    return turns.select(
        F.col("_key").alias(key),
        F.transform("turns", lambda t: t["segment"]).alias("segments"),
        F.transform("turns", lambda t: F.struct(t["loss_start"].alias("start"), t["loss_stop"].alias("stop"))).alias("loss"),
    )


def formatted_text() -> Column:
    return F.array_join("segments", "")


def loss_text() -> Column:
    """The unescaped text under the loss mask."""
    parts = F.zip_with("segments", "loss", lambda s, m: unescape(F.substring(s, m["start"] + 1, m["stop"] - m["start"])))
    return F.array_join(parts, "")
