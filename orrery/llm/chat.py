"""Chat formatting: conversations to training texts with a loss mask, by a declarative template and a state machine over roles.

All of it is DataFrame expressions, linear in a conversation's length. A conversation's turns are put in order of (turn, role,
text), so repeated rows and ties stay and have one place each. The result of ``format_chats`` has, for each conversation, the formatted text and its
segments; a segment is a span of code points of that text with a loss flag. ``read_chats`` goes the other way.

Defined results: a null text or role counts as empty; rows with a null conv_id form one conversation; rows with a null
turn come first; an unknown role is formatted without loss and makes the conversation invalid; an empty table gives an
empty result; further columns are ignored. One conversation is one output text, so it must
fit in one cell (2 GB at four bytes a code point).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers round a turn, roles whose text is learnt, and the state machine.

    ``moves`` maps a state to the roles that may follow; a role taken is the next state. A conversation is valid when it
    only makes such moves and stops in one of ``final``. Markers must start with ``control``; ``control`` and the escape
    character itself are escaped inside texts and roles, so a marker can only stand where the template put it.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = ""
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.open.startswith(self.control) and self.close.startswith(self.control)) or self.escape in self.control or len(self.escape) != 1:
            raise ValueError("markers must start with the control string, which must not hold the escape character")


DEFAULT = ChatTemplate()


def escaped(c: Column, t: ChatTemplate) -> Column:
    """The escape character becomes itself and ``b``, the control string the escape character and ``o``."""
    return F.replace(F.replace(c, F.lit(t.escape), F.lit(t.escape + "b")), F.lit(t.control), F.lit(t.escape + "o"))


def unescaped(c: Column, t: ChatTemplate) -> Column:
    return F.replace(F.replace(c, F.lit(t.escape + "o"), F.lit(t.control)), F.lit(t.escape + "b"), F.lit(t.escape))


def _header(role: Column, t: ChatTemplate) -> Column:
    return F.replace(escaped(role, t), F.lit("\n"), F.lit(t.escape + "n"))


def _role(header: Column, t: ChatTemplate) -> Column:
    return unescaped(F.replace(header, F.lit(t.escape + "n"), F.lit("\n")), t)


def _end_state(turns: Column, t: ChatTemplate) -> Column:
    """Runs the state machine; null is the state from which nothing leads on."""

    def step(state: Column, turn: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for source, roles in t.moves.items():
            out = out.when((state == source) & turn["role"].isin(*roles), turn["role"])
        return out

    return F.aggregate(turns, F.lit(t.start).cast("string"), step)


def format_chats(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, n_turns, valid, formatted, segments (array of start, length, loss), in code points from 0."""
    t = template
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = rows.select("conv_id", "turn", role, text)
    head = F.concat(F.lit(t.open), _header(F.col("role"), t), F.lit("\n"))
    parts = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.col("text"), t).alias("body"))
    n_head, n_body, n_close = F.char_length("head").cast("long"), F.char_length("body").cast("long"), F.lit(len(t.close)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n_head + n_body + n_close).over(before), F.lit(0).cast("long"))
    placed = parts.select("conv_id", start.alias("start"), "role", F.concat("head", "body", F.lit(t.close)).alias("piece"), n_head.alias("head"), n_body.alias("body"))
    # A turn's start orders it: no turn is empty, so starts differ.
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "role", "piece", "head", "body"))).alias("turns"))

    def spans(turn: Column) -> Column:
        span = lambda at, n, loss: F.struct(at.alias("start"), n.alias("length"), loss.alias("loss"))
        body = turn["start"] + turn["head"]
        return F.array(span(turn["start"], turn["head"], F.lit(False)), span(body, turn["body"], turn["role"].isin(*t.loss_roles)), span(body + turn["body"], n_close, F.lit(False)))

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(_end_state(F.col("turns"), t).isin(*t.final), F.lit(False)).alias("valid"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.flatten(F.transform("turns", spans)).alias("segments"),
    )


def read_chats(chats: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, valid, formatted, turns (array of role, text) and loss_text, read back from ``formatted`` and ``segments`` alone."""
    t = template
    raw = F.split(F.col("formatted"), "\\Q" + t.close + "\\E", -1)
    bodies = F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0)))

    def turn(body: Column) -> Column:
        inner = F.substr(body, F.lit(len(t.open) + 1))
        line = F.instr(inner, "\n")
        return F.struct(
            _role(F.substr(inner, F.lit(1), line - 1), t).alias("role"),
            unescaped(F.substr(inner, line + 1), t).alias("text"),
        )

    def learnt(wide: Column) -> Column:
        """The text of each segment under the mask, cut from four bytes a code point: any place is reached at once."""
        cut = lambda s: F.decode(F.substr(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")
        return F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(cut(s), t))

    # The array holds the wide text, so that it is made once and not for each segment.
    texts = F.flatten(F.transform(F.array(F.encode("formatted", "UTF-32")), learnt))
    return chats.select("conv_id", "valid", "formatted", F.transform(bodies, turn).alias("turns"), F.array_join(texts, "").alias("loss_text"))
