"""Chat formatting: role automaton, declarative template, per-segment loss flags. DataFrame functions only.

``format_chats`` turns one row per turn into one row per conversation with the emitted segments. A template
lists, for each role, the text before and after its content and whether the content bears loss. Control
strings inside contents are escaped reversibly, so the formatted text splits back into its turns.

Defined results: a null text is the empty text; a null role is the empty role and is rejected by the automaton;
turns are ordered by turn, then role, then text (null first), so repeated or tied turns keep a fixed order and
all of them are kept; rows with a null conv_id form one conversation of their own; an empty table gives no rows;
columns other than the four named ones are ignored. A conversation is one row, so its turns meet in one task and
have to fit into it, those without a conv_id too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is emitted around a turn, and which contents bear loss.

    ``turn`` opens a turn and is followed by the role, ``content`` separates the role from the text and ``end``
    closes the turn. None of them, nor any string in ``reserved``, can appear inside an escaped text: each
    occurrence becomes ``escape`` and a letter. No marker may hold the first character of another one beyond
    its own first place, so a marker can't arise where a text meets a marker.
    """

    turn: str = "<|turn|>"
    content: str = "[TEXT]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\u001b"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; ``start`` is the first state.
    automaton: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")

    def codes(self) -> list[tuple[str, str]]:
        """Each control string with the sequence that stands for it inside texts; the escape character is first."""
        strings = [self.escape, self.turn, self.content, self.end, *self.reserved]
        return [(s, self.escape + chr(ord("A") + k)) for k, s in enumerate(strings)]


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` without control strings; ``unescaped`` gives it back."""
    for string, code in template.codes():
        text = F.replace(text, F.lit(string), F.lit(code))
    return text


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    """The inverse of ``escaped``."""
    for string, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(string))
    return text


def _final_state(turns: Column, template: Template) -> Column:
    """The state after the last turn, or the reason why the automaton stopped."""

    def step(state: Column, turn: Column) -> Column:
        out = F.when(state.startswith("rejected"), state)
        for at, moves in template.automaton.items():
            for role, to in moves.items():
                out = out.when((state == at) & (turn["role"] == role), F.lit(to))
        return out.otherwise(F.concat(F.lit("rejected: "), turn["role"], F.lit(" after "), state))

    return F.aggregate(turns, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, state, valid.

    ``segments`` is the ordered array of (text, loss); ``formatted`` is its concatenation; ``valid`` tells whether
    the automaton ends in an accepting state, and ``state`` where it ended. All conversations are formatted.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    loss = role.isin(*template.loss_roles)

    def segment(content: Column, bears: Column) -> Column:
        return F.struct(content.alias("text"), bears.alias("loss"))

    emitted = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            role.alias("role"),
            F.array(
                segment(F.concat(F.lit(template.turn), escaped(role, template), F.lit(template.content)), F.lit(False)),
                segment(escaped(text, template), loss),
                segment(F.lit(template.end), F.lit(False)),
            ).alias("segments"),
        ).alias("t"),
    )
    gathered = emitted.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = gathered.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"),
        _final_state(F.col("turns"), template).alias("state"),
    )
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "state",
        F.col("state").isin(*template.accepting).alias("valid"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    quoted = "\\Q{}\\E".format
    body = F.slice(F.split(formatted, quoted(template.end)), 1, F.size(F.split(formatted, quoted(template.end))) - 1)

    def turn(piece: Column) -> Column:
        inner = F.split(F.substring(piece, F.lit(len(template.turn) + 1), F.length(piece)), quoted(template.content))
        return F.struct(unescaped(inner[0], template).alias("role"), unescaped(inner[1], template).alias("text"))

    return F.transform(body, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
