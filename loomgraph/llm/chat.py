"""Conversations as text segments with loss flags, by a state machine over roles. Native."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECTED = "rejected"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, the roles that are learned, and the moves between states.

    `moves` maps a state and a role to the next state; what it lacks is a rejection, which no
    move leaves. Control strings all begin with `control`.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    control: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    first_state: str = "start"
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


DEFAULT = ChatTemplate()


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The text without any control string: backslashes doubled, one put into each control."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(template.control), F.lit(_broken(template.control)))


def unescape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    whole = F.replace(text, F.lit(_broken(template.control)), F.lit(template.control))
    return F.replace(whole, F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def walk(roles: Column, template: ChatTemplate = DEFAULT) -> Column:
    """struct(state, accepted): the state after all roles, and how many were accepted."""
    moves = F.create_map(
        *(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to))
    )

    def step(at: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit(" "), role))
        return F.struct(
            F.coalesce(to, F.lit(REJECTED)).alias("state"),
            (at["accepted"] + to.isNotNull().cast("int")).alias("accepted"),
        )

    begin = F.struct(F.lit(template.first_state).alias("state"), F.lit(0).alias("accepted"))
    return F.aggregate(roles, begin, step)


def format_chats(turns: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row per conversation of `turns(conv_id, turn, role, text)`.

    Returns conv_id, segments array<struct<text, loss>>, formatted, state, accepted (turns before
    the first one the machine rejects) and valid. A rejected conversation is formatted all the
    same, for its caller to drop. Turns go by turn, then role, then text; repeated rows are turns
    of their own. A null text or role is empty, and an empty role is never accepted. Rows with a
    null conv_id are one conversation. Extra columns are left out. A conversation is one row of
    the result, so it has to fit into a task's memory; its turns are shuffled once.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "turn",
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )
    rows = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(ordered.alias("turns"))

    def pieces(turn: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.start), _escape_role(turn["role"]), F.lit("\n"))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(turn["text"], template), turn["role"].isin(*template.learned)),
            piece(F.lit(template.end + "\n"), F.lit(False)),
        )

    return rows.select(
        "conv_id",
        F.flatten(F.transform("turns", pieces)).alias("segments"),
        walk(F.transform("turns", lambda t: t["role"]), template).alias("end"),
    ).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("end.state").alias("state"),
        F.col("end.accepted").alias("accepted"),
        (F.col("end.state") != REJECTED).alias("valid"),
    )


def parse_chat(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.split(formatted, re.escape(template.end + "\n"))

    def read(turn: Column) -> Column:
        body = F.substr(turn, F.lit(len(template.start) + 1))
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        return F.struct(_unescape_role(role).alias("role"), unescape(text, template).alias("text"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), read)


def learned_text(segments: Column, template: ChatTemplate = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"], template)), "")
