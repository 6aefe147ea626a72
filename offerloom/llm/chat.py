"""Chat formatting: a state machine over roles, and text segments with loss flags.

A template declares the control strings, which roles are learned and which turn
may follow which. All is built from Spark expressions: turns of a conversation
are sorted into one array, the machine folds over its roles, and each turn
becomes three segments (opening, text, closing). Control strings inside texts
are escaped by a backslash, which escapes itself.

A conversation is one row, as its digest is taken over all of its turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + break + text + close for each turn. Control strings begin with "<|"."""

    open: str = "<|im_start|>"
    line: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    first: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )


CHATML = Template()
ROLE_BREAK = r"\\|\n|(?<=<)\|"  # what gets a backslash inside a role
TEXT_BREAK = r"\\|(?<=<)\|"  # and inside a text


def escape(text: Column, pattern: str = TEXT_BREAK) -> Column:
    return F.regexp_replace(text, f"({pattern})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def machine(roles: Column, template: Template) -> Column:
    """Place of the first turn that may not stand there, the number of turns if the end is missing, or null."""
    allowed = [F.lit(f"{a}>{b}") for a, after in template.steps.items() for b in after]
    start = F.struct(F.lit(template.first).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, role: Column) -> Column:
        wrong = s["bad"].isNull() & ~F.array_contains(F.array(*allowed), F.concat(s["state"], F.lit(">"), role))
        return F.struct(role.alias("state"), (s["at"] + 1).alias("at"), F.when(wrong, s["at"]).otherwise(s["bad"]).alias("bad"))

    def end(s: Column) -> Column:
        return F.coalesce(s["bad"], F.when(~s["state"].isin(*template.accepting), s["at"]))

    return F.aggregate(roles, start, step, end)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, bad_turn, segments (text, loss), formatted.

    Turns are ordered by turn, then role and text; rows that repeat are turns of
    their own. Null text and null role are empty, a null turn comes first, and
    rows without conv_id form one conversation. Conversations that break the
    turn order are formatted like others and named by bad_turn. Other columns
    are not looked at. An empty table gives an empty result.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            segment(F.concat(F.lit(template.open), escape(t["role"], ROLE_BREAK), F.lit(template.line)), F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template.learned)),
            segment(F.lit(template.close), F.lit(False)),
        )

    out = grouped.select(
        "conv_id",
        machine(F.transform("turns", lambda t: t["role"]), template).alias("bad_turn"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """Turns (role, text) that a formatted conversation holds."""
    chunks = F.split(formatted, "\\Q" + template.close + "\\E", -1)
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)  # nothing follows the last closing
    head = r"(?s)^\Q" + template.open + r"\E((?:[^\\\n]|\\.)*)\n(.*)$"
    return F.transform(chunks, lambda c: F.struct(unescape(F.regexp_extract(c, head, 1)).alias("role"), unescape(F.regexp_extract(c, head, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
