"""Chat formatting: a finite-state machine over roles, and segments with loss flags.

A template says how a turn is marked, which order of roles is valid and whose
texts are trained on. A conversation becomes a list of segments, text and loss
flag each; put together they are the formatted string. Control strings inside
texts are escaped so that ``parsed`` gets back every role and text.

Results: turns are ordered by turn, then role, then text, NULL first; NULL roles
and texts are empty strings. Repeated rows are repeated turns. A NULL conv_id is a
conversation of its own. A conversation whose order of roles is invalid is
formatted all the same, with ``valid`` false and the place of the first turn that
broke the order, or the number of turns if it ended too early. Extra columns are
not read. An empty table gives no rows. A conversation is one record, so its turns
come together in one task; conversations are not split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``opening role middle text closing`` for each turn.

    ``moves`` are the transitions of the machine, from a state over a role to the
    state of the same name; it begins in `start` and must end in one of ``ends``.
    """

    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    def escapes(self, role: bool = False) -> dict[str, str]:
        """What control strings in texts and roles become; a backslash is doubled before."""
        codes = {self.opening.strip(): "\\h", self.closing.strip(): "\\t"}
        return codes | {self.middle.strip(): "\\c"} if role else codes


CHAT = Template()


def escaped(text: Column, template: Template, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in template.escapes(role).items():
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    def plain(part: Column) -> Column:
        for control, code in template.escapes(role=True).items():
            part = F.replace(part, F.lit(code), F.lit(control))
        return part

    # doubled backslashes are found from the left, so what is left begins an escape
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, plain), "\\")


def _machine(turns: Column, template: Template) -> Column:
    """Final state, and the place of the first turn that had no transition."""
    known = F.create_map(
        *[
            F.lit(x)
            for state, roles in template.moves.items()
            for role in roles
            for x in (f"{state}\n{role}", True)
        ]
    )
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("broke"))

    def move(now: Column, turn: Column) -> Column:
        allowed = F.element_at(known, F.concat(now["state"], F.lit("\n"), turn["role"])).isNotNull()
        broke = F.when((now["broke"] < 0) & ~allowed, now["at"]).otherwise(now["broke"])
        return F.struct(
            turn["role"].alias("state"), (now["at"] + 1).alias("at"), broke.alias("broke")
        )

    return F.aggregate(turns, begin, move)


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: ``conv_id, segments, formatted, valid, broke_at``."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        mark = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
        head = F.concat(
            F.lit(template.opening), escaped(t["role"], template, True), F.lit(template.middle)
        )
        body = F.struct(
            escaped(t["text"], template).alias("text"),
            t["role"].isin(*template.trained).alias("loss"),
        )
        return F.array(mark(head), body, mark(F.lit(template.closing)))

    end = _machine(F.col("turns"), template)
    early = ~F.col("end.state").isin(*template.ends)
    broke = F.when(F.col("end.broke") >= 0, F.col("end.broke")).when(early, F.col("end.at"))
    return (
        whole.withColumn("segments", F.flatten(F.transform("turns", segments)))
        .withColumn("end", end)
        .withColumn("broke_at", broke)
        .select(
            "conv_id",
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("broke_at").isNull().alias("valid"),
            "broke_at",
        )
    )


def parsed(text: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted string, as an array of role and text."""
    pieces = F.split(text, rf"\Q{template.closing}\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # the last one ends the string

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, template.middle)
        role = F.substring(piece, F.lit(len(template.opening) + 1), cut - len(template.opening) - 1)
        body = F.substring(piece, cut + len(template.middle), F.length(piece))
        return F.struct(
            unescaped(role, template).alias("role"), unescaped(body, template).alias("text")
        )

    return F.transform(pieces, turn)


def trained_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")


def digests(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """What is read back from the formatted conversations."""
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return (
        formatted(conversations, template)
        .withColumn("turns", parsed(F.col("formatted"), template))
        .withColumn("trained", trained_text(F.col("segments"), template))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("trained").cast("long").alias("loss_chars"),
            F.sha2("trained", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
            F.col("broke_at").cast("long").alias("broke_at"),
        )
    )
