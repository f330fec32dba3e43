"""Warn, redact or block messages of conversations.

A request is the ordered messages of one conversation.  Scanning is per message
and needs no shuffle.  What depends on the whole conversation (the total, the
first bad message) is aggregated per conversation first, with partial sums in
each input partition, and joined back.  So no task ever holds a conversation,
and one with a third of all messages arrives as one row per partition.  The
join may then meet a hot key on the message side only, which adaptive execution
splits (see :mod:`inkveil.operators.joins`); the other side has one row per
conversation and is broadcast by Spark only below its size limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.detect import has_findings
from inkveil.functions.redaction import redact
from inkveil.functions.sqltext import column, expr
from inkveil.functions.text import text_length
from inkveil.operators.joins import join_per_key
from inkveil.operators.scan import policy_count, policy_detections
from inkveil.operators.summary import summary_text
from inkveil.plans.policy import ScanPolicy

CHARS_PER_TOKEN = 4


def join_text_parts(parts: str) -> Column:
    """Text of a message that comes in parts; NULL parts are not text."""
    return F.array_join(F.filter(parts, lambda part: part.isNotNull()), "\n")


def forwarded_role(role: Column) -> Column:
    """Every role but the user's is passed on as the assistant's."""
    return F.when(role == "user", "user").otherwise("assistant")


def forward(messages: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Messages as they are passed on: two roles, no NULL text."""
    return messages.withColumns(
        {role: forwarded_role(F.col(role)), text: F.coalesce(F.col(text), F.lit(""))}
    )


def conversation_totals(
    messages: DataFrame,
    conversation: str = "conv_id",
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Findings and affected messages per conversation that has any."""
    policy = policy or ScanPolicy.interception()
    return (
        messages.select(conversation, policy_count(text, policy).alias("_n"))
        .groupBy(conversation)
        .agg(F.sum("_n").alias("n_total"), F.count_if(F.col("_n") > 0).alias("n_messages_hit"))
        .where(F.col("n_total") > 0)
    )


def notice(total: Column, mode: str) -> Column:
    done = " and redacted" if mode == "redact" else ""
    text = F.concat(total.cast("string"), F.lit(f" sensitive value(s) detected{done}."))
    return F.when(total > 0, text)


def warn(
    messages: DataFrame,
    conversation: str = "conv_id",
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """All messages unchanged, with the total of their conversation and a notice."""
    totals = conversation_totals(messages, conversation, text, policy).drop("n_messages_hit")
    joined = join_per_key(messages, totals, conversation, "left")
    total = F.coalesce("n_total", F.lit(0))
    return joined.withColumns({"n_total": total, "notice": notice(total, "warn")})


def redact_messages(
    messages: DataFrame,
    text: str = "text",
    policy: ScanPolicy | None = None,
    *,
    mode: str = "safe",
) -> DataFrame:
    """Messages with findings rewritten, the others unchanged; no shuffle."""
    policy = policy or ScanPolicy.interception()
    return (
        messages.withColumn("_found", policy_detections(text, policy))
        .withColumns({text: redact(text, "_found", mode), "n_findings": F.size("_found")})
        .drop("_found")
    )


def blocked(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Blocked conversations: their first message with a finding and a report on it.

    Each input partition sends one row per bad conversation, with the counts of
    its first bad message there, not its text.
    """
    policy = policy or ScanPolicy.interception()
    scanned = messages.select(
        conversation, F.col(turn).alias("_turn"), policy_detections(text, policy).alias("_found")
    )
    report = F.struct(
        F.col("_turn").alias("turn"),
        F.size("_found").alias("n_findings"),
        summary_text("_found").alias("summary"),
    )
    bad = F.when(F.size("_found") > 0, F.array(report))
    hits = scanned.select(conversation, F.explode_outer(bad).alias("_hit"))
    first = (
        hits.where(F.col("_hit").isNotNull())
        .groupBy(conversation)
        .agg(F.min_by("_hit", "_hit.turn").alias("_hit"))
    )
    return first.select(
        conversation,
        F.col("_hit.turn").alias("blocked_turn"),
        "_hit.n_findings",
        "_hit.summary",
    )


def not_blocked(
    messages: DataFrame,
    conversation: str = "conv_id",
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Messages of the conversations that may go on."""
    policy = policy or ScanPolicy.interception()
    dirty = has_findings(text, policy.detectors, policy.min_severity)
    stopped = (
        messages.select(conversation, dirty.alias("_dirty"))
        .groupBy(conversation)
        .agg(F.bool_or("_dirty").alias("_dirty"))
        .where("_dirty")
    )
    return join_per_key(messages, stopped, conversation, "left_anti")


def check_prompts(
    messages: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Each prompt with what to do: forward it, or ask with a summary and both versions."""
    policy = policy or ScanPolicy.chat()
    found = messages.select(*keys, text, policy_detections(text, policy).alias("_found"))
    dirty = F.size("_found") > 0
    return found.select(
        *keys,
        F.when(dirty, "ask").otherwise("forward").alias("action"),
        F.size("_found").alias("n_findings"),
        F.when(dirty, summary_text("_found", with_severity=True)).alias("summary"),
        F.col(text).alias("original"),
        redact(text, "_found").alias("redacted"),
    )


def token_estimate(text: str, utf16: bool = False) -> Column:
    """Rough number of tokens of a text, from its code points or UTF-16 units."""
    chars = F.coalesce(expr(text_length(column(text), utf16)), F.lit(0))
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def conversation_tokens(
    messages: DataFrame,
    conversation: str = "conv_id",
    text: str = "text",
    *,
    utf16: bool = False,
) -> DataFrame:
    return messages.groupBy(conversation).agg(
        F.sum(token_estimate(text, utf16)).alias("n_tokens"), F.count(F.lit(1)).alias("n_messages")
    )
