"""The detectors: what they look for and how a finding is labelled.

A detector is plain data.  Nothing here runs on rows;
:mod:`inkveil.functions.detect` turns detectors into one expression.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inkveil.functions import patterns as P
from inkveil.functions.cards import card_number_sql
from inkveil.functions.entropy import THRESHOLD, distinct_needed, entropy_message_sql
from inkveil.functions.sqltext import literal

# --- fixed values: severities, lowest first ---------------------------------
SEVERITIES = ("low", "medium", "high", "critical")
CATEGORIES = ("pii", "secret", "credential", "token")


@dataclass(frozen=True)
class Detector:
    """One kind of sensitive value.

    ``pattern`` is a Java regular expression; the span is ``group`` of the
    match, which must end where the match ends.  Matches are taken leftmost and
    without overlap first, and only then checked, so a rejected match still
    uses up its text.

    ``literals`` are strings of which at least one is in every match: texts
    without any are passed over by a byte search.

    ``screen`` is a cheaper pattern found in every text with a match; detectors
    with the same screen share one test.

    ``check`` is SQL text over ``value`` that gives the message of a match, or
    NULL to reject it.

    ``within`` is SQL text over ``text`` that gives the beginning of the text that
    holds all matches, where searching the rest would cost too much.

    ``finder`` replaces the pattern by SQL text over ``text`` that gives an
    ``array<struct<start:int,end:int>>`` of spans, in order and not overlapping.
    """

    name: str
    category: str
    severity: str
    message: str
    description: str = ""
    pattern: str | None = None
    literals: tuple[str, ...] = ()
    group: int = 0
    check: str | None = None
    finder: str | None = None
    screen: str | None = None
    within: str | None = None

    def __post_init__(self) -> None:
        severity_rank(self.severity)
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category!r}")
        if (self.pattern is None) == (self.finder is None):
            raise ValueError(f"{self.name}: give either a pattern or a finder")


def severity_rank(severity: str) -> int:
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}, expected one of {SEVERITIES}")
    return SEVERITIES.index(severity)


def entropy_detector(threshold: float = THRESHOLD) -> Detector:
    """The high-entropy detector, with the threshold of your choice."""
    return Detector(
        name="high-entropy-string",
        category="secret",
        severity="medium",
        message="High-entropy string detected",
        description="High-entropy strings (Shannon > 4.5)",
        pattern=P.TOKEN_RUN,
        check=entropy_message_sql("value", threshold),
        screen=P.long_run(max(P.TOKEN_RUN_MIN, distinct_needed(threshold))),
    )


# --- fixed values: names, order, labels, messages and descriptions ----------
BUILT_IN: tuple[Detector, ...] = (
    Detector(
        "email",
        "pii",
        "medium",
        "Email address detected",
        "Email addresses (RFC 5322)",
        P.EMAIL,
        ("@",),
    ),
    Detector(
        "phone-number",
        "pii",
        "medium",
        "Phone number detected",
        "International phone numbers",
        P.PHONE,
        ("+",),
    ),
    Detector(
        "ssn",
        "pii",
        "high",
        "Social Security Number detected",
        "US Social Security Numbers",
        P.SSN,
        ("-",),
        screen=P.NINE_DIGITS,
    ),
    Detector(
        "credit-card",
        "pii",
        "high",
        "Credit card number detected (Luhn validated)",
        "Credit card numbers (Luhn validated)",
        P.CARD,
        screen=P.NINE_DIGITS,
        check=(
            f"CASE WHEN {card_number_sql('value')}"
            " THEN 'Credit card number detected (Luhn validated)' END"
        ),
    ),
    Detector(
        "aws-access-key",
        "secret",
        "critical",
        "AWS Access Key ID detected",
        "AWS Access Key IDs",
        P.AWS_ACCESS_KEY,
        ("AKIA",),
    ),
    Detector(
        "aws-secret-key",
        "secret",
        "critical",
        "AWS Secret Access Key detected",
        "AWS Secret Access Keys",
        P.AWS_SECRET_KEY,
        ("aws_secret_access_key", "AWS_SECRET_ACCESS_KEY"),
        group=1,
        screen="_",
    ),
    Detector(
        "github-pat",
        "secret",
        "critical",
        "GitHub Personal Access Token detected",
        "GitHub Personal Access Tokens",
        P.GITHUB_PAT,
        ("ghp_", "github_pat_"),
        screen="_",
    ),
    Detector(
        "stripe-key",
        "secret",
        "critical",
        "Stripe API key detected",
        "Stripe API keys",
        P.STRIPE_KEY,
        ("_live_", "_test_"),
        screen="_",
    ),
    Detector(
        "google-api-key",
        "secret",
        "high",
        "Google API key detected",
        "Google API keys",
        P.GOOGLE_API_KEY,
        ("AIza",),
    ),
    Detector(
        "google-oauth-secret",
        "secret",
        "critical",
        "Google OAuth client secret detected",
        "Google OAuth client secrets",
        P.GOOGLE_OAUTH_SECRET,
        ("client_secret", "GOOGLE_CLIENT_SECRET"),
        group=1,
        screen="_",
    ),
    Detector(
        "ssh-private-key",
        "secret",
        "critical",
        "SSH private key detected",
        "SSH private keys (RSA, ED25519)",
        P.PRIVATE_KEY_BLOCK,
        ("-----END ",),
        within=f"regexp_extract(text, {literal(P.UP_TO_LAST_KEY)}, 0)",
    ),
    Detector("jwt", "token", "high", "JWT token detected", "JWT tokens", P.JWT, (".eyJ",), 1),
    Detector(
        "db-connection-string",
        "credential",
        "critical",
        "Database connection string detected",
        "Database connection strings",
        P.DATABASE_URL,
        ("sql://", "postgres://", "mongodb"),
        screen="://",
    ),
    entropy_detector(),
)

DETECTORS: dict[str, Detector] = {d.name: d for d in BUILT_IN}


def register_detector(
    name: str,
    pattern: str | None = None,
    *,
    category: str = "secret",
    severity: str = "medium",
    message: str | None = None,
    description: str = "",
    literals: Iterable[str] = (),
    group: int = 0,
    accept: str | None = None,
    finder: str | None = None,
) -> Detector:
    """A detector of your own, to be run by the policies that carry it::

        ScanPolicy(extra=(register_detector("order-id", "ORD-[0-9]+"),))

    ``accept`` is a condition over ``value`` in SQL text, such as
    ``"length(value) > 8"``; matches that do not meet it are dropped.
    """
    if name in DETECTORS:
        raise ValueError(f"detector {name!r} is built in")
    text = message or f"{name} detected"
    check = None if accept is None else f"CASE WHEN {accept} THEN {literal(text)} END"
    return Detector(
        name, category, severity, text, description, pattern, tuple(literals), group, check, finder
    )


def selected(
    enabled: Iterable[str | Detector] | None = None, min_severity: str = "low"
) -> list[tuple[int, Detector]]:
    """Detectors to put into the plan, with their ordinals.

    ``enabled=None`` means all built-in ones, an empty list none; unknown names are
    ignored, detectors that are not built in are taken as they are, in order.  A
    detector has one severity, so the threshold is settled here as well.
    """
    floor = severity_rank(min_severity)
    listed = list(DETECTORS) if enabled is None else list(enabled)
    extra = [d for d in listed if isinstance(d, Detector)]
    names = {d for d in listed if isinstance(d, str)}
    own = [d.name for d in extra]
    if len(set(own)) < len(own) or set(own) & set(DETECTORS):
        raise ValueError(f"names of detectors must differ: {own}")
    chosen = [entry for entry in enumerate(DETECTORS.values()) if entry[1].name in names]
    chosen += enumerate(extra, len(DETECTORS))
    return [(ordinal, d) for ordinal, d in chosen if severity_rank(d.severity) >= floor]


def detector_catalog(spark: SparkSession) -> DataFrame:
    """One row per detector: a small table to join with findings."""
    rows = [
        (n, d.name, d.category, d.severity, d.description)
        for n, d in enumerate(DETECTORS.values())
    ]
    schema = "ordinal int, name string, category string, severity string, description string"
    return spark.createDataFrame(rows, schema)
