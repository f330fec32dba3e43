"""What to scan for, settled before the plan is built."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from inkveil.functions.detectors import BUILT_IN, Detector, severity_rank

# --- fixed values: schemes and display levels -------------------------------
DOCUMENT_SCHEMES = ("file", "untitled")
DISPLAY_LEVELS = ("information", "warning", "error")


@dataclass(frozen=True)
class ScanPolicy:
    """Detectors to run and lowest severity to report.

    ``enabled=None`` runs all built-in detectors.  ``extra`` are detectors of the
    caller's own; they come after the built-in ones.  A policy that is not
    ``active`` scans nothing, and no verdict is given under it.
    """

    enabled: tuple[str, ...] | None = None
    min_severity: str = "low"
    active: bool = True
    extra: tuple[Detector, ...] = ()

    def __post_init__(self) -> None:
        severity_rank(self.min_severity)
        if self.enabled is not None:
            object.__setattr__(self, "enabled", tuple(self.enabled))

    @property
    def detectors(self) -> tuple[str | Detector, ...] | None:
        """What to hand to the column functions as ``enabled``."""
        if not self.active:
            return ()
        if not self.extra:
            return self.enabled
        names = tuple(d.name for d in BUILT_IN) if self.enabled is None else self.enabled
        return (*names, *self.extra)

    def with_(self, **changes: object) -> ScanPolicy:
        return replace(self, **changes)

    @classmethod
    def documents(cls, enabled: Iterable[str] = ()) -> ScanPolicy:
        """Documents while they are edited; an empty list of detectors means all."""
        return cls(tuple(enabled) or None, "medium")

    @classmethod
    def chat(cls, enabled: Iterable[str] = ()) -> ScanPolicy:
        """Prompts that a user asks to have checked."""
        return cls(tuple(enabled) or None, "medium")

    @classmethod
    def interception(cls, enabled: Iterable[str] = ()) -> ScanPolicy:
        """Messages on their way to a model: everything is reported."""
        return cls(tuple(enabled) or None, "low")

    @classmethod
    def batch(cls, enabled: Iterable[str] = (), min_severity: str = "low") -> ScanPolicy:
        """Files and tables."""
        return cls(tuple(enabled) or None, min_severity)
