"""Find, redact and gate sensitive data in tables and streams of text."""

from inkveil.functions.detect import counts_by_type, detections, finding_count, has_findings
from inkveil.functions.detectors import (
    DETECTORS,
    Detector,
    detector_catalog,
    register_detector,
)
from inkveil.functions.entropy import shannon_entropy
from inkveil.functions.redaction import only, redact
from inkveil.operators.redact import redacted
from inkveil.operators.scan import findings, scan
from inkveil.plans.policy import ScanPolicy

__all__ = [
    "DETECTORS",
    "Detector",
    "ScanPolicy",
    "counts_by_type",
    "detections",
    "detector_catalog",
    "finding_count",
    "findings",
    "has_findings",
    "only",
    "redact",
    "redacted",
    "register_detector",
    "scan",
    "shannon_entropy",
]
