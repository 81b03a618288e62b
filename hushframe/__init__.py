"""Find and mask personal data in Spark tables, documents and streams."""

from hushframe.plans.policy import Detection, OverlayRule, PathLabel, Policy
from hushframe.plans.jobs import (
    mask_documents,
    mask_table,
    mask_and_report,
    masking_report,
    propose_from_values,
    propose_labels,
)

__all__ = [
    "Detection",
    "OverlayRule",
    "PathLabel",
    "Policy",
    "mask_documents",
    "mask_table",
    "mask_and_report",
    "masking_report",
    "propose_from_values",
    "propose_labels",
]
