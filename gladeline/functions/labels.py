"""Labels derived from a parcel's own loss share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gladeline.functions.numbers import nan_to_null

# fixed values: median loss share of affected parcels, class names, and the wording shown for them
MEDIAN_AFFECTED_PCT = 5.3755
RISK_CLASSES = ("LOW", "MEDIUM", "HIGH")
COMPLIANCE = {"LOW": "Compliant", "MEDIUM": "Needs review", "HIGH": "Non-compliant"}


def risk_class(pct: Column, t: float = MEDIAN_AFFECTED_PCT) -> Column:
    """LOW without loss, MEDIUM up to ``t`` percent, HIGH above; unknown shares have no class."""
    share = nan_to_null(pct)
    return F.when(share == 0, "LOW").when(share <= F.lit(t), "MEDIUM").when(share > F.lit(t), "HIGH")


def risk_binary(pct: Column) -> Column:
    """AFFECTED with any loss, CLEAN without; unknown shares have no label."""
    share = nan_to_null(pct)
    return F.when(share > 0, "AFFECTED").when(share <= 0, "CLEAN")


def compliance_label(cls: Column) -> Column:
    """Wording for a class; NULL for an unknown class."""
    label = F.lit(None).cast("string")
    for name, wording in COMPLIANCE.items():
        label = F.when(cls == name, wording).otherwise(label)
    return label
