"""Threat and intensity level rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the detection rules (must stay equal to the original service):
# threat: benign -> None, confidence > 0.9 -> High, > 0.7 -> Medium, else Low.
# intensity over the trailing window: count <= 5 Low, <= 10 Medium, else High.
# replay interval per mode in milliseconds: Low 2000, Medium 1000, High 500.
THREAT_HIGH = 0.9
THREAT_MEDIUM = 0.7
LOW_MAX = 5
MEDIUM_MAX = 10
MODE_INTERVAL_MS = {"Low": 2000, "Medium": 1000, "High": 500}


def threat_level(label, confidence, benign: str = "BENIGN",
                 high: float = THREAT_HIGH, medium: float = THREAT_MEDIUM) -> Column:
    """Strict comparisons, as in the service: exactly 0.9 is Medium."""
    label = F.col(label) if isinstance(label, str) else label
    confidence = F.col(confidence) if isinstance(confidence, str) else confidence
    return (F.when(F.upper(label) == F.lit(benign.upper()), F.lit("None"))
            .when(confidence > F.lit(high), F.lit("High"))
            .when(confidence > F.lit(medium), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def intensity_level(count, low_max: int = LOW_MAX, medium_max: int = MEDIUM_MAX) -> Column:
    """Level of a trailing count; null for a null count."""
    count = F.col(count) if isinstance(count, str) else count
    return (F.when(count <= F.lit(low_max), F.lit("Low"))
            .when(count <= F.lit(medium_max), F.lit("Medium"))
            .when(count > F.lit(medium_max), F.lit("High")))
