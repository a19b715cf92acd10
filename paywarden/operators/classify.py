"""Labels for the distinct signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in the signal text that decide its category, first match wins.
KEYWORDS = [
    ("fraud", ["duplicate", "deceased", "fraud"]),
    ("eligibility", ["income", "employment", "residence", "benefit"]),
    ("administrative", ["manual", "review", "workflow", "quality"]),
]


def keyword_category(text: Column) -> Column:
    out = None
    for category, words in KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def distinct_signals(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("signal").isNotNull()).select(
        "signal", F.replace("signal", F.lit("_"), F.lit(" ")).alias("signal_text")).distinct()


def classify_signals(flags: DataFrame, classifier: Callable[[Column], Column] = keyword_category) -> DataFrame:
    """One label per distinct signal.

    The classifier is any Column → Column function; a pandas UDF around a model fits the same slot.
    Only distinct values are labelled, so its cost does not grow with the flags.
    """
    return distinct_signals(flags).select(
        "signal", classifier(F.col("signal_text")).alias("signal_category"),
        F.lit(None).cast("double").alias("classification_confidence"),
        F.lit(None).cast("string").alias("classification_error"))


def require_all_classified(labels: DataFrame) -> DataFrame:
    """Fails the run when a signal got no label; one bounded look at the labels."""
    missing = labels.filter(F.col("signal_category").isNull())
    if not missing.isEmpty():
        raise RuntimeError("classification returned no category for at least one signal")
    return labels
