"""Text expressions: list parsing, numeric cells, request screening, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^-?\d+(\.\d+)?$"


def numeric_cell(cell: Column) -> Column:
    """The number in a cell that is a clean numeric string, else NULL."""
    return F.when(cell.rlike(NUMERIC), cell.cast("double"))


def string_list(text: Column) -> Column:
    """The string elements of a JSON array; anything else gives an empty list."""
    values = F.from_json(text, "array<variant>", {"mode": "PERMISSIVE"})
    strings = F.transform(
        F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(strings, F.array().cast("array<string>"))


# Patterns of unscoped requests with their reasons, first match wins.
SCREEN = [
    (r"\bselect\s+\*", "unscoped SELECT * (all columns/rows)"),
    (r"\bselect\s+all\b", "SELECT ALL"),
    (r"\ball\s+(?:the\s+)?(?:data|records|rows|payments|cases|beneficiaries|dispositions|transactions|case_actions|tables)\b",
     "request for all records / the whole dataset"),
    (r"\bevery\s+(?:single\s+)?(?:record|row|payment|case|beneficiary|transaction)\b", "request for every record"),
    (r"\bentire\b[^.?!]{0,40}\b(?:table|database|dataset|queue|db|catalog|schema)\b",
     "request for an entire table/database"),
    (r"\bdump\s+(?:the\s+)?(?:entire\s+)?(?:\w+\s+)?(?:data|table|database|db|queue|everything|dataset)\b", "data dump"),
    (r"\b(?:dump|export|return|give\s+me|show\s+me|list|fetch|pull)\s+(?:me\s+)?everything\b",
     "request to return everything"),
    (r"\bfull\s+export\b", "full export"),
    (r"\bunrestricted\b", "unrestricted query"),
    (r"\b(?:no|without\s+(?:a\s+)?)\s*(?:filter|filters|where|limit|scope|restriction)\b",
     "query with no filter / limit / scope"),
]
# Keywords of the simpler second screen.
KEYWORDS = ["all data", "select *", "every record", "entire table", "dump the"]


def screen_match(text: Column) -> Column:
    """Struct (reason, matched) of the first pattern found, NULL when the request is scoped."""
    t, out = F.coalesce(text, F.lit("")), None
    for pattern, reason in SCREEN:
        found = f"(?i){pattern}"
        hit = F.struct(F.lit(reason).alias("reason"), F.regexp_extract(t, found, 0).alias("matched"))
        out = F.when(t.rlike(found), hit) if out is None else out.when(t.rlike(found), hit)
    return out


def keyword_hit(text: Column) -> Column:
    """The first of the literal keywords contained in the text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for word in KEYWORDS:
        out = F.when(low.contains(word), word) if out is None else out.when(low.contains(word), word)
    return out


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def age_label(at: Column, now: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", at, now)
    minutes = F.floor(seconds / 60)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)

    def label(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(days >= 1, label(days, "d")).when(hours >= 1, label(hours, "h"))
        .when(minutes >= 1, label(minutes, "m")).otherwise("just now")
    )
