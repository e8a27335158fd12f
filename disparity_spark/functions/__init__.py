"""Column expressions: labels, guarded arithmetic, text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "nan"


def group_label(*columns: str) -> Column:
    """One column: its value as a string. Several: "a=x | b=y". Missing values are the label "nan"."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    if len(columns) == 1:
        return value(columns[0])
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), value(c)) for c in columns])


def is_binary(c: Column) -> Column:
    return F.coalesce(c.cast("double").isin(0.0, 1.0), F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0: an undefined rate is neither 0 nor NaN."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def confidence(c: Column) -> Column:
    """A judge's confidence: a number within 0..1, and 0 for anything else."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(clamp(x))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...[truncated]"))).otherwise(text)


def unquoted(text: Column) -> Column:
    return F.translate(text, '"', "'")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders replaced; doubled braces stand for single ones."""
    low, high = "\x01", "\x02"
    text = F.replace(F.replace(template, F.lit("{{"), F.lit(low)), F.lit("}}"), F.lit(high))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return F.replace(F.replace(text, F.lit(low), F.lit("{")), F.lit(high), F.lit("}"))


def json_object(text: Column) -> Column:
    """The stretch from the first { to the last }, as a string; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def usable_number(c: Column) -> Column:
    """The number, or null for NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


# Text transforms of the metamorphic relations.


def case_folded(text: Column) -> Column:
    return F.lower(text)


def spaced_once(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def prefixed(text: Column, prefix: str = "Please answer the following. ") -> Column:
    return F.concat(F.lit(prefix), text)


def dates_in_words(text: Column) -> Column:
    """ISO dates that exist, written as in "Jan 5, 2026"; other digits stay."""
    parts = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    known = F.array_distinct(F.filter(parts, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull()))
    return F.aggregate(known, text, lambda t, d: F.replace(t, d, F.date_format(F.try_to_date(d, "yyyy-MM-dd"), "MMM d, yyyy")))


def reversed_fields(row: Column) -> Column:
    """An array of (name, value) structs in reverse order."""
    return F.reverse(row)
