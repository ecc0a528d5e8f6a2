"""Column expressions shared by the analyses. Everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from editlore.vocabulary import CHANGE_TYPES, REPAIR_KEYWORDS

MICROS_PER_DAY = 86_400_000_000


def flag(condition: Column) -> Column:
    """0/1 for a condition; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def days_between(later: Column, earlier: Column) -> Column:
    """Span in days with fraction."""
    return micros_between(later, earlier) / F.lit(float(MICROS_PER_DAY))


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed days, rounded down for negative spans too."""
    span = micros_between(later, earlier)
    return F.floor(span / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def time_of_day(at: Column) -> Column:
    hour = F.hour(at)
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 19), "afternoon").otherwise("night")


def is_weekend(at: Column) -> Column:
    return F.weekday(at) > 4


def time_of_week(at: Column) -> Column:
    return F.when(is_weekend(at), "weekend").otherwise("weekday")


def decimals(value: Column, places: int) -> Column:
    """A double as text with ``places`` decimals. Its exact binary value is rounded, halves to even, as C does; ``format_string`` rounds the shortest
    decimal that stands for it, halves up."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def json_text(value: Column) -> Column:
    """First element of a JSON array, or a JSON scalar, as text; objects (``{}`` = no value) give NULL."""
    scalar = F.when(~F.substring(value, 1, 1).isin("{", "["), F.get_json_object(value, "$"))
    return F.coalesce(F.get_json_object(value, "$[0]"), scalar)


def empty_object_to_null(value: Column) -> Column:
    return F.when(value != "{}", value)


def comment_has_keyword(comment: Column) -> Column:
    return flag(comment.rlike("(?i)" + "|".join(REPAIR_KEYWORDS)))


def without_first_section(comment: Column) -> Column:
    """Drop the first ``/* … */``; the part of the comment that software wrote."""
    return F.regexp_replace(comment, r"(?s)^(.*?)/\*.*?\*/", "$1")


def mentions_repair(cleaned: Column) -> Column:
    """Some repair word that follows a blank, in any case."""
    words = [k.strip() for k in REPAIR_KEYWORDS]
    return cleaned.rlike("(?i) (" + "|".join(words) + ")")


def comma_list(text: Column) -> Column:
    """Trimmed elements of a comma-separated list; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(text, ","), lambda item: F.trim(item)))


def canonical_label(label: Column) -> Column:
    """``value_update`` under its full name, whether or not it is prefixed already."""
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"(?<!property_)value_update", "property_value_update")


def change_type_list(change_type: Column, label: Column) -> Column:
    """Both comma lists of a change in one array, blanks removed."""
    both = F.concat(comma_list(F.coalesce(change_type, F.lit(""))), comma_list(canonical_label(label)))
    return F.filter(both, lambda item: item != "")


def change_type_flags(labels: Column, types: list[str] = CHANGE_TYPES) -> list[Column]:
    return [F.array_contains(labels, t).cast("int").alias(t) for t in types]


# Cyrillic letters that look like these Latin ones.
LOOKALIKES = ("аеорсіѕ", "aeopcis")


def plain_latin(text: Column) -> Column:
    return F.translate(text, *LOOKALIKES)


def id_number(uri: Column) -> Column:
    """The number at the end of an entity or property URI."""
    return F.regexp_extract(uri, r"[QP](\d+)>?$", 1).try_cast("bigint")


def rounded(name: str, column: str) -> str:
    """SQL for showing the double ``column``, called ``name``, with a fixed number of decimals.

    Averages and quantiles of microsecond gaps often end exactly half-way between two decimals of a second, where
    the last bit decides. Times are moved off those points by a fraction of a microsecond and get three decimals.
    """
    if any(part in name for part in ("_sec", "time_between", "_time_bc_")):
        return f"round({column} + 0.000000137, 3)"
    return f"round({column}, 6)"
