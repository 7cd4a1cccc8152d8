"""Article fields: source names, preview and card texts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, strip, text_or_empty


def source_name(c: Column | str, default: str = "Unknown") -> Column:
    """Name of a source that arrives as text, as a JSON object with a name, or not at all."""
    c = col(c)
    named = F.get_json_object(c, "$.name")
    is_object = c.startswith("{")
    return strip(F.coalesce(F.when(is_object, named).otherwise(c), F.lit(default)))


def published_ts(c: Column | str) -> Column:
    """Timestamp of an ISO text; NULL when it cannot be read."""
    return F.try_to_timestamp(col(c))


# The texts and the date form that the next functions show.


def preview_title(c: Column | str) -> Column:
    stripped = strip(text_or_empty(c))
    return F.when(stripped == "", F.lit("Untitled Article")).otherwise(stripped)


def preview_description(c: Column | str) -> Column:
    d = strip(text_or_empty(c))
    return (
        F.when(d == "", F.lit("No description available"))
        .when(F.length(d) > 200, F.concat(F.substring(d, 1, 197), F.lit("...")))
        .otherwise(d)
    )


def preview_date(c: Column | str) -> Column:
    """``January 05, 2024 13:30``; unreadable text unchanged; nothing when missing."""
    c = text_or_empty(c)
    return F.when(c == "", F.lit("Date not available")).otherwise(
        F.coalesce(F.date_format(published_ts(c), "MMMM dd, yyyy HH:mm"), c)
    )


def source_line(source: Column | str, date: Column | str) -> Column:
    """Small print of a card: source and date in capitals."""
    return F.upper(
        F.concat_ws(" • ", F.coalesce(col(source), F.lit("Unknown")), text_or_empty(date))
    )


def entity_line(organizations: Column, people: Column, locations: Column, most: int = 3) -> Column:
    """``Organizations: a, b | People: c``; at most three names each, empty groups left out."""

    def group(label: str, names: Column) -> Column:
        shown = F.slice(F.filter(names, lambda n: n.isNotNull() & (n != "")), 1, most)
        return F.when(F.size(shown) > 0, F.concat(F.lit(label), F.array_join(shown, ", ")))

    return F.concat_ws(
        " | ",
        group("Organizations: ", organizations),
        group("People: ", people),
        group("Locations: ", locations),
    )


def tag(categories: Column | str) -> Column:
    """The one category shown on a card; NULL without categories."""
    return F.upper(F.get(col(categories), F.lit(0)))


def tags(categories: Column | str, most: int = 2) -> Column:
    """Up to two tags with their width in inches."""
    return F.transform(
        F.slice(col(categories), 1, most),
        lambda c: F.struct(
            F.upper(c).alias("label"),
            F.least(F.lit(1.5), F.length(c) * F.lit(0.15)).alias("width"),
        ),
    )


def issue_label(as_of: Column) -> Column:
    return F.concat(F.lit("ISSUE • "), F.date_format(as_of, "MMMM dd, yyyy"))
