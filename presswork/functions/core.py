"""Small helpers for building column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as text code usually means it: the Unicode White_Space characters plus the
# four ASCII separators 0x1c-0x1f.  Counting words with the property takes about half the
# time of the (?U) flag, and a small part of that of the same set spelled out.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NON_SPACE = r"[^\p{IsWhite_Space}\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    The optimizer merges adjacent projections, which copies an expression into every
    place that uses it; binding it as a lambda variable keeps one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"{NON_SPACE}+"))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; no empty ones."""
    return F.filter(F.split(col(c), f"{SPACE}+", -1), lambda w: w != "")


def rfind(c: Column | str, char: str) -> Column:
    """Zero-based position of the last ``char``, -1 if there is none."""
    c = col(c)
    at = F.instr(F.reverse(c), char)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at)


def string_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def is_in(c: Column, values: Iterable[str]) -> Column:
    """Set membership; long lists become a hash set in the plan."""
    values = list(values)
    return c.isin(values) if values else F.lit(False)


def small_map(pairs: dict[str, str]) -> Column:
    """A constant map as one expression; keeps plans with many uses of it small."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a constant table, NULL if absent.

    Spark's map lookup is a linear scan, so the constants are cut into small maps that
    are chosen by the checksum of the key.
    """
    if not pairs:
        return F.lit(None).cast("string")
    n = max(1, len(pairs) // 4)
    buckets: list[list[Column]] = [[] for _ in range(n)]
    for k, v in pairs.items():
        buckets[zlib.crc32(k.encode("utf-8")) % n] += [F.lit(k), F.lit(v)]
    empty = F.create_map(F.lit(""), F.lit(None).cast("string"))
    table = F.array(*[F.create_map(*b) if b else empty for b in buckets])
    return F.try_element_at(F.get(table, (F.crc32(key) % n).cast("int")), key)
