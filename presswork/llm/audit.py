"""Interaction audit of a chain of filters by the Hart-Mas-Colell potential.

A coalition is a set of filters; its worth is the number of documents that they remove
together.  All coalitions of a part are worked out from one small table, the number of
documents by set of failed filters (at most ``2 ** n`` rows a part), so the corpus is read
once and orders of the filters cost nothing.

*   The potential of a coalition follows from those with one filter less,
    ``P(S) = (v(S) + sum of P(S without i)) / |S|``, ``P(empty) = 0``.  A filter's Shapley
    value is the grand potential less the potential without that filter.  Everything is
    kept ``n!`` times as large, which makes each potential a whole number.
*   What a filter removes after others is the difference of two coalitions: with it and
    without it.

Only narrow rows are shuffled: a key of the text, the id, the part and a bit mask.  A text,
or a part with a third of all rows is counted per task before it is sent; joins are by id,
and adaptive execution splits those of an id that is repeated as often.

Defined cases: null text is empty; a null part and an empty one are the same part; rows
without id repeat nothing and are repeated by nothing; rows of one id and one text do not
repeat each other; a label that is null or absent counts for nothing, and of repeated labels
the largest counts; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.session import written

#: More filters than these would give more than 720 orders a part.
MOST_FILTERS = 6


def failed(failures: list[Column]) -> Column:
    """The filters that fail, filter ``i`` as bit ``i``; null does not fail."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)), F.lit(0)).cast("int")


def mark_repeats(rows: DataFrame, id_col: str, key: str, mask: str, bit: int) -> DataFrame:
    """``rows`` with ``bit`` added to ``mask`` where a smaller id has the same ``key``.

    The smallest id of a key is found by partial minima, and rows look for themselves among
    these by key and id, so the rows of one key are spread by their ids.
    """
    firsts = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(id_col).alias("_first"))
    met = rows.join(firsts, (F.col(key) == F.col("_key")) & (F.col(id_col) == F.col("_first")), "left")
    later = F.col(id_col).isNotNull() & F.col("_first").isNull()
    return met.withColumn(mask, F.col(mask).bitwiseOR(F.when(later, 1 << bit).otherwise(0))).select(*rows.columns)


def coalitions(rows: DataFrame, n_filters: int, part: str, mask: str, measures: list[str]) -> DataFrame:
    """One row per part: (part, total, removed, <measure>..., alone, potential).

    Arrays over all coalitions, coalition ``S`` at the place ``S``: documents ``removed``,
    how many of them have each 0/1 ``measure``, and ``n!`` times the potential.  ``alone``
    has, at the place of a set of filters, the documents that fail exactly these.
    """
    by_mask = rows.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(m).cast("long"), F.lit(0))).alias(f"n_{m}") for m in measures]
    )
    cells = by_mask.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", *[f"n_{m}" for m in measures])).alias("cells"))
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    none = F.lit(0).cast("long")

    def worth(field: str) -> Column:
        hit = lambda s: lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[field]).otherwise(none)
        return F.transform(every, lambda s: F.aggregate("cells", none, hit(s)))

    exactly = lambda s: lambda acc, c: acc + F.when(c["mask"] == s, c["n"]).otherwise(none)
    rows = cells.select(
        "part", "total", worth("n").alias("removed"), *[worth(f"n_{m}").alias(m) for m in measures],
        F.transform(every, lambda s: F.aggregate("cells", none, exactly(s))).alias("alone"),
    )

    def grow(done: Column, s: Column) -> Column:
        # Every subset has a smaller number than its set, so its potential is there already.
        less = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(done, s - F.lit(1 << i))).otherwise(none) for i in range(n_filters)]
        scaled = F.get("removed", s) * F.lit(factorial(n_filters)) + sum(less, none)
        return F.concat(done, F.array(F.call_function("div", scaled, F.bit_count(s).cast("long"))))

    potential = F.aggregate(F.slice(every, 2, (1 << n_filters) - 1), F.array(none), grow)
    return rows.withColumn("potential", potential)


def audit(rows: DataFrame, filters: list[str], part: str, mask: str, measures: dict[str, str]) -> DataFrame:
    """One row per part, order of ``filters`` and step.

    ``rows`` has a ``part``, the bit ``mask`` of failed filters and 0/1 columns, the keys of
    ``measures``, whose lost documents come out under the names that are its values.
    Columns: part, filter_order (names joined), step, filter, kept, removed, redundant,
    unique_fails, the measures, shapley (summed over all orders).
    """
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {n}")
    table = coalitions(rows, n, part, mask, list(measures))
    orders = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(n))])
    names, bits = F.array(*[F.lit(f) for f in filters]), F.array(*[F.lit(1 << k) for k in range(n)])
    bit = lambda i: F.element_at(bits, i + 1)
    table = table.withColumn("chain", F.explode(orders)).select("*", F.posexplode("chain").alias("place", "i"))
    table = table.withColumn("own", bit(F.col("i"))).withColumn(
        "before", F.aggregate(F.slice("chain", F.lit(1), F.col("place")), F.lit(0), lambda acc, i: acc + bit(i))
    )
    table = table.withColumn("after", F.col("before") + F.col("own"))
    step = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("before"))
    grand = (1 << n) - 1
    return table.select(
        "part", F.array_join(F.transform("chain", lambda i: F.element_at(names, i + 1)), "").alias("filter_order"),
        (F.col("place") + 1).alias("step"), F.element_at(names, F.col("i") + 1).alias("filter"),
        (F.col("total") - F.get("removed", F.col("after"))).alias("kept"), step("removed").alias("removed"),
        (F.get("removed", F.col("own")) - step("removed")).alias("redundant"), F.get("alone", F.col("own")).alias("unique_fails"),
        *[step(m).alias(out) for m, out in measures.items()],
        (F.get("potential", F.lit(grand)) - F.get("potential", F.lit(grand) - F.col("own"))).alias("shapley"),
    )
