"""From insight rows to a two-up deck with replacements and a summary slide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..operators import cards, deck
from ..session import written


@dataclass
class Deck:
    """The tables a deck consists of; each is lazy."""

    cards: DataFrame
    outline: DataFrame
    summary: DataFrame
    bars: DataFrame


def place_cards(rows: DataFrame, candidates: DataFrame | None = None, order: list[str] = deck.DECK_ORDER, phrases=params.BOILERPLATE) -> DataFrame:
    """Cards with their slots; a rejected article is replaced where a candidate is left."""
    rows = rows.withColumn("sector", F.coalesce("sector", F.lit("General")))
    shown = cards.with_display_content(rows, phrases)
    placed = deck.slots(rows, order, per_slide=2)
    if candidates is None:
        return deck.join_slots(shown, placed, order).withColumn("shown_url", F.when(F.col("accepted"), F.col("url")))
    new = deck.fill_slots(shown, candidates, order, phrases=phrases).select("sector", *order, "new_url", "new_content")
    # slots and replacements are put together first, so that articles meet one table once
    new = written(new, "replacements").withColumnsRenamed({k: f"_new_{k}" for k in ("sector", *order)})
    same = F.col("sector") == F.col("_new_sector")
    for k in order:
        same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
    placed = placed.join(new, same, "left").drop(*[f"_new_{k}" for k in ("sector", *order)])
    return (
        deck.join_slots(shown, placed, order)
        .withColumn("shown_url", F.when(F.col("accepted"), F.col("url")).otherwise(F.col("new_url")))
        .withColumn("display_content", F.coalesce("display_content", "new_content"))
        .drop("new_url", "new_content")
    )


def build_deck(rows: DataFrame, candidates: DataFrame | None = None, order: list[str] = deck.DECK_ORDER, phrases=params.BOILERPLATE, title: str = "Weekly Newsletter") -> Deck:
    rows = rows.withColumn("sector", F.coalesce("sector", F.lit("General")))
    return Deck(
        cards=place_cards(rows, candidates, order, phrases),
        outline=deck.deck_outline(rows, order, 2, title),
        summary=deck.digest_summary(rows, order),
        bars=deck.category_bars(deck.category_counts(rows, order)),
    )
