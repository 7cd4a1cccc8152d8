"""Relevance and the combined insight record of an article."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.core import col, text_or_empty
from .phrases import scored_phrases, top_phrases
from .summaries import summary
from ..sizing import INLINE_ROWS
from .terms import (
    categories, entities, entity_surfaces, match_categories, match_entities, primary_category,
    surfaces_of, taxonomy_dict,
)


def relevance_score(cats: Column | str, phrases: Column | str, ents: Column | str, entity_boost: bool = True) -> Column:
    """0.3 for any category, up to 0.2 for the best three phrases, and 0.2 / 0.1 / 0.1 for
    organisations, people and places; at most 1.

    ``entity_boost=False`` gives the score of a first pass, before entities are attached.
    """
    cats, phrases, ents = col(cats), col(phrases), col(ents)
    top = F.slice(phrases, 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, p: a + p.score) / F.size(top)
    score = F.when(F.size(cats) > 0, F.lit(0.3)).otherwise(F.lit(0.0))
    score = score + F.when(F.size(top) > 0, F.lit(0.2) * mean).otherwise(F.lit(0.0))
    if entity_boost:
        for label, boost in (("ORG", 0.2), ("PERSON", 0.1), ("GPE", 0.1)):
            found = F.size(F.coalesce(F.try_element_at(ents, F.lit(label)), F.array())) > 0
            score = score + F.when(found, F.lit(boost)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), score)


def _names(ents: Column, label: str, most: int) -> Column:
    found = F.try_element_at(ents, F.lit(label))
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most)


def extract_insights(
    df: DataFrame,
    entity_dict=(),
    taxonomy=params.TAXONOMY,
    stopwords: Iterable[str] = params.STOPWORDS,
    text: str | None = None,
    entity_boost: bool = True,
    limit: int = INLINE_ROWS,
) -> DataFrame:
    """Add the ``insights`` record; NULL for articles without text.

    The text is ``cleaned_content`` where that column exists, else ``content``.  Each
    article is worked on within its row, so this is a single pass without a shuffle, unless
    a table has more than ``limit`` rows (the taxonomy 1,000).
    """
    surfaces = entity_surfaces(entity_dict, limit)
    inline = taxonomy_dict(taxonomy, min(limit, 1_000))
    source = text or ("cleaned_content" if "cleaned_content" in df.columns else "content")
    body = text_or_empty(source)
    # --- what does not fit into the plan is matched by joins, and used per row from there on
    if surfaces is None:
        df = match_entities(df, entity_dict, source, out="_ents", limit=limit)
        known, known_phrases = surfaces_of(F.col("_ents")), surfaces_of(F.col("_ents"), params.PHRASE_ENTITY_LABELS)
    else:
        known = known_phrases = surfaces
    if inline is None:
        df = match_categories(df, taxonomy, source, out="_cats", limit=min(limit, 1_000))
    made = {
        "_phr": top_phrases(scored_phrases(body, stopwords, known_phrases, best=8), 8),
        "_sum": summary(body, 8, surfaces=known),
    }
    if surfaces is not None:
        made["_ents"] = entities(body, surfaces)
    if inline is not None:
        made["_cats"] = categories(body, inline)
    staged = df.withColumns(made)
    ents, cats, phr = F.col("_ents"), F.col("_cats"), F.col("_phr")
    record = F.struct(
        ents.alias("entities"),
        cats.alias("categories"),
        phr.alias("key_phrases"),
        primary_category(cats).alias("primary_category"),
        relevance_score(cats, phr, ents, entity_boost).alias("relevance_score"),
        F.col("_sum").alias("summary"),
        F.struct(
            F.transform(F.slice(phr, 1, 5), lambda p: p.phrase).alias("key_points"),
            _names(ents, "ORG", 5).alias("mentioned_organizations"),
            _names(ents, "PERSON", 3).alias("mentioned_people"),
            _names(ents, "GPE", 3).alias("mentioned_locations"),
        ).alias("detailed_analysis"),
    )
    return staged.withColumn("insights", F.when(body != "", record)).drop("_ents", "_cats", "_phr", "_sum")
