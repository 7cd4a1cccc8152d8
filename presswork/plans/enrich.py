"""Cleaning and insight extraction in one narrow pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import params
from ..operators import insights, terms


def enrich_articles(
    df: DataFrame,
    entity_dict=(),
    lemma_dict=None,
    taxonomy=params.TAXONOMY,
    stopwords=params.STOPWORDS,
    text: str | None = None,
    entity_boost: bool = True,
) -> DataFrame:
    """Cleaned fields and the ``insights`` record of every article."""
    cleaned = terms.clean_articles(df, lemma_dict, stopwords)
    return insights.extract_insights(cleaned, entity_dict, taxonomy, stopwords, text, entity_boost)
