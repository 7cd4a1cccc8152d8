"""Sentence scoring and extractive summaries, within the row of the article."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..functions.core import is_in, let, text_or_empty, word_count
from ..sizing import INLINE_ROWS
from .terms import entity_surfaces, match_entities, mentions_in, surfaces_of


def running_start(counts: Column) -> Column:
    """Number of tokens before each sentence."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        counts,
        zero,
        lambda acc, n: F.struct(
            (acc.sum + n).alias("sum"), F.concat(acc.starts, F.array(acc.sum)).alias("starts")
        ),
        lambda acc: acc.starts,
    )


def scored_sentences(text: Column | str, signals: Iterable[str] = params.SENTENCE_SIGNALS, surfaces: dict[str, str] | Column | None = None) -> Column:
    """Array of (pos, sentence, words, tok_start, score) over the whole text.

    score = (entities / 2 + signal words + 1.5 - |tok_start / sentences - 0.5|) * words.
    The position term is not confined to 0..1, so late sentences score below zero.
    """
    signals = list(signals)
    has_surfaces = isinstance(surfaces, Column) or bool(surfaces)

    def score(sentences: Column) -> Column:
        counts = F.transform(sentences, lambda s: word_count(s))
        n = F.size(sentences)

        def row(s: Column, i: Column, w: Column, start: Column) -> Column:
            def hits(tokens: Column) -> Column:
                signal_words = F.size(F.filter(tokens, lambda t: is_in(F.lower(t), signals)))
                if not has_surfaces:
                    return F.lit(0) * F.lit(0.5) + signal_words
                return F.size(mentions_in(tokens, surfaces)) * F.lit(0.5) + signal_words

            position = F.lit(1.5) - F.abs(start / n - F.lit(0.5))
            return F.struct(
                i.cast("int").alias("pos"),
                F.trim(s).alias("sentence"),
                w.alias("words"),
                start.alias("tok_start"),
                ((let(X.word_tokens(s, lower=False), hits) + position) * w).alias("score"),
            )

        return let(
            counts,
            lambda c: let(
                running_start(c),
                lambda st: F.transform(sentences, lambda s, i: row(s, i, F.get(c, i), F.get(st, i))),
            ),
        )

    return let(X.split_sentences(text_or_empty(text)), score)


def summary(text: Column | str, k: int = 8, signals: Iterable[str] = params.SENTENCE_SIGNALS, surfaces: dict[str, str] | Column | None = None) -> Column:
    """The ``k`` best sentences in text order; the first five if that is too short for the text."""
    text = text_or_empty(text)

    def choose(rows: Column) -> Column:
        ranked = F.sort_array(F.transform(rows, lambda r: F.struct((-r.score).alias("s"), r.pos.alias("p"))))
        best = F.sort_array(F.transform(F.slice(ranked, 1, k), lambda r: r.p))
        chosen = F.array_join(F.transform(best, lambda p: F.get(rows, p).sentence), " ")
        first = F.array_join(F.transform(F.slice(rows, 1, 5), lambda r: r.sentence), " ")
        return let(
            chosen,
            lambda c: F.when((word_count(c) < 50) & (word_count(text) > 100), first).otherwise(c),
        )

    return F.when(text == "", F.lit("")).otherwise(let(scored_sentences(text, signals, surfaces), choose))


def summarize(df: DataFrame, k: int = 8, text: str = "content", out: str = "summary", signals: Iterable[str] = params.SENTENCE_SIGNALS, entity_dict=None, limit: int = INLINE_ROWS) -> DataFrame:
    """Add the summary.  A dictionary of more than ``limit`` rows is joined first."""
    surfaces = entity_surfaces(entity_dict, limit) if entity_dict is not None else {}
    if surfaces is not None:
        return df.withColumn(out, summary(text, k, signals, surfaces))
    found = match_entities(df, entity_dict, text, out="_entities", limit=limit)
    return found.withColumn(out, summary(text, k, signals, surfaces_of(F.col("_entities")))).drop("_entities")


def sentence_table(df: DataFrame, keys: Iterable[str] = ("sector", "url"), text: str = "content", **scoring) -> DataFrame:
    """One row per sentence: keys, pos, sentence, words, tok_start, score."""
    rows = F.explode(scored_sentences(text, **scoring)).alias("_s")
    return df.select(*keys, rows).select(*keys, "_s.*")


def sentence_profile(df: DataFrame, by: Iterable[str] = ("sector",), text: str = "content") -> DataFrame:
    """Short (<5 words), long (>50) and usable sentences, counted per group."""
    counts = F.transform(X.split_sentences(text_or_empty(text)), lambda s: word_count(s))
    sized = df.select(
        *by,
        let(
            counts,
            lambda c: F.struct(
                F.size(F.filter(c, lambda n: n < 5)).alias("short"),
                F.size(F.filter(c, lambda n: n > 50)).alias("long"),
                F.size(F.filter(c, lambda n: n.between(5, 50))).alias("kept"),
            ),
        ).alias("_p"),
    )
    return sized.groupBy(*by).agg(
        F.sum("_p.short").alias("short_sentences"),
        F.sum("_p.long").alias("long_sentences"),
        F.sum("_p.kept").alias("kept_sentences"),
    )
