"""Key phrases of an article, and phrase statistics of the corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..functions.core import is_in, let, text_or_empty, words
from ..sizing import INLINE_ROWS
from .terms import entity_mentions, entity_surfaces, match_entities, surfaces_of

SCORE_DIGITS = 9


def phrase_counts(phrases: Column) -> Column:
    """Array of (phrase, n) for the distinct phrases: sort once, then cut into runs."""

    def runs(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)),
        )
        counted = let(
            starts,
            lambda st: F.transform(
                st,
                lambda s, j: F.struct(
                    F.get(xs, s).alias("phrase"), (F.coalesce(F.get(st, j + 1), n) - s).alias("n")
                ),
            ),
        )
        return F.when(n > 0, counted).otherwise(F.array().cast("array<struct<phrase:string,n:int>>"))

    return let(F.sort_array(phrases), runs)


#: Allowance for rounding when a phrase is ruled out by a bound on its score.
SLACK = 1e-8


def scored_phrases(
    text: Column | str,
    stopwords: Iterable[str] = params.STOPWORDS,
    surfaces: dict[str, str] | Column | None = None,
    signals: Iterable[str] = params.PHRASE_SIGNALS,
    best: int | None = None,
) -> Column:
    """Array of (phrase, n, first_pos, score), best first; ties by position, then phrase.

    score = share of all phrases * (1 + 0.2 * words) * (1.5 - first_pos / length), the last
    factor 1 when the phrase is not found literally; times 1.5 with a signal term in it.

    Finding every phrase in a long text is quadratic.  With ``best`` given, only phrases
    that may be among the best ones are looked up: the first phrases of the text set a
    score to beat, and others are searched no further than where they could still beat it.
    The first ``best`` entries are the same as without.
    """
    text = text_or_empty(text)
    signals = list(signals)
    all_phrases = X.candidate_phrases(text, stopwords)
    wanted = surfaces
    if isinstance(surfaces, dict):
        wanted = {s: lab for s, lab in surfaces.items() if lab in params.PHRASE_ENTITY_LABELS}
    if isinstance(wanted, Column) or wanted:
        mentions = F.transform(entity_mentions(text, wanted), lambda m: F.lower(m.surface))
        all_phrases = F.concat(all_phrases, mentions)

    def length_weight(phrase: Column) -> Column:
        blanks = F.length(phrase) - F.length(F.translate(phrase, " ", ""))
        return F.lit(1.0) + (blanks + 1) * F.lit(0.2)

    def boost(phrase: Column) -> Column:
        has_signal = F.lit(False)
        for s in signals:
            has_signal = has_signal | phrase.contains(s)
        return F.when(has_signal, F.lit(1.5)).otherwise(F.lit(1.0))

    def value(doc: Column, phrase: Column, n: Column, at: Column) -> Column:
        bonus = F.when(at >= 0, F.lit(1.5) - at / doc.length).otherwise(F.lit(1.0))
        raw = n / doc.total * length_weight(phrase) * bonus
        return F.round(raw * boost(phrase), SCORE_DIGITS)

    def entry(doc: Column, p: Column) -> Column:
        return let(
            F.instr(doc.low, p.phrase) - 1,
            lambda at: F.struct(
                (-value(doc, p.phrase, p.n, at)).alias("neg"),
                at.alias("first_pos"),
                p.phrase.alias("phrase"),
                p.n.alias("n"),
            ),
        )

    def to_beat(doc: Column, phrases: Column) -> Column:
        """A score that ``best`` phrases reach; 0 if there are not that many to try."""
        tried = F.array_distinct(F.slice(phrases, 1, 4 * best))
        scores = F.transform(
            tried, lambda p: value(doc, p, F.lit(1), F.instr(doc.low, p) - 1)
        )
        return F.coalesce(F.get(F.sort_array(scores, asc=False), F.lit(best - 1)), F.lit(0.0))

    def may_rank(doc: Column, goal: Column, p: Column) -> Column:
        def reachable(w: Column) -> Column:
            furthest = (F.lit(1.5) - (goal - SLACK) / w) * doc.length
            head = F.left(doc.low, F.ceil(furthest).cast("int") + F.length(p.phrase) + 1)
            return (w + SLACK >= goal) | (
                (w * F.lit(1.5) + SLACK >= goal) & head.contains(p.phrase)
            )

        return let(p.n / doc.total * length_weight(p.phrase) * boost(p.phrase), reachable)

    def rank(phrases: Column) -> Column:
        def ranked(doc: Column) -> Column:
            counts = phrase_counts(phrases)
            if best is not None:
                counts = let(
                    to_beat(doc, phrases),
                    lambda goal: F.filter(phrase_counts(phrases), lambda p: may_rank(doc, goal, p)),
                )
            return F.sort_array(F.transform(counts, lambda p: entry(doc, p)))

        return let(
            F.struct(
                F.lower(text).alias("low"),
                F.length(F.lower(text)).alias("length"),
                F.size(phrases).alias("total"),
            ),
            ranked,
        )

    return F.transform(
        let(all_phrases, rank),
        lambda r: F.struct(r.phrase.alias("phrase"), r.n.alias("n"), r.first_pos.alias("first_pos"), (-r.neg).alias("score")),
    )


def top_phrases(scored: Column, k: int = 8) -> Column:
    """The ``k`` best as (phrase, score), scores relative to the best one."""
    return let(
        F.slice(scored, 1, k),
        lambda top: F.transform(
            top,
            lambda p: F.struct(
                p.phrase.alias("phrase"),
                F.when(F.get(top, F.lit(0)).score > 0, p.score / F.get(top, F.lit(0)).score)
                .otherwise(p.score)
                .alias("score"),
            ),
        ),
    )


def key_phrases(df: DataFrame, k: int = 8, text: str = "content", out: str = "key_phrases", stopwords: Iterable[str] = params.STOPWORDS, entity_dict=None, limit: int = INLINE_ROWS) -> DataFrame:
    """Add the key phrases.  A dictionary of more than ``limit`` rows is joined first."""
    surfaces = entity_surfaces(entity_dict, limit) if entity_dict is not None else {}
    if surfaces is not None:
        return df.withColumn(out, top_phrases(scored_phrases(text, stopwords, surfaces, best=k), k))
    found = match_entities(df, entity_dict, text, out="_entities", limit=limit)
    own = surfaces_of(F.col("_entities"), params.PHRASE_ENTITY_LABELS)
    return found.withColumn(out, top_phrases(scored_phrases(text, stopwords, own, best=k), k)).drop("_entities")


def key_phrase_rows(df: DataFrame, keys: Iterable[str] = ("sector", "url"), k: int = 8, text: str = "content", stopwords: Iterable[str] = params.STOPWORDS, surfaces: dict[str, str] | Column | None = None) -> DataFrame:
    """One row per article and key phrase: keys, rank, phrase, score."""
    top = top_phrases(scored_phrases(text, stopwords, surfaces, best=k), k)
    # the expression is exploded directly: a filter inferred on a column would evaluate it twice more
    return df.select(*keys, F.posexplode(top).alias("_i", "_p")).select(
        *keys, (F.col("_i") + 1).alias("rank"), "_p.*"
    )


def phrase_table(df: DataFrame, keys: Iterable[str] = ("sector", "url"), text: str = "content", stopwords: Iterable[str] = params.STOPWORDS, signals: Iterable[str] = params.PHRASE_SIGNALS) -> DataFrame:
    """One row per article and phrase: phrase, n, first_pos, score and tf."""

    def with_tf(rows: Column) -> Column:
        return let(
            F.aggregate(rows, F.lit(0), lambda a, p: a + p.n),
            lambda total: F.transform(
                rows,
                lambda p: F.struct(
                    p.phrase.alias("phrase"), p.n.alias("n"), p.first_pos.alias("first_pos"),
                    p.score.alias("score"), (p.n / total).alias("tf"),
                ),
            ),
        )

    rows = let(scored_phrases(text, stopwords, signals=signals), with_tf)
    return df.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*")


def phrase_idf(df: DataFrame, text: str = "content", stopwords: Iterable[str] = params.STOPWORDS) -> DataFrame:
    """Corpus weight of each phrase, ``ln(articles / articles with it)``.

    ``df`` has one row per article.  An article sends each phrase once, and counts are
    combined per task, so common phrases do not concentrate in one place.
    """
    phrases = F.array_distinct(X.candidate_phrases(text, stopwords))
    per_phrase = (
        df.select(F.explode(phrases).alias("phrase"))
        .groupBy("phrase")
        .agg(F.count("*").alias("doc_count"))
    )
    articles = df.agg(F.count("*")).scalar()
    return per_phrase.withColumn("idf", F.log(articles / F.col("doc_count")))


def term_frequencies(df: DataFrame, n: int = 100, by: Iterable[str] = (), text: str = "content", stopwords: Iterable[str] = params.STOPWORDS) -> DataFrame:
    """The ``n`` most frequent words of cleaned text, over all articles or per group."""
    by = list(by)
    stop = list(stopwords)
    tokens = F.filter(words(X.clean_text(text)), lambda w: ~is_in(w, stop))
    counts = (
        df.select(*by, F.explode(tokens).alias("term"))
        .groupBy(*by, "term")
        .agg(F.count("*").alias("frequency"))
    )
    order = [F.col("frequency").desc(), F.col("term").asc()]
    if not by:
        return counts.orderBy(*order).limit(n)
    from .selection import first_per

    return first_per(counts, by, order, n)
