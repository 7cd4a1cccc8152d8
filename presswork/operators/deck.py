"""Laying out a deck: sectors, slides, slots, replacements, the summary slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..session import written
from ..functions.core import text_or_empty
from . import digests
from .numbering import number_within
from .selection import first_per, search_articles

DECK_ORDER = ["deck_pos"]


def _earliest(order: list[str]) -> Column:
    """Smallest order key; a single column keeps the aggregation hash-based."""
    return F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))


def by_sector(df: DataFrame, order: list[str] = DECK_ORDER) -> DataFrame:
    """Default the sector and add ``sector_ord``: the rank of sectors by first article.

    Only one minimum per sector and task is shuffled; the table of sectors is written, so its
    exact size decides how it is joined, and below the broadcast threshold articles stay
    where they are.
    """
    df = df.withColumn("sector", F.coalesce("sector", F.lit("General")))
    firsts = df.groupBy("sector").agg(_earliest(order).alias("_first"))
    # the list of sectors, some hundreds, needs all of it in one place for its rank; up to
    # millions of sectors fit a task
    ranked = firsts.select(
        "sector", F.row_number().over(W.orderBy("_first", "sector")).cast("long").alias("sector_ord")
    )
    return df.join(written(ranked, "sectors"), "sector")


def deck_layout(
    df: DataFrame, order: list[str] = DECK_ORDER, per_slide: int = 2, number: str | None = None
) -> DataFrame:
    """Slide, slot and position of every article, in decks of one or two articles a slide.

    Slide 1 is the title; each sector has a section slide and its article slides; a
    rejected article still takes its slot.  ``order`` has to be a total order within a
    sector.  ``number`` names a column that already counts 1, 2, 3 ... within the sector.
    Adds idx, slide_no, slot, left, top, width and height.

    Articles are numbered by their sector and order alone; the table of slots is written, and
    articles meet it once, where they are if it is small enough to be broadcast.
    """
    df = df.withColumn("sector", F.coalesce("sector", F.lit("General")))
    if number is not None:
        return _slotted(df, df, order, per_slide, number)
    return join_slots(df, slots(df, order, per_slide), order)


def slots(df: DataFrame, order: list[str] = DECK_ORDER, per_slide: int = 2) -> DataFrame:
    """(sector, *order, idx, slide_no, slot, left, top, width, height): the layout without the articles."""
    keys = df.select(F.coalesce("sector", F.lit("General")).alias("sector"), *order)
    return _slotted(number_within(keys, "sector", order, "_no"), keys, order, per_slide, "_no").drop("_no")


def join_slots(df: DataFrame, placed: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with what a table of slots has for its (sector, *order)."""
    keys = ["sector", *order]
    placed = written(placed, "slots").withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.col("sector") == F.col("_key_sector")
    for k in order:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(placed, same).drop(*[f"_key_{k}" for k in keys])


def _slotted(numbered: DataFrame, df: DataFrame, order: list[str], per_slide: int, number: str) -> DataFrame:
    sectors = sector_slides(df, order, per_slide)
    rows = numbered.join(written(sectors.select("sector", "section_slide"), "sectors"), "sector")
    idx = F.col(number).cast("long") - 1
    slot = (idx % per_slide).cast("int")
    boxes = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("left", "top", "width", "height"), s)])
            for s in (params.TWO_UP_SLOTS if per_slide == 2 else params.ONE_UP_SLOTS)
        ]
    )
    return rows.select(
        *numbered.columns,
        idx.alias("idx"),
        (F.col("section_slide") + 1 + F.floor(idx / per_slide)).cast("long").alias("slide_no"),
        slot.alias("slot"),
        F.get(boxes, slot).alias("_box"),
    ).select(*numbered.columns, "idx", "slide_no", "slot", "_box.*")


def sector_slides(df: DataFrame, order: list[str] = DECK_ORDER, per_slide: int = 2) -> DataFrame:
    """One row per sector: sector_ord, n_articles, section_slide, last_slide."""
    per_sector = df.groupBy("sector").agg(
        F.count("*").alias("n_articles"), _earliest(order).alias("_first")
    )
    slides = F.ceil(F.col("n_articles") / per_slide) + 1
    # one row per sector from here on
    w = W.orderBy("_first", "sector")
    return per_sector.select(
        "sector",
        "n_articles",
        F.row_number().over(w).cast("long").alias("sector_ord"),
        (F.lit(1) + F.sum(slides).over(w.rowsBetween(W.unboundedPreceding, 0))).cast("long").alias("last_slide"),
        slides.alias("_slides"),
    ).select(
        "sector", "sector_ord", "n_articles",
        (F.col("last_slide") - F.col("_slides") + 1).cast("long").alias("section_slide"),
        "last_slide",
    )


def deck_outline(df: DataFrame, order: list[str] = DECK_ORDER, per_slide: int = 2, title: str = "Weekly Newsletter", with_summary: bool = True) -> DataFrame:
    """Title, section and summary slides of the deck."""
    sectors = sector_slides(df.withColumn("sector", F.coalesce("sector", F.lit("General"))), order, per_slide)
    section = sectors.select(
        F.col("section_slide").alias("slide_no"), F.lit("section").alias("kind"), F.upper("sector").alias("heading")
    )
    spark = df.sparkSession
    first = spark.range(1).select(
        F.lit(1).cast("long").alias("slide_no"), F.lit("title").alias("kind"), F.lit(title).alias("heading")
    )
    out = first.unionByName(section)
    if with_summary:
        last = sectors.agg((F.coalesce(F.max("last_slide"), F.lit(1)) + 1).cast("long").alias("slide_no"))
        out = out.unionByName(last.select("slide_no", F.lit("summary").alias("kind"), F.lit("Summary").alias("heading")))
    return out


# --------------------------------------------------------------------------- replacements


def fill_slots(
    deck: DataFrame,
    candidates: DataFrame,
    order: list[str] = DECK_ORDER,
    cand_order: tuple[str, ...] = ("provider_rank",),
    per_provider: int = params.REPLACEMENTS_PER_PROVIDER,
    phrases=params.BOILERPLATE,
) -> DataFrame:
    """Replacement for each rejected article of the deck, where there is one.

    ``deck`` has sector, url, source, accepted and ``order``; ``candidates`` has sector,
    provider ('newsapi' or 'gnews'), url, summary, content and ``cand_order``.

    A sector's pool is what one search brings: the first ``per_provider`` articles of each
    provider.  Those already in the deck or unfit for a card are passed over.  A gap whose
    source names a provider is filled from the other one; those gaps go first, each
    taking the next candidate.  The remaining gaps take what is left, NewsAPI before
    GNews.  A pool is at most twice ``per_provider``, so no more gaps than that are
    numbered per sector, and the rest stay empty.

    The sector 'general' says nothing to search for: its gaps are filled by ``fill_by_title``
    if both tables have titles.
    """
    if "title" in deck.columns and "title" in candidates.columns:
        general = F.lower(F.coalesce("sector", F.lit("General"))) == "general"
        rest = fill_slots(deck.filter(~general).drop("title"), candidates, order, cand_order, per_provider, phrases)
        return rest.unionByName(fill_by_title(deck.filter(general), candidates, order, cand_order, per_provider, phrases))
    pool_size = 2 * per_provider
    # --- pools: bounded per (sector, provider) before anything is compared
    pool = written(first_per(candidates, ["sector", "provider"], list(cand_order), per_provider), "pool")
    # of the deck's links only those that a pool has are of interest
    used = deck.select("sector", "url").join(pool.select("sector", "url").distinct(), ["sector", "url"], "left_semi").distinct()
    pool = pool.join(used, ["sector", "url"], "left_anti")
    pool = pool.withColumn("new_content", X.display_content("summary", "content", phrases))
    pool = pool.filter(F.col("new_content").isNotNull())
    # the same link from both providers counts once, for the first
    pool = pool.withColumn("_p", F.when(F.col("provider") == "newsapi", 0).otherwise(1))
    pool = first_per(pool, ["sector", "url"], ["_p", *cand_order])
    # at most ``pool_size`` candidates per sector are brought together
    entry = F.struct("_p", *cand_order, F.col("url").alias("new_url"), F.col("provider").alias("new_provider"), "new_content")
    pool = pool.groupBy("sector").agg(F.sort_array(F.collect_list(entry)).alias("_pool"))
    pool = pool.select(
        "sector",
        F.filter("_pool", lambda c: c["_p"] == 0).alias("_newsapi"),
        F.filter("_pool", lambda c: c["_p"] == 1).alias("_gnews"),
    )

    # --- gaps, by the provider they have to be filled from
    source = F.lower(text_or_empty("source"))
    only = (
        F.when(source.contains("gnews"), F.lit("newsapi"))
        .when(source.contains("newsapi"), F.lit("gnews"))
        .otherwise(F.lit("any"))
    )
    gaps = deck.filter(~F.col("accepted")).select("sector", "url", *order, only.alias("_only"))
    gaps = first_per(gaps, ["sector", "_only"], list(order), pool_size, out="_k")
    in_sector = W.partitionBy("sector")
    for name in ("newsapi", "gnews"):
        gaps = gaps.withColumn(f"_ask_{name}", F.count_if(F.col("_only") == name).over(in_sector))

    # --- each gap takes the candidate of its turn
    n_newsapi, k = F.size("_newsapi"), F.col("_k")
    spent_newsapi = F.least(n_newsapi, "_ask_newsapi").cast("int")
    spent_gnews = F.least(F.size("_gnews"), "_ask_gnews").cast("int")
    rest = n_newsapi - spent_newsapi
    pick = (
        F.when(F.col("_only") == "newsapi", F.get("_newsapi", k - 1))
        .when(F.col("_only") == "gnews", F.get("_gnews", k - 1))
        .when(k <= rest, F.get("_newsapi", spent_newsapi + k - 1))
        .otherwise(F.get("_gnews", spent_gnews + k - rest - 1))
    )
    filled = gaps.join(pool, "sector").select("sector", "url", *order, pick.alias("_c"))
    return filled.filter(F.col("_c").isNotNull()).select(
        "sector", "url", *order, "_c.new_url", "_c.new_provider", "_c.new_content"
    )


def fill_by_title(
    deck: DataFrame,
    candidates: DataFrame,
    order: list[str] = DECK_ORDER,
    cand_order: tuple[str, ...] = ("provider_rank",),
    per_provider: int = params.REPLACEMENTS_PER_PROVIDER,
    phrases=params.BOILERPLATE,
) -> DataFrame:
    """Replacement for each rejected article, found by the article's own title.

    The title is searched as a phrase among all candidates (title, summary and content, as
    ``search_articles`` scores them); each provider gives its ``per_provider`` best hits, and
    of these links of the sector's deck and articles unfit for a card are passed over.  Gaps
    take their turn in deck order: each takes the first of its hits, NewsAPI's before
    GNews's, that no earlier gap has taken.  A gap without a title finds nothing.
    """
    source = F.lower(text_or_empty("source"))
    providers = (
        F.when(source.contains("gnews"), F.array(F.lit("newsapi")))
        .when(source.contains("newsapi"), F.array(F.lit("gnews")))
        .otherwise(F.array(F.lit("newsapi"), F.lit("gnews")))
    )
    gaps = deck.filter(~F.col("accepted") & (text_or_empty("title") != ""))
    gaps = written(gaps.select("sector", "url", "title", *order, providers.alias("_providers")).withColumn("_gap", F.monotonically_increasing_id()), "gaps")
    # a title is searched once, however many gaps have it, and hits are narrow: texts stay in the table of candidates
    searches = gaps.select(F.col("title").alias("sector"), F.lit(0).alias("query_idx"), F.concat(F.lit('"'), "title", F.lit('"')).alias("query")).distinct()
    found = candidates.select(
        "provider", F.col("url").alias("new_url"), "title", F.col("summary").alias("description"), "content", *cand_order,
        X.display_content("summary", "content", phrases).alias("new_content"), F.monotonically_increasing_id().alias("_cand"),
    )
    found = written(found.withColumn("_fit", F.col("new_content").isNotNull() & F.col("new_url").isNotNull()), "candidates")
    hits = search_articles(found, searches).select(F.col("sector").alias("title"), "provider", "new_url", "score", *cand_order, "_cand", "_fit")
    # a provider's answer is what it ranks first, whether it can be used or not
    answers = first_per(hits, ["title", "provider"], [F.desc("score"), *cand_order, "new_url"], per_provider, out="_rank")
    answers = answers.filter("_fit").select("title", "provider", "new_url", "_rank", "_cand")
    answers = answers.join(gaps.select("_gap", "title", "_providers", F.col("sector").alias("_s"), F.struct(*order).alias("_turn")), "title")
    answers = answers.filter(F.array_contains("_providers", F.col("provider")))
    used = deck.select(F.col("sector").alias("_s2"), F.col("url").alias("_u")).filter("_u is not null").distinct()
    answers = answers.join(used, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("new_url") == F.col("_u")), "left_anti")
    place = F.struct(F.when(F.col("provider") == "newsapi", 0).otherwise(1).alias("p"), F.col("_rank").alias("r"))
    answers = written(answers.select("_gap", "_s", "_turn", place.alias("_place"), "new_url", F.col("provider").alias("new_provider"), "_cand"), "answers")
    taken = take_turns(answers.select("_gap", "_s", "_turn", "_place", "new_url"))
    chosen = answers.join(taken.select("_gap", "_place"), ["_gap", "_place"]).select("_gap", "new_url", "new_provider", "_cand")
    chosen = chosen.join(found.select("_cand", "new_content"), "_cand")
    return gaps.join(chosen, "_gap").select("sector", "url", *order, "new_url", "new_provider", "new_content")


def take_turns(wishes: DataFrame) -> DataFrame:
    """(_gap, _place) that each gap gets when gaps choose one after the other, by ``_turn``.

    ``wishes`` has (_gap, _s, _turn, _place, new_url), unique within (_gap, _place); a link is
    given once per ``_s``.  In each round every gap asks for its first wish that has not been
    refused, and of those who ask for one link all but the earliest are refused it.  A
    refusal is final, as earlier gaps only come to a link and never leave it to a later
    one; without refusals everybody has what they would have chosen in turn.
    """
    left = wishes
    while True:
        asked = written(first_per(left, ["_gap"], ["_place"]), "asked")
        first = first_per(asked, ["_s", "new_url"], ["_turn", "_gap"])
        refused = written(asked.join(first.select("_gap", "_place"), ["_gap", "_place"], "left_anti").select("_gap", "_place"), "refused")
        if refused.isEmpty():
            return asked.select("_gap", "_place")
        left = written(left.join(refused, ["_gap", "_place"], "left_anti"), "wishes")


# --------------------------------------------------------------------------- summary slide


def _body() -> Column:
    """What an article adds to a summary."""
    return F.when(text_or_empty("summary") != "", F.col("summary")).otherwise(text_or_empty("content"))


def digest_summary(df: DataFrame, order: list[str] = DECK_ORDER, start: int = 32) -> DataFrame:
    """One enhanced summary per sector over the texts of all its articles, by ``order``.

    Texts are shrunk to what a summary may take of them and joined a few at a time; see
    ``digests``.
    """
    return digests.summaries(df, "sector", order, _body(), start)


def digest_lines(df: DataFrame, order: list[str] = DECK_ORDER) -> DataFrame:
    """Line by line, the long paragraphs that stand for a sector without usable sentences."""
    return digests.summary_lines(df, "sector", order, _body())


def issue_summary(df: DataFrame, order: list[str] = DECK_ORDER) -> DataFrame:
    """The enhanced summary of all articles of the issue, in the order of sectors."""
    rows = by_sector(df, order).withColumn("sector", F.lit("issue"))
    return digest_summary(rows, ["sector_ord", *order]).select("digest_summary")


def category_counts(df: DataFrame, order: list[str] = DECK_ORDER) -> DataFrame:
    """Insights per category.  A missing list counts as 'Other', an empty one not at all."""
    rows = df.select(
        *order, F.posexplode(F.coalesce("categories", F.array(F.lit("Other")))).alias("_i", "category")
    )
    return rows.groupBy("category").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "_i")).alias("first_seen")
    )


def category_bars(counts: DataFrame) -> DataFrame:
    """Bars of the category chart, in order of first appearance."""
    longest = counts.agg(F.max("n")).scalar()
    bars = (
        counts.withColumn("_max", longest)
        .orderBy("first_seen", "category")
        .limit(params.MAX_BARS)
    )
    # at most MAX_BARS rows are left
    no = F.row_number().over(W.orderBy("first_seen", "category"))
    colours = F.array(*[F.lit(c) for c in params.BAR_COLOURS])
    return bars.select(
        no.alias("bar_no"),
        "category",
        "n",
        (F.col("n") / F.col("_max") * params.BAR_SPAN_INCHES).alias("bar_inches"),
        F.get(colours, (no - 1) % len(params.BAR_COLOURS)).alias("colour"),
        (no <= params.MAX_LEGEND).alias("in_legend"),
    )
