"""Registered queries: every operator run over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork import params, schema
from presswork.functions import fields as C
from presswork.functions import text as X
from presswork.operators import search_index as index
from presswork.operators import (
    cards, deck, filters, insights, phrases, selection, stats, summaries, terms,
)
from presswork.plans import archive as archive_plan
from presswork.plans import build_deck as deck_plan
from presswork.plans import build_digest as digest_plan
from presswork.plans import enrich as enrich_plan
from presswork.plans import preview as preview_plan
from presswork.session import scratch_path
from presswork.sizing import spread_small
from presswork.sources import archive, corpus, digest, pages, providers, snapshots
from presswork.streaming import jobs

from . import fixtures as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; dates are read and shown in UTC, as in the SQL."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    REGISTRY[fn.__name__] = run
    return run


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.read_documents(spark, f"{sf}/documents.parquet")


def page_table(spark: SparkSession, sf: str) -> DataFrame:
    return spread_small(pages.read_pages(spark, f"{sf}/pages.parquet"), "url")


def day(text: str):
    return F.lit(text).cast("timestamp")


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


def r9(c):
    return F.round(c, 9)


ORDER = ["doc_id"]


def deck_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every article as a deck row, in document order."""
    rows = articles(spark, sf).withColumn("deck_pos", F.col("doc_id"))
    made = cards.deck_articles(rows).withColumn("doc_id", F.col("deck_pos"))
    return made.withColumn("source", F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("-gnews")).when(F.col("doc_id") % 3 == 1, F.lit("-newsapi")).otherwise(F.lit(""))))


# --------------------------------------------------------------------------- selection


@query
def dedup_by_url(spark, sf):
    return selection.dedup_by_url(articles(spark, sf)).select("sector", "url", "doc_id")


@query
def top_per_sector(spark, sf):
    rows = selection.dedup_by_url(articles(spark, sf))
    return selection.top_per_sector(rows, 5).select("sector", F.col("deck_pos").cast("long"), "url", "title")


@query
def collect_sources(spark, sf):
    rows = articles(spark, sf)
    parts = [rows.filter(F.col("provider") == p) for p in ("newsapi", "gnews")]
    return selection.collect_sources(parts, 10).select("sector", F.col("deck_pos").cast("long"), "provider", "url")


@query
def union_sources(spark, sf):
    rows = articles(spark, sf).select("doc_id", "provider", "title", "source_name")
    a = rows.filter("provider = 'newsapi'")
    b = rows.filter("provider = 'gnews'").drop("source_name")
    return selection.union_sources(a, b)


@query
def limit_per(spark, sf):
    return selection.limit_per(articles(spark, sf), 7, ["sector", "provider"], ["provider_rank"]).select("sector", "provider", "doc_id")


@query
def limit_request(spark, sf):
    return selection.limit_per(articles(spark, sf), 500, order=["query_idx", "provider_idx", "provider_rank"]).select("query_idx", "doc_id")


@query
def order_articles(spark, sf):
    rows = articles(spark, sf).withColumn("score", F.length("title") % 7)
    return filters.order_articles(rows, "relevance").limit(50).select("doc_id", "url", F.col("score").cast("long"))


@query
def rank_articles(spark, sf):
    rows = articles(spark, sf).withColumn("score", F.length("title") % 7)
    return filters.rank_articles(rows, "relevance").select("doc_id", "url", F.col("score").cast("long"), "rank")


@query
def latest_snapshot(spark, sf):
    return snapshots.latest_snapshot(articles(spark, sf)).select("sector", "doc_id", "url")


@query
def exclude_used(spark, sf):
    rows = articles(spark, sf)
    used = selection.top_per_sector(selection.dedup_by_url(rows), 10)
    return selection.exclude_used(rows, used).select("doc_id", "sector", "url")


@query
def search_articles(spark, sf):
    return selection.search_articles(articles(spark, sf), T.QUERIES).select(
        "doc_id", "sector", "query_idx", F.col("score").cast("long")
    )


def own_searches(spark, sf):
    """Far more searches than are compared one by one: what each document begins with, and the usual ones."""
    begin = F.array_join(X.first_tokens("content", 3), " ")
    rows = corpus.read_documents(spark, f"{sf}/documents.parquet", spread=False)
    own = rows.select("sector", (F.col("doc_id") + 10).cast("int").alias("query_idx"), F.concat(F.lit('"'), begin, F.lit('"')).alias("query"))
    return own.unionByName(spark.createDataFrame(T.QUERIES, "sector string, query_idx int, query string"))


@query
def search_many(spark, sf):
    rows = selection.search_articles(articles(spark, sf), own_searches(spark, sf), limit=100)
    return rows.select("doc_id", "sector", "query_idx", F.col("score").cast("long"))


@query
def search_index(spark, sf):
    """An index of half of the articles, extended by all of them, then compacted and asked."""
    path, rows = scratch_path(spark, "search-index"), articles(spark, sf)
    index.extend_index(rows.filter("doc_id % 2 = 0"), path, "doc_id")
    index.extend_index(rows, path, "doc_id")
    index.compact_index(spark, path)
    found = index.search_index(spark, path, own_searches(spark, sf))
    return found.select(F.col("id").alias("doc_id"), "sector", "query_idx", F.col("score").cast("long"))


@query
def expand_queries(spark, sf):
    rows = articles(spark, sf).select("sector").distinct()
    own = spark.createDataFrame([("S0", ["of the", "orre"]), ("S1", ["de la", "und", '"und der"'])], "sector string, queries array<string>")
    return selection.expand_queries(rows, own)


@query
def backfill_content(spark, sf):
    # each document asks for the page of its number; stubs are the first 150 characters
    p = page_table(spark, sf).select("page_id", "html")
    keyed = p.select(F.concat(F.lit("page://"), F.col("page_id").cast("string")).alias("url"), "html")
    rows = articles(spark, sf).withColumn("url", F.concat(F.lit("page://"), F.col("doc_id").cast("string")))
    stub = F.when(F.col("doc_id") % 2 == 0, F.substring("content", 1, 150)).otherwise(F.col("content"))
    return selection.backfill_content(rows.withColumn("content", stub), keyed).select("doc_id", "content", "backfilled")


# --------------------------------------------------------------------------- filters


@query
def require_fields(spark, sf):
    rows = articles(spark, sf).withColumn("title", F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("title")))
    return filters.require_fields(rows, ["url", "title"]).select("doc_id", "title")


@query
def lookback(spark, sf):
    return filters.lookback(articles(spark, sf), day("2024-01-25 10:00:00")).select("doc_id")


@query
def language(spark, sf):
    return filters.language(articles(spark, sf), "en").select("doc_id", "lang")


@query
def fresh(spark, sf):
    return snapshots.fresh(articles(spark, sf), day("2024-01-10 12:00:00"), params.CACHE_TTL_SECONDS).select("doc_id")


@query
def valid_rows(spark, sf):
    drop = F.col("doc_id") % 4 == 0
    rows = articles(spark, sf).withColumns({c: F.when(~drop, F.col(c)) for c in ("url", "title", "description", "content")})
    return filters.valid_rows(rows).select("doc_id", "url")


@query
def content_flags(spark, sf):
    return filters.content_flags(articles(spark, sf)).select(
        "doc_id", "needs_refetch", "needs_second_extractor", "needs_full_text", "needs_more_sentences"
    )


@query
def drop_boilerplate(spark, sf):
    rows = articles(spark, sf).withColumn("sentences", X.split_sentences("content"))
    kept = filters.drop_boilerplate(rows, T.BOILERPLATE)
    return kept.select("doc_id", F.size("sentences").cast("long").alias("n"), joined("sentences", " ").alias("kept"))


@query
def content_gate(spark, sf):
    rows = articles(spark, sf).withColumn("summary", F.col("description"))
    kept = filters.content_gate(rows, phrases=T.BOILERPLATE)
    return kept.select("doc_id", F.size("kept_sentences").cast("long").alias("n"))


# --------------------------------------------------------------------------- text functions


@query
def clean_text(spark, sf):
    return articles(spark, sf).select("doc_id", X.clean_text("content").alias("cleaned"))


@query
def clean_pages(spark, sf):
    return page_table(spark, sf).select("page_id", X.clean_text("html").alias("cleaned"))


@query
def remove_stopwords(spark, sf):
    return articles(spark, sf).select("doc_id", X.remove_stopwords("content").alias("kept"))


@query
def split_sentences(spark, sf):
    return articles(spark, sf).select("doc_id", F.posexplode(X.split_sentences("content")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query
def count_sentences(spark, sf):
    return articles(spark, sf).select("doc_id", X.count_sentences("content").cast("long").alias("n"))


@query
def paragraphs(spark, sf):
    text = F.replace("content", F.lit(".\n"), F.lit(".\n\n"))
    return articles(spark, sf).select("doc_id", F.posexplode(X.paragraphs(text)).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


@query
def enhance_summary(spark, sf):
    return articles(spark, sf).select("doc_id", X.enhance_summary("description", "content").alias("summary"))


@query
def display_content(spark, sf):
    return articles(spark, sf).select("doc_id", X.display_content("description", "content", T.BOILERPLATE).alias("shown"))


@query
def cut_at_sentence(spark, sf):
    return articles(spark, sf).select("doc_id", X.cut_at_sentence("content").alias("cut"))


@query
def html_to_text(spark, sf):
    return page_table(spark, sf).select("page_id", X.html_to_text("html").alias("body"))


@query
def quote_phrase(spark, sf):
    return articles(spark, sf).select("doc_id", X.quote_phrase("title").alias("quoted"))


@query
def slug(spark, sf):
    return articles(spark, sf).select("doc_id", X.slug("title").alias("slug"), X.cache_key("title").alias("cache_key"))


# --------------------------------------------------------------------------- fields


@query
def source_name(spark, sf):
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.lit("x").alias("id"), F.concat(F.lit(" "), "source_name").alias("name"))))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.col("source_name"), F.lit("\t")))
    )
    return articles(spark, sf).select("doc_id", C.source_name(raw).alias("source_name"))


@query
def source_line(spark, sf):
    return articles(spark, sf).select("doc_id", C.source_line("source_name", F.left("published_raw", F.lit(10))).alias("line"))


@query
def issue_label(spark, sf):
    return articles(spark, sf).select("doc_id", C.issue_label(F.col("published_ts")).alias("label"))


@query
def preview_cards(spark, sf):
    odd = F.col("doc_id") % 10
    rows = articles(spark, sf).withColumns(
        {
            "title": F.when(odd == 1, F.lit(None)).when(odd == 2, "  ").otherwise(F.col("title")),
            "description": F.when(odd == 3, F.lit(None)).otherwise(F.col("description")),
            "published_raw": F.when(odd == 4, "yesterday").when(odd == 5, F.lit(None)).otherwise(F.col("published_raw")),
        }
    )
    shown = cards.preview_cards(rows.withColumn("deck_pos", F.col("doc_id")))
    return shown.withColumnRenamed("deck_pos", "doc_id")


@query
def deck_articles(spark, sf):
    rows = articles(spark, sf).withColumn("deck_pos", F.col("doc_id"))
    return cards.deck_articles(rows).select(
        F.col("deck_pos").alias("doc_id"), "sector", "title", "source", "date", "summary", joined("categories").alias("categories")
    )


@query
def sector_meta(spark, sf):
    rows = articles(spark, sf).select("doc_id", F.when(F.col("sector") == "S3", "Supply Chain").otherwise(F.col("sector")).alias("sector"))
    return cards.with_sector_meta(rows, cards.default_sector_meta(spark))


# --------------------------------------------------------------------------- enrichment


@query
def match_categories(spark, sf):
    rows = terms.match_categories(articles(spark, sf), T.TAXONOMY)
    return rows.select("doc_id", joined("categories").alias("categories"))


@query
def primary_category(spark, sf):
    rows = terms.match_categories(articles(spark, sf), T.TAXONOMY)
    return rows.select("doc_id", terms.primary_category("categories").alias("primary_category"))


@query
def match_entities(spark, sf):
    rows = articles(spark, sf).select("doc_id", F.explode(terms.entities("content", T.ENTITIES)).alias("label", "names"))
    return rows.select("doc_id", "label", joined("names").alias("names"))


def runs_of_words(spark, sf, tokens):
    """(doc_id, pos, run): two tokens each from the beginnings of all documents, for large dictionaries."""
    pairs = F.transform(F.sequence(F.lit(1), F.lit(11), F.lit(2)), lambda k: F.array_join(F.slice(tokens, k, 2), " "))
    rows = corpus.read_documents(spark, f"{sf}/documents.parquet", spread=False).select("doc_id", F.posexplode(pairs).alias("pos", "run"))
    return rows.filter("run != ''")


@query
def match_categories_large(spark, sf):
    """A taxonomy of six terms for each document, walked as a table."""
    runs = runs_of_words(spark, sf, X.first_tokens("content", 12))
    table = runs.select(F.concat(F.lit("c"), (F.col("doc_id") % 89).cast("string")).alias("category"), F.col("run").alias("term"), (F.col("doc_id") % 7).cast("int").alias("ord"))
    rows = terms.match_categories(articles(spark, sf), table)
    return rows.select("doc_id", joined("categories").alias("categories"))


@query
def match_entities_large(spark, sf):
    """A dictionary of six surfaces for each document, walked as a table."""
    runs = runs_of_words(spark, sf, X.first_words("content", 12, lower=False))
    labels = F.array(*[F.lit(x) for x in params.ENTITY_LABELS])
    table = runs.select(F.col("run").alias("surface"), F.element_at(labels, (F.length("run") % len(params.ENTITY_LABELS) + 1).cast("int")).alias("label"))
    rows = terms.match_entities(articles(spark, sf), table.distinct(), limit=1000)
    rows = rows.select("doc_id", F.explode("entities").alias("label", "names"))
    return rows.select("doc_id", "label", joined("names").alias("names"))


@query
def entity_line(spark, sf):
    rows = terms.match_entities(articles(spark, sf), T.ENTITIES)
    get = lambda k: F.coalesce(F.try_element_at("entities", F.lit(k)), F.array().cast("array<string>"))
    return rows.select("doc_id", C.entity_line(get("ORG"), get("PERSON"), get("GPE")).alias("line"))


@query
def tags(spark, sf):
    rows = terms.match_categories(articles(spark, sf), T.TAXONOMY)
    return rows.select(
        "doc_id", C.tag("categories").alias("tag"),
        joined(F.transform(C.tags("categories"), lambda t: F.concat(t.label, F.lit(":"), F.format_number(t.width, 2)))).alias("tags"),
    )


@query
def mine_entities(spark, sf):
    return terms.mine_entities(articles(spark, sf), 2)


@query
def lemmatize(spark, sf):
    rows = articles(spark, sf).withColumn("cleaned_content", X.clean_text("content"))
    return terms.lemmatize(rows, T.LEMMAS).select("doc_id", "lemmatized_content")


@query
def clean_articles(spark, sf):
    return terms.clean_articles(articles(spark, sf), T.LEMMAS).select(
        "doc_id", "cleaned_title", "cleaned_description", "cleaned_content", "content_no_stopwords", "lemmatized_content"
    )


@query
def sentence_table(spark, sf):
    rows = summaries.sentence_table(articles(spark, sf), ["doc_id"], signals=T.SIGNALS, surfaces=T.ENTITIES)
    return rows.select("doc_id", F.col("pos").cast("long"), F.col("words").cast("long"), F.col("tok_start").cast("long"), r9("score").alias("score"))


@query
def sentence_profile(spark, sf):
    return summaries.sentence_profile(articles(spark, sf))


@query
def summarize(spark, sf):
    rows = summaries.summarize(articles(spark, sf), 8, signals=T.SIGNALS, entity_dict=T.ENTITIES)
    return rows.select("doc_id", "summary")


@query
def phrase_table(spark, sf):
    rows = phrases.phrase_table(articles(spark, sf), ["doc_id"], signals=T.PHRASE_SIGNALS)
    return rows.select(
        "doc_id", "phrase", F.col("n").cast("long"), F.col("first_pos").cast("long"), r9("score").alias("score"), r9("tf").alias("tf")
    )


def _ranked(rows):
    return rows.select("doc_id", F.col("rank").cast("long").alias("pos"), "phrase", r9("score").alias("score"))


@query
def key_phrases(spark, sf):
    return _ranked(phrases.key_phrase_rows(articles(spark, sf), ["doc_id"], 8))


@query
def key_phrases_with_entities(spark, sf):
    return _ranked(phrases.key_phrase_rows(articles(spark, sf), ["doc_id"], 8, surfaces=T.ENTITIES))


@query
def phrase_idf(spark, sf):
    rows = selection.dedup_by_url(articles(spark, sf)).dropDuplicates(["url"])
    return phrases.phrase_idf(rows).select("phrase", "doc_count", r9("idf").alias("idf"))


@query
def term_frequencies(spark, sf):
    return phrases.term_frequencies(articles(spark, sf), 100)


@query
def term_frequencies_by_sector(spark, sf):
    return phrases.term_frequencies(articles(spark, sf), 20, ["sector"])


@query
def relevance_score(spark, sf):
    rows = terms.match_entities(terms.match_categories(articles(spark, sf), T.TAXONOMY), T.ENTITIES)
    rows = phrases.key_phrases(rows, 8)
    score = lambda boost: r9(insights.relevance_score("categories", "key_phrases", "entities", boost))
    return rows.select("doc_id", score(True).alias("relevance"), score(False).alias("first_pass"))


@query
def insight_records(spark, sf):
    rows = insights.extract_insights(articles(spark, sf), T.ENTITIES, T.TAXONOMY)
    return _records(rows)


def _records(rows):
    i = F.col("insights")
    d = i.detailed_analysis
    return rows.select(
        "doc_id", joined(i.categories).alias("categories"), i.primary_category.alias("primary_category"),
        r9(i.relevance_score).alias("relevance"), joined(d.key_points).alias("key_points"),
        joined(d.mentioned_organizations).alias("organizations"), joined(d.mentioned_people).alias("people"),
        joined(d.mentioned_locations).alias("locations"),
    )


# --------------------------------------------------------------------------- deck


def categorised(spark, sf):
    rows = terms.match_categories(articles(spark, sf), T.TAXONOMY)
    return rows.withColumn("categories", F.when(F.col("doc_id") % 9 != 0, F.col("categories")))


@query
def category_counts(spark, sf):
    return deck.category_counts(categorised(spark, sf), ORDER).select("category", "n")


@query
def category_bars(spark, sf):
    counts = deck.category_counts(categorised(spark, sf), ORDER)
    return deck.category_bars(counts).select(
        F.col("bar_no").cast("long"), "category", "n", r9("bar_inches").alias("bar_inches"), "colour", "in_legend"
    )


@query
def by_sector(spark, sf):
    rows = articles(spark, sf).withColumn("sector", F.when(F.col("doc_id") % 11 != 0, F.col("sector")))
    return deck.by_sector(rows, ORDER).select("doc_id", "sector", "sector_ord")


@query
def sector_stats(spark, sf):
    rows = articles(spark, sf)
    wanted = rows.select("sector").distinct().unionByName(spark.range(1).select(F.lit("S-none").alias("sector")))
    return stats.sector_stats(rows, wanted, before="description", after="content")


@query
def deck_layout_1(spark, sf):
    out = deck.deck_layout(deck_rows(spark, sf).select("doc_id", "sector"), ORDER, 1)
    return out.select("doc_id", "sector", "idx", "slide_no", F.col("slot").cast("long"), "left", "top", "width", "height")


@query
def deck_layout_2(spark, sf):
    out = deck.deck_layout(deck_rows(spark, sf).select("doc_id", "sector"), ORDER, 2)
    return out.select("doc_id", "sector", "idx", "slide_no", F.col("slot").cast("long"), "left", "top", "width", "height")


@query
def deck_outline(spark, sf):
    return deck.deck_outline(deck_rows(spark, sf).select("doc_id", "sector"), ORDER, 2)


@query
def fill_slots(spark, sf):
    rows = cards.with_display_content(deck_rows(spark, sf), T.BOILERPLATE)
    cands = articles(spark, sf).withColumnRenamed("description", "summary").select("sector", "provider", "provider_rank", F.concat("url", F.lit("#alt")).alias("url"), "summary", "content")
    out = deck.fill_slots(rows, cands, ORDER, phrases=T.BOILERPLATE)
    return out.select("doc_id", "sector", "url", "new_url", "new_provider")


@query
def fill_slots_general(spark, sf):
    """A deck with the sector General, whose gaps are searched by their titles."""
    rows = cards.with_display_content(deck_rows(spark, sf).withColumn("sector", F.when(F.col("doc_id") % 8 < 3, "General").otherwise(F.col("sector"))), T.BOILERPLATE)
    # a third of the cards are rejected; titles are cut, so that several articles hold them
    rows = rows.withColumns({"accepted": F.col("accepted") & (F.col("doc_id") % 3 != 0), "title": F.array_join(F.slice(F.split("title", " "), 1, 2), " ")})
    cands = articles(spark, sf).withColumnRenamed("description", "summary").select("sector", "provider", "provider_rank", F.concat("url", F.lit("#alt")).alias("url"), "title", "summary", "content")
    out = deck.fill_slots(rows, cands, ORDER, phrases=T.BOILERPLATE)
    return out.filter("sector = 'General'").select("doc_id", "sector", "url", "new_url", "new_provider")


@query
def digest_summary(spark, sf):
    rows = selection.top_per_sector(selection.dedup_by_url(articles(spark, sf)), 5)
    return deck.digest_summary(cards.deck_articles(rows))


@query
def digest_summary_all(spark, sf):
    rows = selection.dedup_by_url(articles(spark, sf))
    return deck.digest_summary(cards.deck_articles(rows), ["query_idx", "provider_idx", "provider_rank"])


@query
def issue_summary(spark, sf):
    rows = selection.dedup_by_url(articles(spark, sf))
    return deck.issue_summary(cards.deck_articles(rows), ["query_idx", "provider_idx", "provider_rank"])


@query
def digest_summary_odd(spark, sf):
    """Sectors of unusual texts: without full stops, cut off, of short sentences, of paragraphs."""
    k, text = F.col("doc_id") % 8, F.col("content")
    odd = (
        F.when(k == 1, F.translate(text, ".!?", ""))
        .when(k == 2, F.substring(text, 1, 60))
        .when(k == 3, F.replace(F.translate(text, "!?", ""), F.lit(". "), F.lit("\n\n")))
        .when(k == 4, F.concat(F.array_join(F.slice(F.split(text, " "), 1, 4), " "), F.lit(".")))
        .when((k == 5) & (F.col("doc_id") % 80 != 5), F.concat(F.substring(text, 1, 5), F.lit("!\n")))
        .otherwise(text)
    )
    rows = articles(spark, sf).select("doc_id", "sector", F.lit("").alias("summary"), odd.alias("content"))
    return deck.digest_summary(rows, ORDER)


# --------------------------------------------------------------------------- pages and providers


@query
def normalize_pages(spark, sf):
    return pages.normalize_pages(page_table(spark, sf)).select("page_id", "url", "title", "content", "source_name", "lang", "description")


@query
def page_metadata(spark, sf):
    """Heads in all orders and quotings, and pages of two articles, around the documents' words."""
    k, a = F.col("doc_id") % 5, F.concat(F.lit("A"), F.col("doc_id").cast("string"))
    about = F.concat_ws(" ", F.lit("about"), F.col("source"), a)
    tag = lambda form: F.format_string(form, about)
    description = (
        F.when(k == 0, tag("<meta name=\"description\" content=\"%s\">")).when(k == 1, tag("<META content='%s' NAME='Description' />"))
        .when(k == 2, tag("<meta content=\"%s\"\n property=og:description>")).when(k == 3, tag("<!-- <meta name=description content=no> --><meta data-x='a>b' name = description content = '%s' content=no>"))
        .otherwise(F.lit("<meta name=description>"))
    )
    lang = F.when(k == 0, " lang=\"fr\"").when(k == 1, " lang='fr'").when(k == 2, " xml:lang=fr").when(k == 3, " class=x LANG = \"fr\"").otherwise("")
    rest = F.format_string("<meta content='%s &amp; co' name=author><meta property=article:published_time content=2024-01-02><meta name='keywords' content=\"x, %s ,, y\"><meta content=http://i/%s?a=b property='og:image'>", a, a, a)
    body = F.concat(F.lit("<article>short</article><nav>skip</nav><article id='a>b'>"), F.translate(F.substring("text", 1, 200), "<>&\n", "    "), F.lit("<article>inner</article> end</article><p>after</p>"))
    html = F.concat(F.lit("<html"), lang, F.lit("><head><title>T "), a, F.lit("</title>"), description, rest, F.lit("</head><body>"), body, F.lit("</body></html>"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("http://s.example/"), a).alias("url"), html.alias("html"))
    out = pages.normalize_pages(rows)
    return out.select(
        "doc_id", "url", "title", F.regexp_replace("content", r"\s+", " ").alias("content"), "description", "source_name", "lang", "published_raw", joined("authors").alias("authors"), joined("keywords").alias("keywords"), "image_url"
    )


def _request(col):
    return F.floor(F.col(col) / 10).cast("long").alias("request_id")


def newsapi_responses(spark, sf):
    """Ten documents to a response; every seventh response is an error."""
    art = F.struct(
        F.when(F.col("doc_id") % 4 != 3, F.struct(F.lit("id").alias("id"), F.col("source_name").alias("name"))).alias("source"),
        F.col("author"), F.col("title"), F.col("description"), F.col("url"), F.col("content"),
        F.when(F.col("doc_id") % 2 == 0, F.col("published_raw")).alias("publishedAt"),
    )
    rows = articles(spark, sf).select(_request("doc_id"), "doc_id", art.alias("a"))
    packed = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x.a).alias("articles"))
    status = F.when(F.col("request_id") % 7 == 0, "error").otherwise("ok")
    return packed.select("request_id", F.to_json(F.struct(status.alias("status"), "articles")).alias("body"))


def gnews_responses(spark, sf):
    art = F.struct(
        F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "title")).alias("title"),
        "description", "content",
        F.when(F.col("doc_id") % 6 != 0, F.concat("url", F.lit(" "))).alias("url"),
        F.lit(" img ").alias("image"), F.col("published_raw").alias("publishedAt"),
        F.struct(F.concat("source_name", F.lit(" ")).alias("name")).alias("source"),
    )
    rows = articles(spark, sf).select(_request("doc_id"), "doc_id", art.alias("a"))
    packed = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x.a).alias("articles"))
    errors = F.when(F.col("request_id") % 9 == 0, F.array(F.lit("quota")))
    return packed.select("request_id", F.to_json(F.struct(errors.alias("errors"), "articles")).alias("body"))


def filing_feed(spark, sf):
    k = F.col("doc_id") % 3
    title = F.when(k == 0, F.col("source_name")).when(k == 1, F.concat(F.upper("source_name"), F.lit(" : 10-K "))).otherwise(F.concat(F.upper("source_name"), F.lit(": 8-K: item")))
    return articles(spark, sf).select(
        _request("doc_id"), F.col("doc_id").alias("provider_rank"), title.alias("title"),
        F.concat(F.lit("https://f.example/"), F.col("doc_id").cast("string"), F.lit("-index.htm")).alias("link"),
        F.col("published_raw").alias("published"), F.col("description").alias("summary"),
    )


@query
def read_provider_responses(spark, sf):
    rows = providers.read_provider_responses(newsapi_responses(spark, sf), "newsapi")
    return rows.select("request_id", "provider_rank", "url", "title", "source", "publishedAt")


@query
def normalize_newsapi(spark, sf):
    rows = providers.read_provider_responses(newsapi_responses(spark, sf), "newsapi")
    return providers.normalize_newsapi(rows, day("2024-06-01")).drop("content", "description", "author")


@query
def normalize_gnews(spark, sf):
    rows = providers.read_provider_responses(gnews_responses(spark, sf), "gnews")
    return providers.normalize_gnews(rows, day("2024-06-01")).drop("content", "description")


@query
def normalize_filings(spark, sf):
    return providers.normalize_filings(filing_feed(spark, sf)).drop("content")


# --------------------------------------------------------------------------- sources and sinks


def snapshot_files(spark, sf, path):
    """Write the documents as snapshot envelopes, one per sector and day (three articles)."""
    src = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("source_name").alias("name")))).otherwise(F.col("source_name"))
    art = F.struct(
        src.alias("source"), F.col("author"), F.col("title"), F.col("description"), F.col("url"),
        F.col("image_url").alias("urlToImage"), F.col("published_raw").alias("publishedAt"), F.col("content"),
    )
    rows = articles(spark, sf).select("sector", F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "doc_id", art.alias("a"))
    packed = rows.groupBy("sector", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "a"))), lambda x: x.a).alias("articles"))
    packed.select(F.col("sector").alias("query"), "date", "articles").write.json(path)


@query
def read_snapshots(spark, sf):
    path = scratch_path(spark, "snapshots")
    snapshot_files(spark, sf, path)
    rows = snapshots.read_snapshots(spark, path, multi_line=False)
    return rows.select("sector", "url", "provider_rank", "source_name", "title", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss").alias("published"), F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_day"))


def odd_snapshot_files(spark, sf, path):
    """One snapshot file per sector: that of S3 cut off, that of S5 blank, that of S6 without its sector."""
    art = F.struct(F.col("title"), F.col("url"), F.col("published_raw").alias("publishedAt"))
    rows = articles(spark, sf).groupBy("sector").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", art.alias("a")))), lambda x: x.a).alias("articles"))
    whole = F.to_json(F.struct(F.col("sector").alias("query"), F.lit("2024-06-01T00:00:00").alias("date"), "articles"))
    nameless = F.to_json(F.struct(F.lit("2024-06-01T00:00:00").alias("date"), "articles"))
    body = (
        F.when(F.col("sector") == "S3", F.left(whole, F.length(whole) - 20)).when(F.col("sector") == "S5", F.lit(" "))
        .when(F.col("sector") == "S6", nameless).otherwise(whole)
    )
    rows.select(body.alias("value"), F.col("sector").alias("file")).write.partitionBy("file").text(path)


def _of_file(rows):
    return rows.withColumn("file", F.regexp_extract("snapshot_file", "file=(S[0-9])", 1))


@query
def bad_snapshots(spark, sf):
    path = scratch_path(spark, "odd-snapshots")
    odd_snapshot_files(spark, sf, path)
    good = _of_file(snapshots.read_snapshots(spark, path)).groupBy("file").agg(F.count("url").alias("n")).withColumn("reason", F.lit("read"))
    bad = _of_file(snapshots.bad_snapshots(spark, path)).groupBy("file", "reason").agg(F.count("*").alias("n"))
    return good.unionByName(bad)


@query
def stream_bad_snapshots(spark, sf):
    path = scratch_path(spark, "odd-snapshot-stream")
    odd_snapshot_files(spark, sf, path)
    bad = jobs.drain(spark, snapshots.stream_bad_snapshots(spark, path), "bad-snapshots")
    return _of_file(bad).select("file", "reason")


@query
def write_snapshot(spark, sf):
    # the second write replaces two of the partitions, the third writes nothing
    path = scratch_path(spark, "snapshot-table")
    month = F.to_date(F.date_trunc("month", "published_ts")).alias("snapshot_date")
    rows = articles(spark, sf).select("doc_id", "url", "sector", month)
    snapshots.write_snapshot(rows, path)
    again = rows.filter("sector in ('S0', 'S1') and snapshot_date = date'2024-01-01'")
    snapshots.write_snapshot(again.filter("doc_id % 16 < 8"), path)
    snapshots.write_snapshot(rows.filter("sector = 'nowhere'"), path)
    return snapshots.read_snapshot_table(spark, path).select("doc_id", "sector", F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_day"))


@query
def archive_roundtrip(spark, sf):
    path = scratch_path(spark, "archive")
    rows = articles(spark, sf).select("title", "url", F.col("source_name").alias("source"), F.col("published_raw").alias("published_at"), "description", "provider")
    for name in ("newsapi", "gnews"):
        archive.write_archive(rows.filter(F.col("provider") == name).drop("provider"), name, path, day("2024-06-01"))
    back = archive.read_archive(spark, path)
    return back.select("title", "url", "source", "published_at", F.col("meta.source").alias("provider"), "meta.fetched_at", "meta.version")


@query
def write_digest(spark, sf):
    path = scratch_path(spark, "digest")
    rows = deck_rows(spark, sf).select("doc_id", "sector", "title", "source")
    digest.write_digest(rows, path, day("2024-06-01"))
    digest.write_digest(rows.filter("doc_id % 2 = 0"), path, day("2024-06-08"))
    digest.write_digest(rows, path, day("2024-06-08"))
    return spark.read.parquet(path).select("doc_id", "title", F.date_format("issue_date", "yyyy-MM-dd").alias("issue"))


# --------------------------------------------------------------------------- streams


@query
def stream_snapshots(spark, sf):
    path = scratch_path(spark, "snapshot-stream")
    snapshot_files(spark, sf, path)
    rows = snapshots.stream_snapshots(spark, path, multi_line=False).drop("snapshot_file")
    out = jobs.drain(spark, rows, "snapshot-rows")
    return out.select("sector", "url", "provider_rank", "source_name", "title")


def table_stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of part files."""
    raw = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # a pattern, as the path of a stream has to be a folder or a pattern; the table's own name is its only match
    return spark.readStream.schema(raw).parquet(f"{sf}/{name}.parque[t]")


def document_stream(spark, sf):
    return table_stream(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("S"), (F.col("doc_id") % 8).cast("string")).alias("sector"),
        F.concat(F.lit("doc://"), F.md5("text")).alias("url"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3_600).alias("published_ts"),
    )


@query
def stream_dedup(spark, sf):
    out = jobs.drain(spark, jobs.stream_dedup(document_stream(spark, sf)), "stream-dedup")
    return out.select("sector", "url")


@query
def stream_category_counts(spark, sf):
    rows = document_stream(spark, sf).withColumn("categories", terms.categories("content", T.TAXONOMY))
    out = jobs.drain(spark, jobs.stream_category_counts(rows), "stream-categories")
    return out.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "category", "n")


@query
def stream_event_counts(spark, sf):
    rows = table_stream(spark, sf, "events").select(F.col("ts").alias("published_ts"), F.array("event_type").alias("categories"))
    out = jobs.drain(spark, jobs.stream_category_counts(rows), "stream-events")
    return out.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "category", "n")


@query
def stream_category_counts_all(spark, sf):
    rows = document_stream(spark, sf).withColumn("categories", terms.categories("content", T.TAXONOMY))
    out = jobs.drain_all(spark, jobs.stream_category_counts(rows), "stream-all-categories")
    return out.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "category", "n")


@query
def stream_event_counts_all(spark, sf):
    rows = table_stream(spark, sf, "events").select(F.col("ts").alias("published_ts"), F.array("event_type").alias("categories"))
    out = jobs.drain_all(spark, jobs.stream_category_counts(rows), "stream-all-events")
    return out.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "category", "n")


@query
def stream_enrich(spark, sf):
    base = scratch_path(spark, "stream-enrich")
    rows = document_stream(spark, sf).withColumns(
        {
            "provider_rank": F.col("doc_id"), "snapshot_file": F.lit("f"),
            "snapshot_ts": F.col("published_ts"), "snapshot_date": F.to_date(F.date_trunc("month", "published_ts")),
        }
    )
    jobs.stream_enrich(rows, f"{base}/table", f"{base}/checkpoint", entity_dict=T.ENTITIES, taxonomy=T.TAXONOMY, text="content").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("sector", "url", "doc_id", "insights.primary_category")


@query
def stream_enrich_records(spark, sf):
    """The whole records that the stream leaves, as the batch makes them."""
    base = scratch_path(spark, "stream-enrich-records")
    rows = document_stream(spark, sf).withColumns(
        {
            "provider_rank": F.col("doc_id"), "snapshot_file": F.lit("f"),
            "snapshot_ts": F.col("published_ts"), "snapshot_date": F.to_date(F.date_trunc("month", "published_ts")),
        }
    )
    for _ in range(2):  # the second run finds nothing new
        jobs.stream_enrich(rows, f"{base}/table", f"{base}/checkpoint", entity_dict=T.ENTITIES, taxonomy=T.TAXONOMY, text="content").awaitTermination()
    return _records(spark.read.parquet(f"{base}/table"))


# --------------------------------------------------------------------------- pipelines


@query
def build_digest(spark, sf):
    p = page_table(spark, sf).select(F.concat(F.lit("page://"), F.col("page_id").cast("string")).alias("url"), "html")
    rows = articles(spark, sf).filter("doc_id >= 0").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.substring("content", 1, 120)).otherwise(F.col("content")))
    rows = rows.withColumn("url", F.concat(F.lit("page://"), F.col("doc_id").cast("string")))
    out = digest_plan.build_digest(rows, p, 5, phrases=T.BOILERPLATE)
    return out.select("sector", F.col("deck_pos").cast("long"), "url", "title", "date", "accepted", "display_content", "slide_no")


@query
def build_digest_by_search(spark, sf):
    out = digest_plan.build_digest(articles(spark, sf), None, 5, queries=T.QUERIES, lang=None, as_of=day("2024-02-05"), phrases=T.BOILERPLATE)
    return out.select("sector", F.col("deck_pos").cast("long"), "url", "title", "accepted", "slide_no")


@query
def enrich_articles(spark, sf):
    rows = enrich_plan.enrich_articles(articles(spark, sf), T.ENTITIES, T.LEMMAS, T.TAXONOMY)
    i = F.col("insights")
    return rows.select(
        "doc_id", "cleaned_title", "lemmatized_content", joined(i.categories).alias("categories"),
        joined(i.detailed_analysis.key_points).alias("key_points"), r9(i.relevance_score).alias("relevance"), i.summary.alias("summary"),
    )


@query
def build_deck(spark, sf):
    cands = articles(spark, sf).withColumnRenamed("description", "summary").select("sector", "provider", "provider_rank", F.concat("url", F.lit("#alt")).alias("url"), "summary", "content")
    made = deck_plan.build_deck(deck_rows(spark, sf), cands, ORDER, T.BOILERPLATE)
    return made.cards.select("doc_id", "sector", "idx", "slide_no", F.col("slot").cast("long"), "accepted", "shown_url", F.coalesce(F.length("display_content"), F.lit(0)).cast("long").alias("n_shown"))


@query
def preview(spark, sf):
    rows = selection.top_per_sector(selection.dedup_by_url(articles(spark, sf)), 10)
    out = preview_plan.preview(rows, cards.default_sector_meta(spark))
    return out.select("sector", F.col("deck_pos").cast("long"), "preview_title", "preview_date", "sector_description", "heading")


@query
def archive_sources(spark, sf):
    path = scratch_path(spark, "archive-sources")
    now = day("2024-06-01")
    rows = archive_plan.archive_rows(
        {"newsapi": newsapi_responses(spark, sf), "gnews": gnews_responses(spark, sf)}, now, filing_feed(spark, sf), page_table(spark, sf), limit=50, filing_limit=20
    )
    shaped = rows.withColumnRenamed("source_name", "source").withColumnRenamed("published_raw", "published_at")
    archive_plan.archive_sources(shaped, path, now)
    back = archive.read_archive_lines(spark, path)
    return back.groupBy(F.col("meta.source").alias("provider"), "source").agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("title_chars"))


@query
def archive_sources_all(spark, sf):
    """Everything that has landed, article by article, as the archive holds it."""
    path = scratch_path(spark, "archive-sources-all")
    now = day("2024-06-01")
    landed = {"newsapi": newsapi_responses(spark, sf), "gnews": gnews_responses(spark, sf)}
    rows = archive_plan.archive_rows(landed, now, filing_feed(spark, sf), page_table(spark, sf))
    shaped = rows.withColumnRenamed("source_name", "source").withColumnRenamed("published_raw", "published_at")
    archive_plan.archive_sources(shaped, path, now)
    back = archive.read_archive(spark, path)
    return back.select(
        F.col("meta.source").alias("provider"), "title", "url", "source", "published_at", F.md5("content").alias("content_md5"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
