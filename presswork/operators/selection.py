"""Collecting, de-duplicating and choosing a sector's articles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..functions.core import text_or_empty
from ..schema import COLLECTION_ORDER
from ..session import written
from ..sizing import inline_rows
from . import trie


def union_sources(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a provider lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1, out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    ``row_number() <= n`` is planned as a group limit before the shuffle, so each task
    sends at most ``n`` rows per group however large the group is.
    """
    rank = out or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= n)
    return kept if out else kept.drop(rank)


def dedup_by_url(df: DataFrame, order: Iterable = COLLECTION_ORDER) -> DataFrame:
    """Keep the first article of each link within its sector; drop articles without link."""
    linked = df.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    return first_per(linked, ["sector", "url"], list(order))


def top_per_sector(df: DataFrame, n: int = params.DEFAULT_ARTICLES_PER_SECTOR, order: Iterable = COLLECTION_ORDER) -> DataFrame:
    """The first ``n`` articles of each sector, numbered from 1 in ``deck_pos``."""
    return first_per(df, ["sector"], list(order), n, out="deck_pos")


def limit_per(df: DataFrame, n: int, keys: Iterable[str] = (), order: Iterable = COLLECTION_ORDER, floor: int = 1, ceiling: int | None = None) -> DataFrame:
    """Request limit: ``n`` forced into ``floor..ceiling``, per group or over all."""
    n = max(floor, n) if ceiling is None else min(max(floor, n), ceiling)
    keys, order = list(keys), list(order)
    return first_per(df, keys, order, n) if keys else df.orderBy(*order).limit(n)


def collect_sources(dfs: Iterable[DataFrame], n: int = params.DEFAULT_ARTICLES_PER_SECTOR) -> DataFrame:
    """All providers' articles in search order, de-duplicated, up to ``n`` per sector."""
    return top_per_sector(dedup_by_url(union_sources(*dfs)), n)


def expand_queries(sectors: DataFrame, sector_queries: DataFrame) -> DataFrame:
    """One row per sector and search; a sector without searches of its own is searched by name."""
    joined = sectors.join(sector_queries, "sector", "left")
    own = F.coalesce("queries", F.array("sector"))
    rows = joined.select(*sectors.columns, F.posexplode(own).alias("query_idx", "query"))
    return rows.withColumn("quoted_query", X.quote_phrase("query"))


#: Weight of a hit per field.
FIELD_WEIGHTS = {"title": 3, "description": 2, "content": 1}


def _score(parts: dict[str, Column], query: str) -> Column:
    return sum(
        (F.when(X.contains_term(parts[f], query), F.lit(w)).otherwise(F.lit(0)) for f, w in FIELD_WEIGHTS.items()),
        F.lit(0),
    )


def _bare(query: str) -> str:
    """Token form of a search text without outer blanks and quotes."""
    return X.token_form(query.strip().strip('"'))


def search_articles(df: DataFrame, queries: DataFrame | list[tuple[str, int, str]], limit: int = 1_000, trie_limit: int | None = None) -> DataFrame:
    """Articles that hold a search text as an exact phrase, ignoring case.

    ``queries`` has (sector, query_idx, query).  Gives one row per article and search with
    the searched ``sector`` and ``query_idx`` and a ``score`` weighted by field.  Up to
    ``limit`` searches are compared in place one by one, up to ``trie_limit`` (by default
    ``trie.TRIE_ROWS``) by walking a table of all of them, both in place; beyond that the searches' own
    tokens are looked up by their positions.  All ways give the same result; for a corpus
    that is searched again and again, ``search_index`` keeps the positions in files.
    """
    queries = queries if isinstance(queries, DataFrame) else [tuple(q) for q in queries]
    rows = inline_rows(queries, limit)
    base = df.drop("sector", "query_idx")
    if rows is not None:
        texts: dict[str, list[tuple[str, int]]] = {}
        for sector, idx, query in rows:
            texts.setdefault(_bare(query), []).append((sector, int(idx)))
        padded = base.withColumns({f"_{f}": X.token_text(f) for f in FIELD_WEIGHTS})
        parts = {f: F.col(f"_{f}") for f in FIELD_WEIGHTS}
        target = "array<struct<sector:string,query_idx:int>>"
        found = [
            F.struct(
                _score(parts, q).alias("score"),
                F.array(
                    *[F.struct(F.lit(s).alias("sector"), F.lit(i).alias("query_idx")) for s, i in who]
                ).cast(target).alias("who"),
            )
            for q, who in texts.items()
            if q
        ]
        hits = F.filter(F.array(*found), lambda h: h.score > 0) if found else F.array()
        exploded = padded.select(*base.columns, F.explode(hits).alias("_h"))
        return exploded.select(
            *base.columns, F.col("_h.score").alias("score"), F.explode("_h.who").alias("_w")
        ).select(*base.columns, "score", "_w.sector", "_w.query_idx")
    if not isinstance(queries, DataFrame):
        queries = df.sparkSession.createDataFrame(queries, "sector string, query_idx int, query string")
    from .search_index import bare_queries

    asked = bare_queries(queries).groupBy("sector", "query_idx", "phrase").agg(F.count(F.lit(1)).alias("times"))
    asked = written(asked, "searches")
    return _search_by_trie(base, asked) if trie.fits(asked, trie_limit) else _search_by_positions(base, asked)


def _field_tokens(field: str) -> Column:
    return F.split(F.trim(X.token_text(field)), " ", -1)


def _search_by_trie(base: DataFrame, asked: DataFrame) -> DataFrame:
    """Searches as one goto table; nothing is shuffled."""
    terms = asked.select("phrase", F.struct("sector", "query_idx", "times").alias("value"))
    hits, values = trie.scored(terms, [(F.trim(X.token_text(f)), w) for f, w in FIELD_WEIGHTS.items()])
    found = base.select(*base.columns, F.explode(hits).alias("_h"))
    found = found.select(*base.columns, F.col("_h.score").alias("score"), F.explode(values(F.col("_h"))).alias("_w"))
    return found.select(*base.columns, "score", "_w.sector", "_w.query_idx")


def _search_by_positions(base: DataFrame, asked: DataFrame) -> DataFrame:
    """Searches of any number: only their own tokens meet, and articles are joined by their texts once."""
    from .postings import phrase_hits, token_postings
    from .search_index import scored_hits

    key = F.sha2(F.concat_ws("\x01", *[text_or_empty(f) for f in FIELD_WEIGHTS]), 256)
    keyed = base.withColumn("_k", key)
    hits = scored_hits(phrase_hits(token_postings(keyed, "_k", {f: _field_tokens(f) for f in FIELD_WEIGHTS}), asked))
    hits = hits.join(asked, "phrase").select(F.col("id").alias("_k"), "score", "sector", "query_idx", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"))
    return keyed.join(hits, "_k").select(*base.columns, "score", "sector", "query_idx")


def exclude_used(candidates: DataFrame, deck: DataFrame) -> DataFrame:
    """Candidates whose link is not in their sector's deck yet."""
    used = deck.select("sector", "url").filter(F.col("url").isNotNull()).distinct()
    return candidates.join(used, ["sector", "url"], "left_anti")


def backfill_content(df: DataFrame, pages: DataFrame, thin: Column | None = None, keep_if_longer: bool = True) -> DataFrame:
    """Give thin articles the text of their page where that is longer.

    ``pages`` has (url, html) or (url, page_text).  Only thin articles take part in the
    join, so full texts are never shuffled, and only pages some thin article asks for are
    parsed.  Several fetches of one page are reduced to the longest text per task before
    they meet.  With ``keep_if_longer=False`` any page text replaces the thin one.
    """
    from ..sources.pages import page_text

    content = F.coalesce("content", F.lit(""))
    if thin is None:
        thin = F.length(content) < 500
    thin = F.coalesce(thin & (F.coalesce("url", F.lit("")) != ""), F.lit(False))
    asked = df.filter(thin)
    wanted = asked.select("url").distinct()
    found = pages.join(wanted, "url", "left_semi")
    if "page_text" not in pages.columns:
        found = found.select("url", page_text("html").alias("page_text"))
    found = found.groupBy("url").agg(
        F.max(F.struct(F.length("page_text").alias("n"), F.col("page_text"))).alias("_p")
    )
    text = F.col("_p.page_text")
    better = F.length(text) > (F.length(content) if keep_if_longer else F.lit(0))
    filled = asked.join(found, "url", "left").withColumns(
        {
            "content": F.when(better, text).otherwise(F.col("content")),
            "backfilled": F.coalesce(better, F.lit(False)),
        }
    )
    cols = [*df.columns, "backfilled"]
    untouched = df.filter(~thin).withColumn("backfilled", F.lit(False))
    return untouched.select(*cols).unionByName(filled.select(*cols))
