import random
from collections import defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from presswork import params
from presswork.operators import cards, filters, numbering, selection
from presswork.plans import build_digest as digest_plan

SCHEMA = "sector string, url string, query_idx int, provider_idx int, provider_rank long, title string, description string, content string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_dedup_keeps_first_in_collection_order(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        url = "hot" if i % 3 == 0 else rng.choice([f"u{rng.randrange(80)}", None, ""])
        rows.append((f"S{rng.randrange(3)}", url, rng.randrange(5), rng.randrange(2), i, "t", "d", "c"))
    want, seen = [], set()
    for r in sorted(rows, key=lambda r: r[2:5]):
        if r[1] and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            want.append((r[0], r[1], r[4]))
    got = selection.dedup_by_url(frame(spark, rows).repartition(5))
    assert sorted((r.sector, r.url, r.provider_rank) for r in got.collect()) == sorted(want)


def test_top_per_sector_limits(spark):
    rows = [("S", f"u{i}", 0, 0, i, "", "", "") for i in range(20)]
    got = selection.top_per_sector(frame(spark, rows), 3).orderBy("deck_pos").collect()
    assert [(r.deck_pos, r.url) for r in got] == [(1, "u0"), (2, "u1"), (3, "u2")]


def test_request_limit_bounds(spark):
    rows = frame(spark, [("S", f"u{i}", 0, 0, i, "", "", "") for i in range(150)])
    assert selection.limit_per(rows, 3, floor=5).count() == 5
    assert selection.limit_per(rows, 500, ceiling=100).count() == 100


def test_expand_queries(spark):
    got = selection.expand_queries(cards.default_sectors(spark), cards.default_sector_queries(spark))
    per = defaultdict(list)
    for r in got.orderBy("query_idx").collect():
        per[r.sector].append((r.query, r.quoted_query))
    assert len(per) == 14 and per["Finance"] == [("Finance", "Finance")]
    assert per["Real Estate"] == [("Real Estate", '"Real Estate"')]
    assert [q for q, _ in per["Supply Chain"]] == params.SECTOR_QUERIES["Supply Chain"]


def test_search_inline_equals_ngram_join(spark, docs):
    queries = [("A", 0, '"of the"'), ("A", 1, "orre"), ("B", 0, "of the"), ("B", 1, "de la"), ("C", 0, "absent phrase"), ("C", 1, "the")]
    inline = selection.search_articles(docs, queries)
    table = spark.createDataFrame(queries, "sector string, query_idx int, query string")
    joined = selection.search_articles(docs, table, limit=1)
    pick = lambda df: sorted((r.doc_id, r.sector, r.query_idx, r.score) for r in df.select("doc_id", "sector", "query_idx", "score").collect())
    assert pick(inline) == pick(joined) and pick(inline)


def test_search_scores_fields(spark):
    rows = [("x", "u", 0, 0, 1, "Supply chain news", "no", "global supply-chain"), ("x", "v", 0, 0, 2, "", "The SUPPLY  CHAIN!", "supply chains")]
    got = selection.search_articles(frame(spark, rows), [("S", 0, '"supply chain"')]).collect()
    assert sorted((r.url, r.score) for r in got) == [("u", 3), ("v", 2)]


def test_backfill(spark):
    rows = [
        ("S", "a", 0, 0, 1, "", "", "short"), ("S", "b", 0, 0, 2, "", "", "x" * 600), ("S", "c", 0, 0, 3, "", "", None),
        ("S", None, 0, 0, 4, "", "", "no link"), ("S", "d", 0, 0, 5, "", "", "longer than page"), ("T", "a", 0, 0, 6, "", "", ""),
    ]
    pages = spark.createDataFrame(
        [("a", "<p>tiny</p>"), ("a", "<p>the long text of the page</p>"), ("b", "<p>" + "y" * 900 + "</p>"), ("c", "<p>found</p>"), ("d", "<p>page</p>")], "url string, html string")
    got = {r.provider_rank: (r.content, r.backfilled) for r in selection.backfill_content(frame(spark, rows), pages).collect()}
    assert got == {1: ("the long text of the page", True), 2: ("x" * 600, False), 3: ("found", True), 4: ("no link", False), 5: ("longer than page", False), 6: ("the long text of the page", True)}
    always = selection.backfill_content(frame(spark, rows), pages, F.length("content") < 100, keep_if_longer=False)
    assert {r.provider_rank: r.content for r in always.collect()}[5] == "page"


def test_exclude_used_is_per_sector(spark):
    cand = frame(spark, [("S", "a", 0, 0, 1, "", "", ""), ("T", "a", 0, 0, 2, "", "", ""), ("S", "b", 0, 0, 3, "", "", "")])
    deck = frame(spark, [("S", "a", 0, 0, 9, "", "", ""), ("S", None, 0, 0, 9, "", "", "")])
    assert sorted((r.sector, r.url) for r in selection.exclude_used(cand, deck).collect()) == [("S", "b"), ("T", "a")]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,), (2,)], "i int")
    assert sorted((r.i, r.s or "") for r in selection.union_sources(a, b).collect()) == [(1, "x"), (2, ""), (2, "")]


@pytest.mark.parametrize("per_range", [10_000, 800, 60])
def test_number_within_equals_brute_force(spark, per_range):
    rng = random.Random(per_range)
    rows = [("hot" if i % 3 else f"g{rng.randrange(40)}", rng.randrange(50), i) for i in range(5000)]
    rows += [(None, None, -1), (None, 3, -2), ("hot", None, -3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(9)
    got = {(r.g, r.a, r.b): r.no for r in numbering.number_within(df, "g", ["a", "b"], "no", per_range).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = {}
    for g, rs in by.items():
        for i, r in enumerate(sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r] = i
    assert got == want


def test_number_within_splits_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    bounds = numbering.range_bounds(df, ["g", "o"], 20_000, 100)
    sizes = [r["count"] for r in df.groupBy(numbering.range_number(["g", "o"], bounds).alias("r")).count().collect()]
    assert len(sizes) >= 90 and max(sizes) < 20_000 * 0.03 and sum(sizes) == 20_000


def test_filters(spark):
    rows = frame(spark, [("S", "a", 0, 0, 1, "t", "d", "x" * 99), ("S", "", 0, 0, 2, "t", "d", "x" * 100), ("S", None, 0, 0, 3, None, None, None)])
    assert filters.require_fields(rows).count() == 1
    assert filters.valid_rows(rows).count() == 2
    flags = {r.provider_rank: r for r in filters.content_flags(rows).collect()}
    assert flags[1].needs_refetch and not flags[2].needs_refetch and flags[3].needs_refetch and flags[2].needs_second_extractor


def test_lookback_is_by_whole_days(spark):
    ts = ["2025-06-16 23:59:59", "2025-06-17 00:00:00", "2025-07-01 23:59:59", "2025-07-02 00:00:00"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp").alias("published_ts"), "t")
    got = filters.lookback(df, F.lit("2025-07-01 08:00:00").cast("timestamp"))
    assert sorted(r.t for r in got.collect()) == ts[1:3]


def test_order_articles(spark):
    df = spark.createDataFrame([("a", 1.0, "2025-01-01"), ("b", 2.0, "2024-01-01"), ("c", 2.0, "2025-01-01")], "url string, score double, d string").withColumn("published_ts", F.col("d").cast("timestamp"))
    assert [r.url for r in filters.order_articles(df).collect()] == ["c", "b", "a"]
    assert [r.url for r in filters.order_articles(df, "recency").collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        filters.order_articles(df, "popularity")


def test_landed_twice_is_chosen_once(spark, docs):
    twice = docs.unionByName(docs)
    once = digest_plan.select_articles(docs, 3)
    both = digest_plan.select_articles(twice, 3)
    key = lambda df: sorted((r.sector, r.deck_pos, r.url) for r in df.collect())
    assert key(once) == key(both) and once.count() == 24


@pytest.mark.parametrize("rows_per_range", [10, 500_000])
def test_rank_articles_has_every_row(spark, monkeypatch, rows_per_range):
    """More rows than the first fifty, with missing values, in one range and in many."""
    monkeypatch.setattr(filters, "number_within", partial(filters.number_within, rows_per_range=rows_per_range))
    df = spark.range(120).select(
        F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("score"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 13 != 0, F.timestamp_seconds(F.col("id") % 5 * 3600)).alias("published_ts"),
    )
    for by in ("relevance", "recency"):
        want = [r.url for r in filters.order_articles(df, by).collect()]
        got = filters.rank_articles(df, by).collect()
        assert [(r["rank"], r.url) for r in sorted(got, key=lambda r: r["rank"])] == list(enumerate(want, 1))
