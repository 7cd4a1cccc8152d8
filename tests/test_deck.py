import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presswork import params
from presswork.operators import cards, deck, stats
from presswork.plans import build_deck as deck_plan
from presswork.plans import preview as preview_plan

GOOD = "First sentence here. Second sentence here. Third sentence here."
BAD = "Too short. Click here now."
SCHEMA = "deck_pos long, sector string, url string, title string, source string, date string, summary string, content string, categories array<string>"


def row(i, sector="S", url=None, source="x", content=GOOD, categories=None, summary=""):
    return (i, sector, url or f"u{i}", f"t{i}", source, "2025-01-01", summary, content, categories)


def test_categories_missing_and_empty(spark):
    df = spark.createDataFrame([row(0, categories=["B", "A"]), row(1), row(2, categories=[]), row(3, categories=["a", "B"])], SCHEMA)
    counts = deck.category_counts(df)
    assert {r.category: r.n for r in counts.collect()} == {"A": 1, "B": 2, "Other": 1, "a": 1}
    bars = deck.category_bars(counts).orderBy("bar_no").collect()
    assert [(b.bar_no, b.category, b.bar_inches) for b in bars] == [(1, "B", 6.0), (2, "A", 3.0), (3, "Other", 3.0), (4, "a", 3.0)]


def test_bars_and_legend_are_limited(spark):
    df = spark.createDataFrame([row(i, categories=[f"c{i}"]) for i in range(9)], SCHEMA)
    bars = deck.category_bars(deck.category_counts(df)).orderBy("bar_no").collect()
    assert [b.category for b in bars] == [f"c{i}" for i in range(6)]
    assert [b.in_legend for b in bars] == [True] * 5 + [False]
    assert bars[5].colour == bars[0].colour == params.BAR_COLOURS[0]


@pytest.mark.parametrize("per", [1, 2])
def test_layout(spark, per):
    rng = random.Random(per)
    rows = [row(i, rng.choice(["B", "A", None, "C"])) for i in range(101)]
    got = {r.deck_pos: r for r in deck.deck_layout(spark.createDataFrame(rows, SCHEMA).repartition(7), per_slide=per).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[1] or "General"].append(r[0])
    slide = 1
    slots = params.TWO_UP_SLOTS if per == 2 else params.ONE_UP_SLOTS
    for sector, members in by.items():
        slide += 1
        for idx, pos in enumerate(members):
            if idx % per == 0:
                slide += 1
            g = got[pos]
            assert (g.sector, g.idx, g.slide_no, g.slot) == (sector, idx, slide, idx % per)
            assert (g.left, g.top, g.width, g.height) == slots[idx % per]
    outline = deck.deck_outline(spark.createDataFrame(rows, SCHEMA), per_slide=per).collect()
    assert max(r.slide_no for r in outline) == slide + 1 and len(outline) == len(by) + 2


def fill_model(rows, cands):
    """Slots filled one by one: restricted gaps first, then the others."""
    out = {}
    for sector in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == sector]
        used = {r[2] for r in mine}
        pool = {"newsapi": [], "gnews": []}
        for p in ("newsapi", "gnews"):
            for c in sorted((c for c in cands if c[0] == sector and c[1] == p), key=lambda c: c[2])[:5]:
                if c[3] not in used and c[5] == GOOD:
                    used.add(c[3])
                    pool[p].append(c[3])
        gaps = [r for r in sorted(mine) if r[7] == BAD]
        want = lambda r: ["newsapi"] if "gnews" in r[4].lower() else ["gnews"] if "newsapi" in r[4].lower() else ["newsapi", "gnews"]
        for r in [g for g in gaps if len(want(g)) == 1] + [g for g in gaps if len(want(g)) == 2]:
            for p in want(r):
                if pool[p]:
                    out[r[0]] = pool[p].pop(0)
                    break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fill_slots_equals_model(spark, seed):
    rng = random.Random(seed)
    rows = [row(i, rng.choice("AB"), rng.choice([None, f"n{rng.randrange(12)}"]), rng.choice(["GNews x", "newsapi", "BBC"]), rng.choice([GOOD, BAD, BAD])) for i in range(30)]
    cands = [(s, p, k, rng.choice([f"n{rng.randrange(12)}", f"{p}{k}"]), "", rng.choice([GOOD, GOOD, BAD])) for s in "AB" for p in ("newsapi", "gnews") for k in range(8)]
    df = cards.with_display_content(spark.createDataFrame(rows, SCHEMA))
    cdf = spark.createDataFrame(cands, "sector string, provider string, provider_rank int, url string, summary string, content string")
    got = {r.deck_pos: r.new_url for r in deck.fill_slots(df, cdf).collect()}
    assert got == fill_model(rows, cands) and got


def test_build_deck(spark):
    rows = [row(0), row(1, content=BAD), row(2, "T", content=BAD, categories=["k"])]
    cands = spark.createDataFrame([("S", "newsapi", 0, "new", "", GOOD)], "sector string, provider string, provider_rank int, url string, summary string, content string")
    made = deck_plan.build_deck(spark.createDataFrame(rows, SCHEMA), cands)
    got = {r.deck_pos: (r.slide_no, r.slot, r.accepted, r.shown_url) for r in made.cards.collect()}
    assert got == {0: (3, 0, True, "u0"), 1: (3, 1, False, "new"), 2: (5, 0, False, None)}
    assert {r.sector for r in made.summary.collect()} == {"S", "T"}
    assert made.outline.count() == 4 and made.bars.count() == 2
    plain = deck_plan.place_cards(spark.createDataFrame(rows, SCHEMA))
    assert {r.deck_pos: r.shown_url for r in plain.collect()} == {0: "u0", 1: None, 2: None}


def test_digest_summary_takes_the_first_sentences(spark):
    rows = [row(i, "S", summary="" if i % 2 else f"Summary number {i} is exactly seven words.", content=f"Content {i} has five words. " * 3) for i in range(14)]
    got = deck.digest_summary(spark.createDataFrame(rows, SCHEMA)).first().digest_summary
    each = [[f"Content {i} has five words."] * 3 if i % 2 else [f"Summary number {i} is exactly seven words."] for i in range(10)]
    assert got == " ".join([s for sentences in each for s in sentences][:15])


@pytest.mark.parametrize("start", [2, 3, 32])
def test_digest_summary_takes_all_articles(spark, start):
    """Sixteen articles of one sentence give fifteen; texts without usable sentences do not take a place."""
    say = lambda i: f"Article {i} says just this here."
    rows = [row(i, "S", summary="", content=say(i)) for i in range(16)]
    rows += [row(i, "T", summary="", content="No." if i < 40 else say(i)) for i in range(80)]
    got = {r.sector: r.digest_summary for r in deck.digest_summary(spark.createDataFrame(rows, SCHEMA), start=start).collect()}
    assert got == {"S": " ".join(map(say, range(15))), "T": " ".join(map(say, range(40, 55)))}


def test_issue_summary_goes_on_in_the_next_sector(spark):
    say = lambda s, i: f"Article {s} {i} says just this."
    rows = [row(i, s, summary="", content=say(s, i)) for s in "SR" for i in range(12 if s == "R" else 9)]
    got = deck.issue_summary(spark.createDataFrame(rows, SCHEMA)).collect()
    first, second = [[say(s, i) for i in range(n)] for s, n in (("R", 12), ("S", 9))]
    assert [r.digest_summary for r in got] == [" ".join([*first, *second][:15])]


def test_sample_insights_are_rejected_for_length(spark):
    two = "One sentence of a body. And another one."
    shown = cards.with_display_content(spark.createDataFrame([row(0, content=two)], SCHEMA))
    assert not shown.first().accepted


def test_card_rows(spark):
    df = spark.createDataFrame([row(0, categories=["alpha"])], SCHEMA).withColumn("key_points", F.array(*[F.lit(str(i)) for i in range(9)]))
    r = cards.card_rows(df).first()
    assert r.source_line == "X • 2025-01-01" and r.tag == "ALPHA" and len(r.card_points) == 5 and r.accepted


def test_sector_stats_and_empty_sectors(spark):
    df = spark.createDataFrame([row(0, content="a. b. c. d. e. f."), row(1, content="a.")], SCHEMA)
    wanted = spark.createDataFrame([("S",), ("T",)], "sector string")
    got = {r.sector: (r.articles, r.thin_articles, r.sentences_before) for r in stats.sector_stats(df, wanted).collect()}
    assert got == {"S": (2, 1, 7), "T": (0, 0, 0)}
    assert [r.sector for r in stats.empty_sectors(df, wanted).collect()] == ["T"]


def test_preview(spark):
    rows = spark.createDataFrame([("Supply Chain", 1, "u", "src", " T ", None, "2025-06-26T14:05:00Z", "c"), ("Z", 1, None, None, None, None, None, None)],
        "sector string, deck_pos int, url string, source_name string, title string, description string, published_raw string, content string")
    got = preview_plan.preview(rows, cards.default_sector_meta(spark)).collect()
    assert len(got) == 1
    assert (got[0].preview_title, got[0].sector_icon, got[0].heading) == ("T", "📦", "Supply Chain Sector (1 articles)")


def turns_model(rows, cands):
    """Gaps of 'General' one after the other: each takes its first hit that nobody has."""
    taken, out = {(r[1], r[2]) for r in rows}, {}
    for r in sorted(rows):
        if r[1].lower() != "general" or r[7] != BAD or not r[3]:
            continue
        source = r[4].lower()
        wanted = ["newsapi"] if "gnews" in source else ["gnews"] if "newsapi" in source else ["newsapi", "gnews"]
        for p in wanted:
            holds = lambda c: [w for w, text in ((3, c[6]), (2, c[4]), (1, c[5])) if f" {r[3]} " in f" {text.replace('.', ' . ')} "]
            hits = sorted((c for c in cands if c[1] == p and holds(c)), key=lambda c: (-sum(holds(c)), c[2], c[3]))[:5]
            free = [c[3] for c in hits if (r[1], c[3]) not in taken and c[5] == GOOD]
            if free:
                out[r[0]] = free[0]
                taken.add((r[1], free[0]))
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_general_gaps_are_searched_by_title(spark, seed):
    rng = random.Random(seed)
    words = ["oil", "gas", "oil gas", "sentence"]
    rows = [(i, rng.choice(["General", "general", "A"]), f"n{i}" if i % 5 else f"c{i}", rng.choice([*words, ""]), rng.choice(["GNews x", "newsapi", "BBC"]), "2025", "", rng.choice([GOOD, BAD, BAD]), None) for i in range(40)]
    cands = [(rng.choice("AB"), p, k % 7, rng.choice([f"c{k}", f"{p}{k}"]), rng.choice(["", "gas", "oil gas now"]), rng.choice([GOOD, GOOD, BAD]), rng.choice(["oil", "gas oil gas", "", "sentence"])) for p in ("newsapi", "gnews") for k in range(14)]
    df = cards.with_display_content(spark.createDataFrame(rows, SCHEMA))
    cdf = spark.createDataFrame(cands, "sector string, provider string, provider_rank int, url string, summary string, content string, title string").repartition(3)
    general = {r[0] for r in rows if r[1] != "A"}
    filled = deck.fill_slots(df, cdf).collect()
    assert {r.deck_pos: r.new_url for r in filled if r.deck_pos in general} == turns_model(rows, cands)
    assert {r.deck_pos for r in filled} - general == set(fill_model([r for r in rows if r[1] == "A"], cands))


def test_turns_that_push_each_other_along(spark):
    """Each gap wants what the one before it gets: refusals go through the whole chain."""
    wishes = [(i, "s", i, j, f"u{i - 1 + j}") for i in range(12) for j in range(2)] + [(50, "t", 1, 0, "u0"), (51, "t", 0, 0, "u0")]
    df = spark.createDataFrame(wishes, "_gap long, _s string, _turn int, _place int, new_url string")
    got = {(r["_gap"], r["_place"]) for r in deck.take_turns(df).collect()}
    assert got == {(i, 0) for i in range(12)} | {(51, 0)}
    again = [(i, "s", i, j, f"u{j}") for i in range(6) for j in range(4)]
    got = {(r["_gap"], r["_place"]) for r in deck.take_turns(spark.createDataFrame(again, df.schema)).collect()}
    assert got == {(i, i) for i in range(4)}


def test_gaps_with_one_title_share_its_search(spark, monkeypatch):
    gaps = [("General", f"g{k:03}", "s", False, "new york", k) for k in range(200)]
    body = "This is one sentence of it. " * 8
    cands = [("x", "newsapi" if k % 2 else "gnews", k, f"u{k:03}", "new york" if k % 3 else "other", None, body) for k in range(60)]
    deck_rows = spark.createDataFrame(gaps, "sector string, url string, source string, accepted boolean, title string, deck_pos long")
    found = spark.createDataFrame(cands, "sector string, provider string, provider_rank long, url string, title string, summary string, content string")
    asked, search = [], deck.search_articles
    monkeypatch.setattr(deck, "search_articles", lambda rows, queries: asked.append(queries.count()) or search(rows, queries))
    got = sorted((r.deck_pos, r.new_url) for r in deck.fill_by_title(deck_rows, found).collect())
    best = [[f"u{k:03}" for k in range(60) if k % 3 and k % 2 == odd][: params.REPLACEMENTS_PER_PROVIDER] for odd in (1, 0)]
    assert got == list(enumerate(best[0] + best[1])) and asked == [1]
