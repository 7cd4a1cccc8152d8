"""What the physical plans must and must not contain."""

import re

import pytest

from catalog.queries import REGISTRY
from presswork.sources import archive

SF = "/root/testdata/sf0.001"

NARROW = [
    "clean_text", "remove_stopwords", "enhance_summary", "display_content", "match_categories", "entity_line",
    "lemmatize", "summarize", "key_phrases", "insight_records", "html_to_text", "content_flags", "split_sentences",
]


def plan(spark, name):
    return REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_article_functions_need_no_shuffle(spark, name):
    text = plan(spark, name)
    # the one exchange spreads the small test file over the cores
    assert re.findall(r"Exchange .*?(REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", text) == ["REPARTITION_BY_NUM"]
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["dedup_by_url", "top_per_sector", "limit_per", "term_frequencies_by_sector", "digest_summary"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("name", ["phrase_idf", "term_frequencies", "category_counts", "sector_stats", "mine_entities"])
def test_aggregations_combine_per_task(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["by_sector", "latest_snapshot", "sector_meta"])
def test_articles_stay_where_they_are(spark, name):
    """Tables of sectors are known to be small, however low the threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and "hashpartitioning(sector" not in text


@pytest.mark.parametrize("name", ["search_articles", "backfill_content", "exclude_used", "category_bars", "by_sector", "deck_outline", "fill_slots", "phrase_idf", "sector_meta", "sector_stats", "expand_queries", "preview"])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "MapInPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "language")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


@pytest.mark.parametrize("name", ["build_deck", "deck_layout_2"])
def test_article_texts_are_not_exchanged_for_a_layout(spark, name):
    """Only keys are numbered; articles meet the written slots where they are."""
    text = plan(spark, name)
    assert "hashpartitioning(sector" not in text and "rangepartitioning" not in text
    assert re.findall(r"Exchange .*?(REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", text) == ["REPARTITION_BY_NUM"]


def test_archive_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "a"}]', encoding="utf-8")
    (tmp_path / "b c.json").write_text('{"title": "b"}\n{"title": "c"}\n', encoding="utf-8")
    rows = archive.read_archive(spark, str(tmp_path))
    scans = re.findall(r"Location: InMemoryFileIndex\((\d+) paths?\)", rows._jdf.queryExecution().executedPlan().toString())
    assert scans == ["1", "1"] and sorted(r.title for r in rows.collect()) == ["a", "b", "c"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("\n", encoding="utf-8")
    assert archive.read_archive(spark, str(tmp_path / "none")).count() == 0
