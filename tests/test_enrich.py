import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog import fixtures as T
from presswork import params, sizing
from presswork.functions import text as X
from presswork.operators import insights, phrases, selection, summaries, terms
from presswork.plans import enrich as enrich_plan

KEYS = ["doc_id"]


def rows(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.select("doc_id", *cols).collect()}


def test_inline_rows_is_bounded(spark):
    assert sizing.inline_rows(spark.range(11), 10) is None
    assert sizing.inline_rows(spark.range(2), 10) == [(0,), (1,)]
    assert sizing.inline_rows(["a", ("b", "c")]) == [("a",), ("b", "c")]


SAME = [  # rows with one link and different texts, equal texts, no link, punctuation
    ("s", "u", "An R&D plan, a Joint-Venture."), ("s", "u", "joint venture of r d"), ("s", None, "An R&D plan, a Joint-Venture."),
    (None, None, "Acme Corp. and ACME corp; Acme-Corp"), ("s", "u", None), ("s", "v", ""), ("s", "w", "rising rising prices; b2b r&d"),
]


@pytest.fixture(scope="module")
def same(spark):
    return spark.createDataFrame(SAME, "sector string, url string, content string").withColumn("cleaned_content", F.col("content"))


def both(spark, same, match, table, column, columns):
    """The answers of the inlined and of the joined form, for every kind of table."""
    forms = [table, list(table), spark.createDataFrame(table, columns)]
    pick = lambda df: sorted((str(r.content), str(r[column])) for r in df.collect())
    answers = [pick(match(same, t, limit=n)) for t in forms for n in (100, 0)]
    assert all(a == answers[0] for a in answers) and len(answers[0]) == len(SAME)
    return dict(answers[0])


def test_categories_have_one_meaning(spark, same):
    table = [("late", "joint-venture", 9), ("first", "zzz", 0), ("first", "r&d", 7), ("mid", "plan", 3), ("mid", "", 5), ("none", "rd", 1)]
    got = both(spark, same, terms.match_categories, table, "categories", "category string, term string, ord int")
    assert got["An R&D plan, a Joint-Venture."] == "['first', 'mid', 'late']" and got["None"] == "[]"
    assert got["joint venture of r d"] == "[]"


def test_entities_have_one_meaning(spark, same):
    table = [("Acme Corp", "ORG"), ("Acme-Corp", "PERSON"), ("ACME", "GPE"), ("rising", "MONEY"), ("!", "ORG")]
    got = both(spark, same, terms.match_entities, table, "entities", "surface string, label string")
    assert got["Acme Corp. and ACME corp; Acme-Corp"] == str({"ORG": ["Acme Corp"], "GPE": ["ACME"]})


def test_lemmas_have_one_meaning(spark, same):
    table = [("rising", "rise"), ("rising", "up"), ("prices;", "price")]
    got = both(spark, same, lambda df, t, limit: terms.lemmatize(df, t, stopwords=[], limit=limit), table, "lemmatized_content", "token string, lemma string")
    assert got["rising rising prices; b2b r&d"] == "rise rise price b2b r&d"


def test_searches_have_one_meaning(spark, same):
    docs = same.withColumns({"title": F.lit("Joint venture"), "description": F.lit(None).cast("string"), "query_idx": F.lit(0)})
    queries = [("A", 0, ' "joint-venture" '), ("A", 1, '""r&d""'), ("B", 0, "Joint  Venture"), ("B", 1, '""'), ("B", 2, "absent")]
    pick = lambda df: sorted((r.sector, r.query_idx, r.score, str(r.content)) for r in df.collect())
    inline = pick(selection.search_articles(docs, queries))
    assert inline == pick(selection.search_articles(docs, queries, limit=1))
    table = spark.createDataFrame(queries, "sector string, query_idx int, query string")
    assert inline == pick(selection.search_articles(docs, table, limit=1)) == pick(selection.search_articles(docs, table))
    assert len([r for r in inline if r[:2] == ("A", 0)]) == 2 and len([r for r in inline if r[:2] == ("B", 0)]) == len(SAME)


def test_categories_inline_equals_join(spark, docs):
    assert rows(terms.match_categories(docs, T.TAXONOMY), "categories") == rows(terms.match_categories(docs, T.TAXONOMY, limit=0), "categories")


def test_categories_match_exact_forms(spark):
    df = spark.createDataFrame([(1, "It acquired a firm in a Joint Venture."), (2, "They acquire; revenue fell."), (3, ""), (4, None)], "doc_id int, content string")
    got = rows(terms.match_categories(df), "categories")
    assert got == {1: (["partnership"],), 2: (["merger", "financial"],), 3: ([],), 4: ([],)}
    assert rows(terms.match_categories(df).withColumn("p", terms.primary_category("categories")), "p")[3] == ("other",)


def test_entities_inline_equals_join(spark, docs):
    a = rows(terms.match_entities(docs, T.ENTITIES), "entities")
    assert a == rows(terms.match_entities(docs, T.ENTITIES, limit=0), "entities")
    assert any(v[0] for v in a.values())


def test_entities_keep_first_seen_order(spark):
    df = spark.createDataFrame([(1, "Zed met Acme Corp. Acme met Zed, acme corp in Rome; Acme Corp again")], "doc_id int, content string")
    names = {"Acme Corp": "ORG", "Acme": "ORG", "Zed": "PERSON", "Rome": "GPE", "Nowhere": "GPE", "Thing": "MONEY"}
    got = rows(terms.match_entities(df, names), "entities")[1][0]
    assert got == {"ORG": ["Acme", "Acme Corp"], "PERSON": ["Zed"], "GPE": ["Rome"]}


def test_lemmas_inline_equals_join(spark, docs):
    df = docs.withColumn("cleaned_content", X.clean_text("content"))
    assert rows(terms.lemmatize(df, T.LEMMAS), "lemmatized_content") == rows(terms.lemmatize(df, T.LEMMAS, limit=0), "lemmatized_content")


def test_clean_articles_adds_fields_present(spark):
    df = spark.createDataFrame([("The <b>Big</b> markets!",)], "content string")
    r = terms.clean_articles(df, {"markets": "market"}).collect()[0]
    assert r.asDict() == {"content": "The <b>Big</b> markets!", "cleaned_content": "the big markets", "content_no_stopwords": "big markets", "lemmatized_content": "big market"}


def phrase_model(text, stop, signals, extra=()):
    tokens = re.sub(r"([^\w\s]|_)", r" \1 ", text.lower()).split()
    runs, cur = [], []
    for t in tokens + ["|"]:
        if t in stop or not t[0].isalnum():
            if cur:
                runs.append(" ".join(cur))
            cur = []
        else:
            cur.append(t)
    runs = list(runs) + list(extra)
    out = []
    for p, n in Counter(runs).items():
        at = text.lower().find(p)
        s = n / len(runs) * (1 + len(p.split()) * 0.2) * (1.5 - at / len(text) if at >= 0 else 1.0)
        out.append((round(s * (1.5 if any(x in p for x in signals) else 1.0), 9), at, p))
    return sorted(out, key=lambda r: (-r[0], r[1], r[2]))


def test_key_phrases_equal_model(spark, docs):
    stop = set(params.STOPWORDS)
    got = rows(phrases.key_phrases(docs), "key_phrases")
    for r in docs.select("doc_id", "content").collect():
        top = phrase_model(r.content, stop, params.PHRASE_SIGNALS)[:8]
        mine = got[r.doc_id][0]
        assert [p.phrase for p in mine] == [p for _, _, p in top]
        assert [p.score for p in mine] == pytest.approx([s / top[0][0] for s, _, _ in top])


@pytest.mark.parametrize("k", [1, 3, 8, 50])
def test_bounded_phrase_search_changes_nothing(spark, docs, k):
    full = phrases.scored_phrases("content", surfaces=T.ENTITIES, signals=T.PHRASE_SIGNALS)
    best = phrases.scored_phrases("content", surfaces=T.ENTITIES, signals=T.PHRASE_SIGNALS, best=k)
    bad = docs.select(F.slice(full, 1, k).alias("a"), F.slice(best, 1, k).alias("b")).filter("a != b")
    assert bad.count() == 0


def test_phrases_found_only_across_line_breaks(spark):
    # 'solar farm' stands on two lines, so it is not found literally and gets the neutral factor
    df = spark.createDataFrame([(1, "of solar\nfarm and a wind park in the solar\nfarm")], "doc_id int, content string")
    got = rows(phrases.key_phrases(df), "key_phrases")[1][0]
    want = phrase_model("of solar\nfarm and a wind park in the solar\nfarm", set(params.STOPWORDS), params.PHRASE_SIGNALS)
    assert [p.phrase for p in got] == [p for _, _, p in want]


def test_summary_prefers_entities_and_signals(spark):
    text = "Alpha beta gamma delta one two. Acme Corp will launch it today now. Small words fill this line ok."
    df = spark.createDataFrame([(1, text)], "doc_id int, content string")
    got = {r.pos: r for r in summaries.sentence_table(df, KEYS, surfaces={"Acme Corp": "ORG"}).collect()}
    assert [got[i].tok_start for i in range(3)] == [0, 6, 13]
    assert got[1].score == pytest.approx((0.5 + 1 + (1.5 - abs(6 / 3 - 0.5))) * 7)
    one = summaries.summarize(df, 1, entity_dict={"Acme Corp": "ORG"}).first().summary
    assert one == "Acme Corp will launch it today now."


def test_short_summary_falls_back_to_first_sentences(spark):
    text = " ".join(["w"] * 120) + ". " + " ".join(f"a{i} b." for i in range(9))
    df = spark.createDataFrame([(text,)], "content string")
    # the long first sentence scores below zero for its length, so short ones win, then too few words remain
    first5 = ". ".join(text.split(". ")[:5]) + "."
    got = summaries.summarize(df, 3).first().summary
    assert got == first5 or len(got.split()) >= 50


def test_relevance(spark):
    schema = "doc_id int, cats array<string>, phr array<struct<phrase:string,score:double>>, ents map<string,array<string>>"
    df = spark.createDataFrame(
        [(1, ["x"], [("a", 1.0), ("b", 0.5), ("c", 0.3), ("d", 0.2)], {"ORG": ["o"], "PERSON": ["p"], "GPE": ["g"]}), (2, [], [], {}), (3, [], [("a", 1.0)], {"ORG": []}), (4, ["x"], [("a", 1.0)], None)], schema)
    got = rows(df.select("doc_id", insights.relevance_score("cats", "phr", "ents").alias("r"), insights.relevance_score("cats", "phr", "ents", False).alias("f")), "r", "f")
    assert got[1] == pytest.approx((0.3 + 0.2 * 0.6 + 0.4, 0.42))
    assert got[2] == (0.0, 0.0) and got[3] == pytest.approx((0.2, 0.2)) and got[4] == pytest.approx((0.5, 0.5))


def test_insight_record(spark):
    df = spark.createDataFrame([(1, "Acme Corp will launch a new solar panel farm in Rome."), (2, ""), (3, None)], "doc_id int, content string")
    out = {r.doc_id: r.insights for r in insights.extract_insights(df, {"Acme Corp": "ORG", "Rome": "GPE"}).collect()}
    assert out[2] is None and out[3] is None
    assert out[1].categories == ["product"] and out[1].primary_category == "product"
    assert out[1].detailed_analysis.mentioned_organizations == ["Acme Corp"]
    assert out[1].detailed_analysis.mentioned_locations == ["Rome"] and out[1].detailed_analysis.mentioned_people == []
    assert "solar panel farm" in out[1].detailed_analysis.key_points


def test_enrichment_prefers_cleaned_text(spark):
    df = spark.createDataFrame([("u", "t", "d", "Acme LAUNCH 2024!")], "url string, title string, description string, content string")
    r = enrich_plan.enrich_articles(df, {"Acme": "ORG"}).first()
    assert r.cleaned_content == "acme launch" and r.insights.summary == "acme launch"
    assert r.insights.entities == {}  # cleaning removes the case names are told by
    raw = enrich_plan.enrich_articles(df, {"Acme": "ORG"}, text="content").first()
    assert raw.insights.entities == {"ORG": ["Acme"]}


def test_phrase_idf(spark):
    df = spark.createDataFrame([(1, "solar farm. solar farm."), (2, "solar farm, wind park"), (3, "nothing")], "doc_id int, content string")
    got = {r.phrase: (r.doc_count, round(r.idf, 6)) for r in phrases.phrase_idf(df).collect()}
    assert got == {"solar farm": (2, 0.405465), "wind park": (1, 1.098612), "nothing": (1, 1.098612)}


def test_mine_entities_counts_articles(spark):
    df = spark.createDataFrame([(1, "Acme Corp and Acme Corp met Big Blue Co."), (2, "the Acme Corp rose, Intel fell")], "doc_id int, content string")
    assert {r.surface: r.doc_count for r in terms.mine_entities(df, 1).collect()} == {"Acme Corp": 2, "Big Blue Co": 1, "Intel": 1}
    assert terms.mine_entities(df, 2).count() == 1


def test_large_tables_give_the_same_insights(spark, docs):
    names = spark.createDataFrame(list(T.ENTITIES.items()), "surface string, label string")
    terms_table = spark.createDataFrame([(c, t, i) for i, (c, ts) in enumerate(T.TAXONOMY.items()) for t in ts], "category string, term string, ord int")
    inline = insights.extract_insights(docs, T.ENTITIES, T.TAXONOMY)
    joined = insights.extract_insights(docs, names, terms_table, limit=0)
    flat = lambda df: df.select("doc_id", F.to_json("insights.categories").alias("c"), F.to_json("insights.key_phrases").alias("k"), "insights.summary", "insights.relevance_score", F.to_json("insights.detailed_analysis").alias("d"))
    assert flat(inline).exceptAll(flat(joined)).count() == 0
    assert docs.count() == joined.count()
    for fn in (summaries.summarize, phrases.key_phrases):
        a, b = fn(docs, entity_dict=T.ENTITIES), fn(docs, entity_dict=names, limit=0)
        out = (set(a.columns) - set(docs.columns)).pop()
        assert rows(a, out) == rows(b, out)
