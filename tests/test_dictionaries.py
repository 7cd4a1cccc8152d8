"""Phrases looked up one by one, by a goto table and by positions give the same answers."""

import pickle
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.functions import text as X
from presswork.operators import blocks, postings, search_index, selection, terms, trie

WORDS = ["new", "york", "New", "York", "the", "of", "fed", "rate", "x", "é", "-", "U.S."]
ARTICLE = "doc_id long, title string, description string, content string, sector string, id string, token string"


def make(seed, n=80):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))
    rows = [(i, text(5), text(8), text(60), "S", "x", "y") for i in range(n)]
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "", "", "S", None, None), (n + 2, "the", "the " * 400, "new york " * 2000, "S", "", "")]
    rows += [(n + 3, *rows[3][1:]), (n + 3, *rows[3][1:])]
    phrase = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
    return rows, [phrase() for _ in range(60)]


def tokens(text, lower=True):
    return re.findall(r"[^\W_]+|[^\w\s]|_", (text or "").lower() if lower else text or "")


def places(haystack, needle):
    return [i for i in range(len(haystack) - len(needle) + 1) if haystack[i : i + len(needle)] == needle]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrase_hits_and_matches(spark, seed):
    rows, phrases = make(seed)
    df = spark.createDataFrame(rows, ARTICLE).repartition(4)
    wanted = spark.createDataFrame([(" ".join(tokens(p)),) for p in phrases] + [("unknown thing",), ("",)], "phrase string")
    fields = {f: selection._field_tokens(f) for f in ("title", "content")}
    got = postings.phrase_hits(postings.token_postings(df.filter("doc_id < 83"), "doc_id", fields), wanted)
    want = {}
    for r in rows[:83]:
        for f, text in (("title", r[1]), ("content", r[3])):
            for p in {" ".join(tokens(p)) for p in phrases}:
                if at := places(tokens(text), p.split(" ")):
                    want[p, r[0], f] = [i + 1 for i in at]
    assert {(r.phrase, r.id, r.field): r.starts for r in got.collect()} == want and got.count() == len(want)
    found = df.filter("doc_id < 83").select("doc_id", F.explode(trie.matches(wanted.filter("phrase != ''").distinct().withColumn("value", F.upper("phrase")), fields["content"])).alias("m"))
    assert Counter((r.m.path, r.doc_id, r.m.pos) for r in found.collect()) == Counter((p, i, at) for (p, i, f), all_at in want.items() if f == "content" for at in all_at)
    assert all(r.m.value == r.m.path.upper() for r in found.collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_three_ways_of_searching(spark, seed):
    rows, phrases = make(seed)
    df = spark.createDataFrame(rows, ARTICLE).repartition(3)
    queries = [(f"S{k % 3}", k, f' "{p}" ') for k, p in enumerate(phrases)] + [("S", 99, phrases[0]), ("S", 99, phrases[0]), ("S", 100, '""')]
    pick = lambda found: Counter((r.doc_id, r.sector, r.query_idx, r.score) for r in found.select("doc_id", "sector", "query_idx", "score").collect())
    one = pick(selection.search_articles(df, queries))
    assert one == pick(selection.search_articles(df, queries, limit=5)) and one
    assert one == pick(selection.search_articles(df, queries, limit=5, trie_limit=5))


@pytest.mark.parametrize("seed", [5, 6])
def test_three_ways_of_matching(spark, seed):
    rows, phrases = make(seed)
    df = spark.createDataFrame(rows, ARTICLE).repartition(3)
    taxonomy = [(f"c{k % 7}", p, (k * 5) % 11) for k, p in enumerate(phrases)]
    labels = ["ORG", "PERSON", "GPE", "NORP", "OTHER"]
    surfaces = [(p, labels[k % 5]) for k, p in enumerate(phrases)]
    pick = lambda found, c: Counter((r.doc_id, str(r[c])) for r in found.select("doc_id", c).collect())
    ways = [{}, {"limit": 3}, {"limit": 3, "trie_limit": 3}]
    cats = [pick(terms.match_categories(df, taxonomy, **w), "categories") for w in ways]
    ents = [pick(terms.match_entities(df, surfaces, **w), "entities") for w in ways]
    assert cats[0] == cats[1] == cats[2] and len(set(cats[0])) > 20
    assert ents[0] == ents[1] == ents[2] and len(set(ents[0])) > 20


def test_a_large_dictionary_sends_no_texts(spark):
    rows, phrases = make(7)
    df = spark.createDataFrame(rows, ARTICLE)
    for made in (terms.match_categories(df, [("c", p, 1) for p in phrases], limit=3), terms.match_entities(df, [(p, "ORG") for p in phrases], limit=3), selection.search_articles(df, [("s", k, p) for k, p in enumerate(phrases)], limit=3)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------------------------- index


def asked(spark, phrases):
    return spark.createDataFrame([(f"S{k % 3}", k, f'"{p}"') for k, p in enumerate(phrases)] + [("S", 900, "no such words"), ("S", 901, " ")], "sector string, query_idx int, query string")


def once(rows):
    """The first row of each id, as the index takes it."""
    out = {}
    for r in sorted(rows, key=lambda r: tuple(x or "" for x in r[1:4])):
        if r[0] is not None:
            out.setdefault(r[0], r)
    return list(out.values())


def test_index_grows_and_answers_like_a_search(spark, tmp_path):
    rows, phrases = make(8)
    rows.append((None, "new york", "", "", "S", "", ""))
    df, path, q = spark.createDataFrame(rows, ARTICLE).repartition(3), str(tmp_path / "index"), asked(spark, phrases)
    pick = lambda found, key: sorted((r[key], r.sector, r.query_idx, r.score) for r in found.collect())
    assert search_index.search_index(spark, path, q).count() == 0
    assert search_index.extend_index(df.filter("doc_id < 30"), path, "doc_id")
    some = [r for r in rows if r[0] is not None and r[0] < 30]
    want = lambda part: pick(selection.search_articles(spark.createDataFrame(once(part), ARTICLE), q), "doc_id")
    assert pick(search_index.search_index(spark, path, q), "id") == want(some)
    # changed texts of known articles do not count, new articles do
    assert search_index.extend_index(df.withColumn("content", F.when(F.col("doc_id") < 30, "new york").otherwise(F.col("content"))), path, "doc_id")
    assert search_index.extend_index(df, path, "doc_id") is None
    assert pick(search_index.search_index(spark, path, q), "id") == want(rows)
    assert len(search_index.live_batches(spark, path)) == 2
    assert search_index.compact_index(spark, path) and search_index.compact_index(spark, path) is None
    assert len(search_index.live_batches(spark, path)) == 1
    assert pick(search_index.search_index(spark, path, q), "id") == want(rows)


def test_an_unfinished_batch_is_not_there(spark, tmp_path, monkeypatch):
    rows, phrases = make(9, 30)
    df, path, q = spark.createDataFrame(rows, ARTICLE), str(tmp_path / "index"), asked(spark, phrases)
    search_index.extend_index(df.filter("doc_id < 10"), path, "doc_id")
    before = sorted(search_index.search_index(spark, path, q).collect())

    def dies(spark, path, batch, postings, ids, replaces):
        postings.withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
        ids.write.parquet(f"{path}/ids/batch={batch}")
        raise RuntimeError("lost")

    finish = search_index._finish
    monkeypatch.setattr(search_index, "_finish", dies)
    with pytest.raises(RuntimeError):
        search_index.extend_index(df, path, "doc_id")
    assert sorted(search_index.search_index(spark, path, q).collect()) == before
    monkeypatch.setattr(search_index, "_finish", finish)
    assert search_index.extend_index(df, path, "doc_id")
    assert search_index.search_index(spark, path, q).count() > len(before)


def test_a_search_reads_the_buckets_of_its_tokens(spark, tmp_path):
    rows, _ = make(10, 40)
    path = str(tmp_path / "index")
    search_index.extend_index(spark.createDataFrame(rows, ARTICLE), path, "doc_id")
    part = search_index._part(spark, path, "postings")
    mine = part.filter(F.col("bucket").isin([r[0] for r in spark.createDataFrame([("york",)], "token string").select(search_index._bucket("token")).collect()]))
    text = mine._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text)
    assert {r.token for r in mine.select("token").distinct().collect()} >= {"york"}


def test_an_index_has_rows_per_block_and_not_per_article(spark, tmp_path):
    path, n = str(tmp_path / "index"), 500
    search_index.extend_index(spark.createDataFrame([(k, f"new york {k}", "new york", "in new york", "S", "", "") for k in range(n)], ARTICLE).coalesce(1), path, "doc_id")
    part = search_index._part(spark, path, "postings").filter("token = 'york'")
    # 1,500 fields have it; rows are cut at 1,024 places
    assert part.count() < 50 and part.agg(F.sum(F.size("gaps"))).first()[0] == 3 * n
    found = search_index.search_index(spark, path, asked(spark, ["new york", "york 7"]))
    assert sorted((r.id, r.query_idx, r.score) for r in found.collect()) == sorted([(k, 0, 6) for k in range(n)] + [(7, 1, 3)])
    nothing = spark.createDataFrame([("S", 0, '""')], "sector string, query_idx int, query string")
    assert search_index.search_index(spark, path, nothing).collect() == []


def test_places_are_bytes_and_a_search_sends_only_its_own(spark, tmp_path):
    path, n = str(tmp_path / "index"), 300
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(k, "new york", "", f"in new york {k}", "S", "", "") for k in range(n)] + [(n, "york", "", f"york {long} new york", "S", "", "")]
    search_index.extend_index(spark.createDataFrame(rows, ARTICLE).coalesce(1), path, "doc_id")
    part = search_index._part(spark, path, "postings")
    assert dict(part.dtypes)["gaps"] == "array<tinyint>"
    # a step of 70,000 takes three bytes, one of less than 128 a single one
    assert part.filter("token = 'york'").agg(F.sum(F.size("gaps"))).first()[0] == 2 * n + 5
    queries = asked(spark, ["new york", "york w0", f"in new york {n - 1}"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search_index.search_index(spark, path, queries)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.id, r.query_idx, r.score) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(k, 0, 4) for k in range(n)] + [(n, 0, 1), (n, 1, 1), (n - 1, 2, 1)])
    # no join by phrase, and the one with the tokens leaves places where they are
    assert text.count("Join") == 1 and "LeftSemi" in text and "rightHint=(strategy=broadcast)" in text


@pytest.mark.parametrize("limit", [None, 5])
def test_blocks_of_any_size_answer_alike(spark, tmp_path, monkeypatch, limit):
    rows, phrases = make(11, 40)
    df, path, q = spark.createDataFrame(rows, ARTICLE), str(tmp_path / "index"), asked(spark, phrases)
    monkeypatch.setattr(blocks, "BLOCK", 300)
    monkeypatch.setattr(search_index, "live_batches", lambda *_: [])
    search_index.extend_index(df.filter("doc_id < 20"), path, "doc_id")
    # a job that did not see the first one indexes its articles again; they count once
    search_index.extend_index(df, path, "doc_id")
    monkeypatch.undo()
    assert search_index._part(spark, path, "ids").agg(F.countDistinct("block"), F.count("*")).first()[:] >= (10, 60)
    pick = lambda found, key: sorted((r[key], r.sector, r.query_idx, r.score) for r in found.collect())
    want = pick(selection.search_articles(spark.createDataFrame(once(rows), ARTICLE), q), "doc_id")
    assert pick(search_index.search_index(spark, path, q, trie_limit=limit), "id") == want and want


def test_first_tokens_are_those_of_the_whole_text(spark):
    texts = [None, "", "  ", "a", " \t\n a-b  c d", "...", "U.S.A", "x" * 100_000 + " y-z", "\u00a0a\u2028b c", "ΟΔΟΣ ΟΔΟΣ. x", "İi ǅ 𝒳𝒴 😀😀 z", "１２ ४५ _a_b", "a\x1cb\x0bc\x85d", "e\u0301e\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.split(F.trim(X.token_text("t")), " ")
    for n in (1, 3):
        for r in df.select("t", X.first_tokens("t", n).alias("some"), F.slice(whole, 1, n).alias("of")).collect():
            assert r.some == r.of, r.t


def test_a_phrase_with_many_searches_and_values(spark):
    # each of 3,000 searches for one phrase, asked twice: values are listed per phrase, not compared with each other
    df = spark.createDataFrame([(k, "new york", "new york", "in new york", "S", "", "") for k in range(40)], ARTICLE)
    queries = [(f"S{k}", k, "new york") for k in range(3_000)] * 2
    found = selection.search_articles(df, queries, limit=5)
    assert found.agg(F.count("*"), F.countDistinct("doc_id", "sector", "query_idx"), F.min("score"), F.max("score")).first()[:] == (240_000, 120_000, 6, 6)
    cats = terms.match_categories(df, [(f"c{k:04}", "new york", k) for k in range(3_000)], limit=5).select("categories").distinct().collect()
    assert [r.categories for r in cats] == [[f"c{k:04}" for k in range(3_000)]]


def test_no_list_of_searches_is_longer_than_its_bound(spark):
    # 700 searches, every third asked two or three times: what comes out of one row of a batch has to be bounded
    df = spark.createDataFrame([(1, "new york", "", "new york", "S", "", ""), (2, "", "", "x", "S", "", "")], ARTICLE)
    rows = [("new york", (f"S{k}", k, 1 + k % 3 if k % 3 else 1)) for k in range(700)] + [("x", ("S", 9, 1_000))]
    asked = spark.createDataFrame(rows, "phrase string, value struct<sector:string,query_idx:int,times:int>")
    hits, values = trie.scored(asked, [(F.trim(X.token_text(f)), w) for f, w in selection.FIELD_WEIGHTS.items()])
    entries = df.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.score", values(F.col("h")).alias("v")).collect()
    assert max(len(r.v) for r in entries) <= trie.LISTED < 700
    got = Counter((r.doc_id, r.score, tuple(v)) for r in entries for v in r.v)
    assert got == Counter({**{(1, 4, (s, q)): n for p, (s, q, n) in rows if p == "new york"}, (2, 1, ("S", 9)): 1_000})


def test_a_dictionary_row_takes_some_tens_of_bytes():
    n = 250_000
    table = trie.GotoTable(pa.table({"phrase": [f"w{k % 5003} x{k}" for k in range(n)], "value": [{"rank": k % 7, "category": f"c{k % 89}"} for k in range(n)]}))
    assert n < trie.TRIE_ROWS and len(pickle.dumps(table)) < 100 * n
    lists = pa.array([["a", "w2", "x5005", "w2"], None, [], ["x5005", "w2"], ["w3", "x3"]])
    assert [x.tolist() for x in table.find(lists)[:2]] == [[0, 4], [1, 0]]
