import json

import pytest
from pyspark.sql import functions as F

from presswork import schema
from presswork.plans import archive as archive_plan
from presswork.plans.build_digest import build_digest
from presswork.sources import archive, articles, digest, pages, providers, snapshots

def now():
    return F.lit("2025-07-01 08:00:00").cast("timestamp")


def art(**kw):
    base = {"source": "BBC", "author": None, "title": "T", "description": "D", "url": "http://x/1",
            "urlToImage": None, "publishedAt": "2025-06-26T10:00:00Z", "content": "C"}
    return {**base, **kw}


@pytest.fixture()
def folder(tmp_path):
    files = {
        "finance_20250626.json": {"query": "Finance", "date": "2025-06-26T18:00:00.123456", "articles": [
            art(source={"id": None, "name": "CNN"}, url="http://x/1"), art(url="http://x/2", description=None)]},
        "finance_20250630.json": {"query": "Finance", "date": "2025-06-30T18:00:00", "articles": [
            art(url="http://x/1"), {"title": "only title", "url": "http://x/3", "publishedAt": "not a date"}]},
        "real_estate_20250626.json": {"query": "Real Estate", "date": "2025-06-26T18:00:00", "articles": []},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=2), encoding="utf-8")
    (tmp_path / "broken_20250626.json").write_text('{"query": "Broken", "articles": [', encoding="utf-8")
    return str(tmp_path)


def test_read_snapshots(spark, folder):
    rows = snapshots.read_snapshots(spark, folder)
    got = {(r.sector, r.url): r for r in rows.filter("snapshot_date = '2025-06-26' or url is not null").collect()}
    assert got[("Finance", "http://x/2")].source_name == "BBC"
    assert got[("Finance", "http://x/3")].source_name == "Unknown"
    assert got[("Finance", "http://x/3")].published_ts is None
    assert got[("Finance", "http://x/3")].published_raw == "not a date"
    assert got[("Real Estate", None)].provider_rank is None  # an empty snapshot stays countable
    assert rows.count() == 5
    names = {r[0].rsplit("/", 1)[1] for r in rows.select("snapshot_file").distinct().collect()}
    assert names == {"finance_20250626.json", "finance_20250630.json", "real_estate_20250626.json"}
    assert {r.source_name for r in rows.filter("url = 'http://x/1'").collect()} == {"CNN", "BBC"}


def test_latest_snapshot(spark, folder):
    rows = snapshots.read_snapshots(spark, folder)
    newest = {(r.sector, r.url) for r in snapshots.latest_snapshot(rows).collect()}
    assert newest == {("Finance", "http://x/1"), ("Finance", "http://x/3"), ("Real Estate", None)}
    dated = snapshots.latest_snapshot(rows, F.lit("2025-06-26 23:00:00").cast("timestamp"))
    assert {r.url for r in dated.collect()} == {"http://x/1", "http://x/2", None}


def test_fresh(spark, folder):
    rows = snapshots.fresh(snapshots.read_snapshots(spark, folder), now(), 86_400)
    assert {r.url for r in rows.collect()} == {"http://x/1", "http://x/3"}


def test_archive_file_with_metadata(spark, tmp_path):
    body = [{"title": "a", "url": "u", "authors": ["x"], "_metadata": {"source": "newsapi", "fetched_at": "2025", "version": "1.0"}}]
    (tmp_path / "newsapi_20250626_101500.json").write_text(json.dumps(body), encoding="utf-8")
    row = archive.read_archive(spark, str(tmp_path)).collect()[0]
    assert row.meta.source == "newsapi" and row.authors == ["x"]
    assert row.archive_file.endswith("newsapi_20250626_101500.json")
    more = spark.createDataFrame([("b", "v"), ("c", "w")], "title string, url string")
    archive.write_archive(more, "gnews", str(tmp_path), now())
    (tmp_path / "pretty.json").write_text(json.dumps([{"title": "d"}, {"title": "e"}], indent=1), encoding="utf-8")
    assert sorted(r.title for r in archive.read_archive(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d", "e"]


def test_archive_sink_appends_and_skips_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "u1"), ("b", "u2")], "title string, url string")
    archive.write_archive(df.filter("title = 'zzz'"), "gnews", path, now())
    assert not (tmp_path / "out").exists()
    archive.write_archive(df, "gnews", path, now())
    archive.write_archive(df.limit(1), "newsapi", path, now())
    back = archive.read_archive_lines(spark, path)
    assert sorted((r.title, r.meta.source, r.meta.version) for r in back.collect()) == [
        ("a", "gnews", "1.0"), ("a", "newsapi", "1.0"), ("b", "gnews", "1.0")]


def test_newsapi_responses(spark):
    ok = {"status": "ok", "articles": [
        {"source": {"id": None, "name": "CNN"}, "title": "t", "url": "u1", "urlToImage": None, "publishedAt": None},
        {"title": "t2", "url": "u2"}]}
    rows = [(1, json.dumps(ok)), (2, json.dumps({"status": "error", "message": "rate limited", "articles": [{"url": "bad"}]})), (3, "not json"), (4, json.dumps({"status": "ok"}))]
    raw = spark.createDataFrame(rows, "request_id int, body string")
    got = providers.normalize_newsapi(providers.read_provider_responses(raw, "newsapi"), now()).orderBy("provider_rank").collect()
    assert [r.url for r in got] == ["u1", "u2"]
    # an explicit null stays null, an absent key gets the default
    assert (got[0].image_url, got[0].published_raw, got[0].source_name) == (None, None, "CNN")
    assert (got[1].image_url, got[1].published_raw, got[1].source_name) == ("", "2025-07-01T08:00:00", "Unknown")


def test_gnews_responses(spark):
    arts = [
        {"title": " t ", "description": " d", "content": "c ", "url": " u1 ", "image": " i ", "publishedAt": "p", "source": {"name": " S "}},
        {"title": "  ", "url": "u2"}, {"title": "no link"}, {"title": "x", "url": "u4"}]
    rows = [(1, json.dumps({"articles": arts})), (2, json.dumps({"errors": None, "articles": arts})), (3, json.dumps({"errors": ["quota"], "articles": arts}))]
    raw = spark.createDataFrame(rows, "request_id int, body string")
    got = providers.normalize_gnews(providers.read_provider_responses(raw, "gnews"), now()).orderBy("provider_rank").collect()
    assert [(r.url, r.title, r.image_url, r.source_name) for r in got] == [("u1", "t", "i", "S"), ("u4", "x", "", "Unknown")]


def test_filings(spark):
    df = spark.createDataFrame(
        [("no colon", "l"), ("ACME : 10-K ", "https://s/a-index.htm"), ("ACME: 8-K: extra", "l"), (None, None)], "title string, link string"
    ).withColumns({"published": F.lit("p"), "summary": F.lit("s")})
    got = [(r.title, r.url, r.description) for r in providers.normalize_filings(df).collect()]
    assert got == [
        ("Unknown Company - Filing", "l", "Filing filing from Unknown Company"),
        ("ACME - 10-K", "https://s/a.txt", "10-K filing from ACME"),
        ("ACME - 8-K", "l", "8-K filing from ACME"),
        ("Unknown Company - Filing", "", "Filing filing from Unknown Company")]


def test_normalize_pages(spark):
    html = """<html lang="de"><head><title> A &amp; B </title><meta name="description" content="about &quot;x&quot;">
      <meta property="og:image" content="http://i/1.png"><meta name="keywords" content="a, b,,c"><meta name="author" content="Jo">
      </head><body><nav>skip</nav><article><h1>H</h1><p>one  two</p><script>x()</script></article></body></html>"""
    df = spark.createDataFrame([("http://Site.example/p?q=1", html), ("no url", "<p>bare</p>")], "url string, html string")
    a, b = pages.normalize_pages(df).collect()
    assert (a.title, a.description, a.lang, a.source_name) == ("A & B", 'about "x"', "de", "Site.example")
    assert (a.content, a.keywords, a.authors, a.image_url) == ("Hone\ntwo", ["a", "b", "c"], ["Jo"], "http://i/1.png")
    assert (b.title, b.content, b.lang, b.source_name, b.authors) == ("", "bare", "en", "Unknown", [])


def test_snapshot_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", "d1", 1), ("A", "d2", 2), ("B", "d1", 3)], "sector string, snapshot_date string, v int")
    snapshots.write_snapshot(df, path)
    snapshots.write_snapshot(df.filter("v = 1").withColumn("v", F.lit(9)), path)
    snapshots.write_snapshot(df.filter("v = 100"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_digest_sink(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([(1,), (2,)], "v int")
    digest.write_digest(df, path, now(), "json")
    digest.write_digest(df.limit(1), path, now(), "json")
    assert spark.read.json(path).count() == 1


def test_archive_plan(spark):
    body = json.dumps({"status": "ok", "articles": [{"title": "t", "url": "http://x/p", "content": "stub", "source": {"name": "S"}}]})
    raw = spark.createDataFrame([(1, body)], "request_id long, body string")
    page = spark.createDataFrame([("http://x/p", "<html><p>a much longer text than the stub</p></html>")], "url string, html string")
    feed = spark.createDataFrame([(1, i, f"C{i}: 10-K", "l", "p", "s") for i in range(30)], "request_id long, provider_rank long, title string, link string, published string, summary string")
    rows = archive_plan.archive_rows({"newsapi": raw}, now(), feed, page).collect()
    by = {}
    for r in rows:
        by.setdefault(r.provider, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"newsapi": 1, "sec_edgar": 30, "web_scraper": 1}
    assert by["newsapi"][0].content == "a much longer text than the stub"


def test_landed_rows_feed_the_digest(spark, folder, tmp_path):
    rows = articles.to_articles(snapshots.read_snapshots(spark, folder), provider="newsapi")
    assert rows.columns == schema.ARTICLE_COLUMNS
    made = build_digest(rows, n=5).collect()
    assert {r.url for r in made} <= {r.url for r in rows.collect()} and made
    body = json.dumps({"status": "ok", "articles": [{"title": "t", "url": "http://x/p", "content": "First one here. Second one here. Third one here.", "source": {"name": "S"}}]})
    raw = spark.createDataFrame([(1, body)], "request_id long, body string")
    landed = providers.normalize_newsapi(providers.read_provider_responses(raw, "newsapi"), now())
    # no search, provider or position is known: identities are all NULL
    bare = articles.to_articles(landed, sector="S", query_idx=F.lit(None), provider_idx=F.lit(None), provider_rank=F.lit(None))
    assert [(r.sector, r.url, r.accepted) for r in build_digest(bare).collect()] == [("S", "http://x/p", True)]
    archive.write_archive(landed.withColumnRenamed("source_name", "source"), "newsapi", str(tmp_path / "a"), now())
    back = articles.to_articles(archive.read_archive(spark, str(tmp_path / "a")), sector="S").first()
    assert (back.title, back.source_name, back.content, back.lang) == ("t", "S", "First one here. Second one here. Third one here.", "en")


HEADS = [
    """<HTML class=x lang='fr'><head><meta content="about it" name="Description"/></head>""",
    """<html xml:lang="fr"><meta content='about it' property='og:description'>""",
    """<!-- <meta name="description" content="hidden"> --><html lang=fr><META NAME=description CONTENT="about it">""",
    """<html lang="fr" lang="de"><script>'<meta name="description" content="no">'</script><meta name=description content=""><meta data-x="a>b" name="description" content="about it" content="other">""",
    """<html\nlang\n=\n"fr"><meta name='description'\n content\n=\n'about it'>""",
]


@pytest.mark.parametrize("head", HEADS)
def test_metadata_in_any_order_and_quoting(spark, head):
    html = head + """<meta content='Jo "J" Doe' name=author><meta property=article:published_time content=2025-01-02T03:04:05Z><meta name="keywords" content='a &amp; b, c'>
        <meta content=http://i/1.png?a=b property="og:image"><title>T</title><body>x</body></html>"""
    r = pages.normalize_pages(spark.createDataFrame([("http://s/p", html)], "url string, html string")).first()
    assert (r.lang, r.description, r.authors, r.published_raw) == ("fr", "about it", ['Jo "J" Doe'], "2025-01-02T03:04:05Z")
    assert (r.keywords, r.image_url, r.title) == (["a & b", "c"], "http://i/1.png?a=b", "T")


@pytest.mark.parametrize("html, text", [
    ("<article>one</article><nav>NAV</nav><article>two, the longer</article>", "two, the longer"),
    ("<article>a<article class='x>y'>inner</article>b</article><article>c</article>", "ainnerb"),
    ("</article><article>open <p>end", "open end"), ("<articles>no</articles><p>all</p>", "noall"), ("<!--<article>-->x<article>y</article>", "y"),
    ("<ARTICLE\n id=1>z</Article >w", "z"), ("", ""), ("<article></article>rest", ""),
])
def test_choice_of_the_article(spark, html, text):
    assert spark.createDataFrame([(html,)], "html string").select(pages.page_text("html").alias("t")).first().t == text


def test_pages_without_markup(spark):
    df = spark.createDataFrame([("u", None), ("v", "")], "url string, html string")
    assert [(r.title, r.content, r.description, r.lang) for r in pages.normalize_pages(df).collect()] == [("", "", "", "en")] * 2


def put_bad_files(folder):
    (folder / "empty.json").write_text("", encoding="utf-8")
    (folder / "blank.json").write_text(" \n\n ", encoding="utf-8")
    (folder / "other type.json").write_text('{"query": "X", "articles": 5}', encoding="utf-8")
    (folder / "nameless.json").write_text('{"date": "2025-01-01", "articles": []}', encoding="utf-8")


def test_bad_snapshots_are_listed(spark, folder, tmp_path):
    put_bad_files(tmp_path)
    rows = snapshots.read_snapshots(spark, folder)
    assert {r.sector for r in rows.collect()} == {"Finance", "Real Estate"}
    bad = {r.snapshot_file.rsplit("/", 1)[1]: (r.reason, r.record) for r in snapshots.bad_snapshots(spark, folder).collect()}
    assert {k: v[0] for k, v in bad.items()} == {
        "broken_20250626.json": "unreadable", "empty.json": "empty", "blank.json": "empty", "other%20type.json": "unreadable", "nameless.json": "no sector"}
    assert bad["broken_20250626.json"][1] == '{"query": "Broken", "articles": ['


def test_bad_lines_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query": "A", "date": "d", "articles": []}\n{"query": "B", \n\n{"date": "d"}\n', encoding="utf-8")
    assert [r.sector for r in snapshots.read_snapshots(spark, str(tmp_path), multi_line=False).collect()] == ["A"]
    bad = snapshots.bad_snapshots(spark, str(tmp_path), multi_line=False).collect()
    assert sorted((r.reason, r.record or "") for r in bad) == [("no sector", ""), ("unreadable", '{"query": "B", ')]


def test_bad_snapshots_of_a_stream(spark, folder, tmp_path):
    from presswork.streaming import jobs

    put_bad_files(tmp_path)
    bad = jobs.drain(spark, snapshots.stream_bad_snapshots(spark, folder), "bad-snapshots").collect()
    assert {(r.snapshot_file.rsplit("/", 1)[1], r.reason) for r in bad} >= {("broken_20250626.json", "unreadable"), ("other%20type.json", "unreadable"), ("nameless.json", "no sector")}
    good = jobs.drain(spark, snapshots.stream_snapshots(spark, folder), "good-snapshots").collect()
    assert {r.sector for r in good} == {"Finance", "Real Estate"}
