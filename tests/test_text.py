import html
from html.entities import html5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork import params
from presswork.functions import core, fields
from presswork.functions import text as X
from presswork.operators import summaries

PHRASES = ["all rights reserved", "licensed under"]


def values(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("t")).alias("v")).collect())]


def one(spark, text, fn):
    return values(spark, [text], fn)[0]


SIX = "w1 w2 w3 w4 w5 w6."
ODD = [
    None, "", "   ", "One. Two! Three?", "a.b c. d", "<p>Hi <b>there</b></p>", "Tom &amp; Jerry &unknown; AT&T",
    " ".join([SIX] * 40), "q" * 3000, "Café naïve", "tab\there\x1cfs\x1fus\x85nel", "x y. " * 200,
]


@pytest.fixture(scope="module")
def texts(docs):
    return ODD + [r.content for r in docs.select("content").collect()]


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), ("   ", ""),
    ("Mail me at x.y@example.com now, or see https://example.com/a?b=1 and www.example.org.", "mail me at now or see and"),
    ("<p>Hi <b>there</b></p><script>var a='<p>';</script>bye", "hi there bye"),
    ("1,234 numbers: 5%! (really) 'quoted' don't", "numbers really quoted dont"),
    ("Café naïve", "caf na ve"), ("Tom &amp; Jerry &lt;b&gt; &#65;&#x42;", "tom jerry ab"),
])
def test_clean_text(spark, text, want):
    assert one(spark, text, X.clean_text) == want


def test_cleaned_text_is_plain_and_stays_as_it_is(spark, texts):
    once = values(spark, texts, X.clean_text)
    assert all(set(t) <= set("abcdefghijklmnopqrstuvwxyz ") and t == " ".join(t.split()) for t in once)
    assert values(spark, once, X.clean_text) == once


def test_decode_entities(spark):
    cases = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&#65;&#x42;&#X43;", "&copy; &copy2", "&nope; & &;", "&#;", "AT&T", "&amp", "x&ampy", "&middot;&quot;&apos;", "&#8211;&euro;"]
    assert values(spark, cases, X.decode_entities) == [html.unescape(c) for c in cases]


def test_every_character_reference(spark):
    cases = [f"a &{name} b" for name in html5] + [f"&{name[:-1]}x;" for name in html5 if name.endswith(";")]
    cases += [f"&#{n};" for n in (*range(0, 300), 0x2028, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**30)]
    cases += ["&#x0;&#x80 &#X9F;&#xD800;&#x10FFFF;&#x110000;&#x00000041;", "&#0000065;", "&#;&#x;&#xg;", "&Aacute;&bigstar; &notit; &#150;"]
    assert values(spark, cases, X.decode_entities) == [html.unescape(c) for c in cases]


@pytest.mark.parametrize("page, want", [
    ("<div>a  b</div>\n\n <p> c </p><style>x{}</style>", "a\nb\nc"), ("plain", "plain"), ("one<br>two", "onetwo"),
    ("a < b and c > d", "a < b and c > d"), ("<!-- no -->yes &amp; <i>more</i>", "yes & more"), (None, ""),
])
def test_html_to_text(spark, page, want):
    assert one(spark, page, X.html_to_text) == want


def test_pages_become_stripped_lines(spark):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for text in values(spark, pages, X.html_to_text):
        assert all(line and line == line.strip() and "  " not in line for line in text.split("\n"))
        assert "<p>" not in text and "<script" not in text


@pytest.mark.parametrize("text, parts, n", [
    ("One. Two! Three?", ["One.", "Two!", "Three?"], 3), ("No stop here", ["No stop here"], 1), ("", [""], 0),
    ("a.b c. d", ["a.b c.", "d"], 3), ("Tail space. ", ["Tail space.", ""], 1), ("Wait... what", ["Wait...", "what"], 2),
])
def test_split_and_count_sentences(spark, text, parts, n):
    assert one(spark, text, X.split_sentences) == parts
    assert one(spark, text, X.count_sentences) == n


TWENTY = " ".join(["word"] * 20)


@pytest.mark.parametrize("summary, content, want", [
    (None, None, params.NO_SUMMARY_TEXT), ("short", "", params.NO_SUMMARY_TEXT),
    ("a summary of more than twenty characters", "", "a summary of more than twenty characters"),
    ("", " ".join([SIX] * 3), " ".join([SIX] * 3)), ("", " ".join([SIX] * 15), " ".join([SIX] * 15)),
    ("", " ".join([SIX] * 40), " ".join([SIX] * 15)),
    # no usable sentence: paragraphs of more than ten words, else the head up to a late full stop
    ("", " ".join(["word"] * 60) + ".", " ".join(["word"] * 60) + "."),
    ("", "q" * 3000, "q" * 2000), ("", "z" * 600 + ". " + "y" * 2000, "z" * 600 + "."),
    # a long sentence falls into its clauses; what the joined clauses leave of the text is added
    ("", ", ".join([TWENTY] * 3), " ".join([TWENTY] * 3) + " rd"),
])
def test_enhance_summary(spark, summary, content, want):
    got = one(spark, content, lambda c: X.enhance_summary(F.lit(summary).cast("string"), c))
    assert got == want


THREE = "One here. Two here. Three here."


@pytest.mark.parametrize("summary, content, want", [
    ("", THREE, THREE), (THREE, "", THREE), ("", "One here. Two here.", None), (THREE, "A longer text. " + "x" * 40, THREE),
    ("", "All Rights Reserved here. " + THREE, THREE), ("", "One. LICENSED under it. Two.", None), ("", None, None),
])
def test_display_content(spark, summary, content, want):
    assert one(spark, content, lambda c: X.display_content(F.lit(summary), c, PHRASES)) == want


@pytest.mark.parametrize("n, want", [(2, None), (3, ""), (15, ""), (16, " ...")])
def test_display_limits(spark, n, want):
    got = one(spark, " ".join(f"Sentence {i}." for i in range(n)), lambda c: X.display_content(F.lit(""), c))
    if want is None:
        assert got is None
    else:
        assert got == " ".join(f"Sentence {i}." for i in range(min(n, 15))) + want


def test_summary_prefers_signals_and_keeps_order(spark):
    text = "Plain words here now. The signal word here now. Plain words there now."
    assert one(spark, text, lambda c: summaries.summary(c, 1, ["signal"])) == "The signal word here now."
    assert one(spark, text, lambda c: summaries.summary(c, 8, ["signal"])) == text
    # fewer than 50 words of a text of more than 100: its first five sentences
    long = " ".join(f"Sentence number {i} is here." for i in range(30))
    assert one(spark, long, lambda c: summaries.summary(c, 8, [])) == " ".join(f"Sentence number {i} is here." for i in range(5))


def test_summaries_are_made_of_the_sentences(spark, texts):
    full = [t for t in texts if t]
    got = values(spark, full, lambda c: F.struct(summaries.summary(c, 8, ["the"]), X.split_sentences(c)))
    for made, parts in got:
        left = iter(p.strip(" ") for p in parts)
        assert not made.strip() or made.split()[0] in {p.split()[0] for p in left if p}
        assert len(made) <= sum(len(p) + 1 for p in parts)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?,;:\n<>&@1é-", max_size=80), min_size=1, max_size=30))
def test_rules_on_random_text(spark, samples):
    got = values(spark, samples, lambda c: F.struct(X.split_sentences(c), X.count_sentences(c), X.enhance_summary(F.lit(""), c), X.display_content(F.lit(""), c, PHRASES)))
    for t, (parts, n, made, card) in zip(samples, got):
        assert "".join("".join(parts).split()) == "".join(t.split())
        assert n <= sum(t.count(x) for x in ".!?") + 1
        assert made == params.NO_SUMMARY_TEXT if not t else len(made) <= len(t) + 1001
        assert card is None or (len(parts) >= 3 and not any(x in card.lower() for x in PHRASES))


def test_remove_stopwords_keeps_contractions(spark):
    assert one(spark, "The dont said New markets  rose", X.remove_stopwords) == "dont markets rose"


def test_quote_phrase(spark):
    assert values(spark, ["one", "two words", '"two words"', '"half quoted'], X.quote_phrase) == ["one", '"two words"', '"two words"', '""half quoted"']


def test_slug(spark):
    assert values(spark, [" Weekly: Märkte & Co ", "a-b_c d"], X.slug) == ["weekly__märkte___co", "a-b_c_d"]


def test_cut_at_sentence(spark):
    long = ("abc def. " * 14) + "x" * 2000 + ". end."
    got = one(spark, long, X.cut_at_sentence)
    assert got == ("abc def. " * 14).strip()
    assert one(spark, "q" * 1500, X.cut_at_sentence) == "q" * 1200
    assert one(spark, "short. one.", X.cut_at_sentence) == "short. one."


def test_term_matching_is_whole_token(spark):
    hit = lambda c: X.contains_term(X.token_text(c), "joint venture")
    dashed = lambda c: X.contains_term(X.token_text(c), "R&D joint-venture")
    assert values(spark, ["an r&d Joint-Venture.", "r d joint venture"], dashed) == [True, False]
    assert values(spark, ["A Joint Venture!", "joint, venture", "joint ventures", "adjoint venture", "joint\nventure"], hit) == [True, False, False, False, True]


def test_candidate_phrases(spark):
    got = one(spark, "The new solar panel farm, and a very big wind turbine. One two three", X.candidate_phrases)
    assert got == ["solar panel farm", "big wind turbine"]
    assert one(spark, "alpha beta gamma delta epsilon", X.candidate_phrases) == ["alpha beta gamma delta epsilon"]
    assert one(spark, "alpha beta gamma delta epsilon", lambda c: X.candidate_phrases(c, longest=4)) == []


def test_source_name(spark):
    got = values(spark, ['{"id":null,"name":" CNN "}', "BBC ", None, '{"id":"x"}'], fields.source_name)
    assert got == ["CNN", "BBC", "Unknown", "Unknown"]


def test_preview_fields(spark):
    assert values(spark, [None, " ", " T "], fields.preview_title) == ["Untitled Article", "Untitled Article", "T"]
    got = values(spark, ["d" * 200, "d" * 201, None], fields.preview_description)
    assert got == ["d" * 200, "d" * 197 + "...", "No description available"]
    got = values(spark, ["2025-06-26T14:05:00Z", "2025-06-26T14:05:00+02:00", "soon", None], fields.preview_date)
    assert got == ["June 26, 2025 14:05", "June 26, 2025 12:05", "soon", "Date not available"]


def test_entity_line(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    line = fields.entity_line(arr("a", "", "b", "c", "d"), arr(), arr("x"))
    assert spark.range(1).select(line).first()[0] == "Organizations: a, b, c | Locations: x"


def test_tags(spark):
    df = spark.createDataFrame([(["alpha", "a very long category", "c"],), ([],)], "c array<string>")
    rows = df.select(fields.tag("c").alias("t"), fields.tags("c").alias("ts")).collect()
    assert rows[0].t == "ALPHA" and [(r.label, round(r.width, 2)) for r in rows[0].ts] == [("ALPHA", 0.75), ("A VERY LONG CATEGORY", 1.5)]
    assert rows[1].t is None and rows[1].ts == []


def test_lookup(spark):
    pairs = {f"k{i}": f"v{i}" for i in range(500)}
    got = values(spark, ["k0", "k499", "missing", "", None], lambda c: core.lookup(pairs, c))
    assert got == ["v0", "v499", None, None, None]


def test_parameters():
    assert len(params.NEWS_STOPWORDS) == 31 and len(params.TAXONOMY) == 7 and len(params.SECTORS) == 14
