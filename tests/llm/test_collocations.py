"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presswork.llm import collocations

SCHEMA = "doc_id long, text string, lang string, key string, f long, n long, side long"


def by_counting(rows, most_words, least, covered, top=None):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for s in range(len(words) - k + 1):
                    f[lang, tuple(words[s : s + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    found = []
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        longer = (x for x in often if x[0] == lang and len(x[1]) > len(w) and any(x[1][s : s + len(w)] == w for s in range(len(x[1]) - len(w) + 1)))
        if any(100 * often[x] >= covered * a for x in longer):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.append((lang, -score, -a, " ".join(w).encode(), left, right))
    found.sort()
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in found:
        rank[lang] += 1
        if top is None or rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def make(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "B", "ab", "é", "Éa", "\x01", "a\x01", "\U0001f600", "new", "York"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", ":"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    rows = [(k, t, rng.choice(["en", "en", "fr", "", None])) for k, t in enumerate(texts)]
    return rows + [(None, None, "en"), (1, "", None), (2, " \t\n.,", "xx"), (3, "New york " * 30, None), (3, "New york " * 30, None), (4, "long " * 3000, "long")]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    return [tuple(r) for r in collocations.collocations(df, **kw).orderBy("lang", "rank").collect()]


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"covered": 60}), (3, {"most_words": 3, "top": 7})])
def test_against_counting(spark, seed, kw):
    rows = make(seed)
    want = by_counting(rows, kw.get("most_words", 5), 4, kw.get("covered", 100), kw.get("top"))
    assert len(want) > 20
    assert got(spark, rows, least=4, **kw) == want


def test_ranges_cut_anywhere(spark, monkeypatch):
    """With ranges of a few phrases beginnings lie in other ranges than what extends them."""
    monkeypatch.setattr(collocations, "ROWS_PER_RANGE", 5)
    rows = make(5)
    assert got(spark, rows, least=4) == by_counting(rows, 5, 4, 100)


def test_bitmap_that_marks_everything(spark, monkeypatch):
    monkeypatch.setattr(collocations.Bitmap, "holds", lambda self, hashes: hashes == hashes)
    rows = make(6, 60)
    assert got(spark, rows, least=4) == by_counting(rows, 5, 4, 100)


def test_products_beyond_64_bits(spark):
    n = F.lit(9 * 10**15)
    cut = collocations._lowest_cut(F.lit(10**15), n, F.array(F.lit(10**15 + 7)), F.array(F.lit(10**15 + 9)))
    r = spark.range(1).select(cut.alias("c")).first()["c"]
    assert r["score"] == 1000 * 10**15 * 9 * 10**15 // ((10**15 + 7) * (10**15 + 9))


def test_nothing(spark, nothing):
    assert collocations.collocations(nothing).count() == 0




@pytest.mark.parametrize("top", [1, 3, 40])
def test_lists_are_made_of_bounded_parts(spark, monkeypatch, top):
    monkeypatch.setattr(collocations, "PARTS", 3)
    rows = make(3, 60)
    assert got(spark, rows, least=4, top=top) == by_counting(rows, 5, 4, 100, top)
