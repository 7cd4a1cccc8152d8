"""Dictionaries too large to ship: blocks of texts ask for the phrases they may have."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.functions import text as X
from presswork.operators import asking, packed, postings, terms
from tests.test_dictionaries import ARTICLE, make


def test_numbers_as_bytes():
    rng = random.Random(1)
    lists = [[], [0], [127, 128, 16_383, 16_384, 2**31, 2**40], [], *[[rng.randrange(1 << rng.randint(1, 35)) for _ in range(rng.randint(0, 9))] for _ in range(50)], []]
    given = packed.packed(np.array([x for y in lists for x in y], np.int64), np.cumsum([len(x) for x in lists]))
    for a, b in ((0, len(lists)), (2, 7), (3, 4), (5, 5)):
        numbers, count = packed.unpacked(given[a:b])
        assert numbers.tolist() == [x for y in lists[a:b] for x in y] and count.tolist() == [len(x) for x in lists[a:b]]
    assert len(given[1].as_py()) == 1 and len(given[2].as_py()) == 1 + 2 + 2 + 3 + 5 + 6


def test_a_block_asks_once_for_each_run():
    texts = pa.array(["a b c a b", "", "a b", "c", None])
    everything = np.full(asking.BITS // 8, 255, np.uint8)
    kept, asked = asking._block(texts.fill_null(""), everything, 4)
    runs = {int(n): r for _, x, numbers in asked for n, r in zip(numbers, x.to_pylist())}
    numbers, count = packed.unpacked(kept)
    assert len(set(runs.values())) == len(runs) == 12 and count.tolist() == [12, 0, 3, 1, 0]
    # in the order of first places, shorter ones first, and the most common ones are the smallest numbers
    assert [runs[n] for n in numbers[:7].tolist()] == ["a", "a b", "a b c", "a b c a", "a b c a b", "b", "b c"]
    assert {runs[n] for n in range(4)} == {"a", "b", "a b", "c"}
    nothing = asking._block(texts.fill_null(""), np.zeros(asking.BITS // 8, np.uint8), 4)
    assert nothing[1] == [] and packed.unpacked(nothing[0])[1].tolist() == [0] * 5


@pytest.mark.parametrize("seed,full", [(21, False), (22, True)])
def test_blocks_and_parts_of_any_size(spark, monkeypatch, seed, full):
    rows, phrases = make(seed, 60)
    # the longest text has four thousand tokens: where the bitmap holds nothing back, its runs would be too many
    rows = [r for r in rows if not full or len(r[3] or "") < 1000]
    df = spark.createDataFrame(rows * 2, ARTICLE).repartition(3)
    taxonomy = [(f"c{k % 7}", p, (k * 5) % 11) for k, p in enumerate(phrases)]
    labels = ["ORG", "PERSON", "GPE", "NORP", "OTHER"]
    surfaces = [(p, labels[k % 5]) for k, p in enumerate(phrases)]
    pick = lambda found, c: Counter((r.doc_id, str(r[c])) for r in found.select("doc_id", c).collect())
    want = pick(terms.match_categories(df, taxonomy), "categories"), pick(terms.match_entities(df, surfaces), "entities")
    for name, value in (("BLOCK", 300), ("EXPANDED", 20), ("PART", 3), ("PARTS", 2)):
        monkeypatch.setattr(asking, name, value)
    if full:
        monkeypatch.setattr(asking, "_bitmap", lambda _: np.full(asking.BITS // 8, 255, np.uint8))
    assert pick(terms.match_categories(df, taxonomy, limit=3, trie_limit=3), "categories") == want[0]
    assert pick(terms.match_entities(df, surfaces, limit=3, trie_limit=3), "entities") == want[1]


def written_rows(monkeypatch):
    """Rows of all tables that are written from here on."""
    found = []
    for module in (terms, asking, postings):
        def write(df, name, kept=module.written):
            found.append((name, (made := kept(df, name)).count()))
            return made
        monkeypatch.setattr(module, "written", write)
    return found


def wide(spark, n=300):
    """Texts of a hundred tokens and a dictionary that has most of their pairs."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(150)}" for _ in range(100)) for _ in range(n)]
    pairs = sorted({" ".join(t.split()[k : k + 2]) for t in texts for k in range(0, 8)})
    return spark.createDataFrame([(k, None, None, t, None, None, None) for k, t in enumerate(texts)], ARTICLE).coalesce(2), texts, pairs


def test_a_large_taxonomy_writes_no_row_per_token(spark, monkeypatch):
    df, texts, pairs = wide(spark)
    found = written_rows(monkeypatch)
    got = terms.match_categories(df, [(f"c{k % 5}", p, k) for k, p in enumerate(pairs)], limit=3, trie_limit=3)
    rank, of = [f"c{k}" for k in range(5)], {p: f"c{k % 5}" for k, p in enumerate(pairs)}
    for r in got.select("doc_id", "categories").collect():
        words = texts[r.doc_id].split()
        met = {of.get(" ".join(words[k : k + 2])) for k in range(len(words))}
        assert r.categories == [c for c in rank if c in met]
    # some 17,000 pairs of text and token; two blocks ask 128 parts
    assert max(n for _, n in found) <= max(len(pairs), len(texts) + 2 * asking.PARTS)


def test_a_large_dictionary_writes_no_row_per_token(spark, monkeypatch):
    df, texts, pairs = wide(spark)
    found = written_rows(monkeypatch)
    labels = ["PERSON", "ORG"]
    got = terms.match_entities(df, [(p, labels[k % 2]) for k, p in enumerate(pairs)], limit=3, trie_limit=3)
    of = {p: labels[k % 2] for k, p in enumerate(pairs)}
    for r in got.select("doc_id", "entities").collect():
        words, want = texts[r.doc_id].split(), {}
        for k in range(len(words) - 1):
            pair = " ".join(words[k : k + 2])
            if pair in of and pair not in want.setdefault(of[pair], []):
                want[of[pair]].append(pair)
        assert r.entities == want
    assert max(n for _, n in found) <= max(len(pairs), len(texts) + 2 * asking.PARTS)


@pytest.mark.parametrize("lower", [True, False])
def test_first_words_are_those_of_the_whole_text(spark, lower):
    texts = [None, "", "  ", "a", " -a-b  c d", "...", "U.S.A", "x" * 100_000 + " y-z", "İi ǅ 𝒳𝒴 😀😀 z", "İİİ", "１２ ४५ _a_b", "éé", "ΟΔΟΣ ΟΔΟΣ. x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3):
        for r in df.select("t", X.first_words("t", n, lower).alias("some"), F.slice(X.word_tokens("t", lower), 1, n).alias("of")).collect():
            assert r.some == r.of, r.t
