"""Summaries of many texts against the rule for one text, applied to all of them joined."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as X
from presswork.operators import deck, digests, running

SCHEMA = "deck_pos long, sector string, summary string, content string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(n))


def some_text(rng, kind):
    def clause(n=None):
        return words(rng, n or rng.randint(1, 34))

    if kind == "lines":  # no sentence is usable
        return "".join(rng.choice(["\n", "\n\n", "\n\n\n", words(rng, rng.randint(1, 4)), words(rng, rng.randint(8, 20)) + ","]) for _ in range(rng.randint(1, 6)))
    if kind == "short":
        return words(rng, rng.randint(1, 4)) + rng.choice([".", "! ", "", "\n"])
    parts = []
    for _ in range(rng.randint(1, 5)):
        fitting = [clause(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        sentence = rng.choice([clause(), clause(3), ", ".join(fitting), ";  ".join([*fitting, clause()]), "", "  ", ":\n".join(fitting) + " , "])
        parts.append(sentence + rng.choice([". ", "!", "? ", ".\n", "", ", ", ".\n\n", ";"]))
    return "".join(parts)


def joined(rows):
    """Each sector's texts in order, as one."""
    by = {}
    for _, sector, summary, content in sorted(rows):
        body = summary or content or ""
        if body:
            by.setdefault(sector, []).append(body)
    return {s: "\n".join(t) for s, t in by.items()}


def expected(spark, rows):
    texts = joined(rows)
    df = spark.createDataFrame(list(texts.items()), "sector string, t string")
    return {r[0]: r[1] for r in df.select("sector", X.enhance_summary("t", "t")).collect()}


def make(seed, n=60):
    rng = random.Random(seed)
    kinds = {"S0": "mixed", "S1": "lines", "S2": "short", None: "mixed", "S4": "mixed", "S5": "lines"}
    rows = []
    for i in range(n):
        sector = rng.choice(list(kinds))
        text = some_text(rng, kinds[sector])
        if sector == "S4" and rng.random() < 0.9:
            text = words(rng, 3) + rng.choice([".", ",", ""])
        rows.append((i, sector, text if i % 2 else rng.choice(["", None]), None if i % 2 else text))
    return rows


@pytest.mark.parametrize("seed, start, fan_in, block", [(1, 2, 2, 3), (2, 1, 3, 2), (3, 4, 64, 100), (4, 2, 2, 1)])
def test_summaries(spark, monkeypatch, seed, start, fan_in, block):
    monkeypatch.setattr(digests, "FAN_IN", fan_in)
    monkeypatch.setattr(running.running, "__defaults__", (F.sum, block))
    rows = make(seed)
    got = deck.digest_summary(spark.createDataFrame(rows, SCHEMA).repartition(4), start=start)
    assert {r[0]: r[1] for r in got.collect()} == expected(spark, rows)


def test_every_way_to_a_summary_is_taken(spark):
    """The rows above lead to whole, topped-up, paragraph and cut summaries."""
    ways = set()
    for seed in range(1, 5):
        df = spark.createDataFrame(list(joined(make(seed)).items()), "sector string, t string")
        kept = F.size(X.usable_sentences("t"))
        long_ones = F.size(F.filter(X.paragraphs("t"), lambda p: X.word_count(p) > 10))
        way = F.when(kept >= 15, "whole").when(kept > 0, "topped up").when(long_ones > 0, "paragraphs").otherwise("head")
        ways |= {r[0] for r in df.select(way).collect()}
    assert ways >= {"whole", "topped up", "paragraphs"}


def test_head_without_any_paragraph(spark):
    rows = [(i, "S", "", f"{i}.") for i in range(900)] + [(1000, "T", "", "a b\n\n" * 400), (1001, "T", "", "c.")]
    got = deck.digest_summary(spark.createDataFrame(rows, SCHEMA), start=8)
    assert {r[0]: r[1] for r in got.collect()} == expected(spark, rows)


def test_many_short_texts_stay_apart(spark):
    """A long run of texts without a full stop is one sentence; no row holds more than a few of them."""
    rows = [(i, "S", "", "word " * 6) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_body", F.col("content"))
    texts = df.select("sector", (F.col("deck_pos") + 1).alias("_n"), digests.shrunk("_body").alias("_s"))
    root = digests.folded(texts, "sector").first()
    assert len(root["_s"]) < 1000
    lines = deck.digest_lines(spark.createDataFrame(rows, SCHEMA))
    assert lines.count() == 3000 and lines.filter("paragraph = 0").count() == 3000


def test_shrunk_texts_keep_their_pieces(spark):
    rng = random.Random(8)
    texts = [(some_text(rng, "mixed"), some_text(rng, "mixed"), some_text(rng, "mixed")) for _ in range(300)]
    df = spark.createDataFrame(texts, "a string, b string, c string")
    pieces = lambda *t: F.slice(X.usable_sentences(F.concat_ws("\n", *t)), 1, 15)
    small = digests.shrunk(F.concat_ws("\n", digests.shrunk("a"), digests.shrunk("b")))
    rows = df.select(pieces("a", "b", "c").alias("want"), pieces(small, F.col("c")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(g, n, rng.choice([None, 1, 5, -3])) for g in ("a", None) for n in range(1, 40)]
    df = spark.createDataFrame(rows, "g string, no long, v long").repartition(5)
    for combine, python in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = running.running(df, ["g"], "no", "v", "out", combine, block=7)
        for r in got.collect():
            before = [v for g, n, v in rows if g == r.g and n < r.no and v is not None]
            assert r.out == (python(before) if before else None)


def test_nothing(spark):
    assert deck.digest_summary(spark.createDataFrame([], SCHEMA)).count() == 0
    assert deck.issue_summary(spark.createDataFrame([], SCHEMA)).count() == 0
