"""Scores recomputed by hand, spans of formats never learned from, alike rows in the mix, the keyed permutation."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from presswork.llm import fitting, mixing, pii, quality, toxicity, training_order

from .conftest import odd_texts, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


# ------------------------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def lexicon(spark, tables):
    return toxicity.fit(*tables, use=~fitting.held_out(F.col("doc_id")))


ORDINARY = [
    "the path through the wood was long and quiet", "a worthwhile walk along the shore", "the disguise of the actor", "the room number was 1053",
    "it cost 455 in 1999 and 2,310 in 2005", "we met at the station and talked about the weather", "her losses were small and the trade was fair",
    "the clowning of the children made everybody laugh", "Scunthorpe is a town in Lincolnshire", "the classic assassin novel of the season", "order no. 8008 and 5318008",
]


def test_ordinary_sentences_are_left_alone(spark, lexicon):
    rows = toxicity.score(spark.createDataFrame([(t,) for t in ORDINARY], "text string"), lexicon).collect()
    assert [r["text"] for r in rows if r["score"] >= 0.5] == []


def test_digits_stand_for_letters_beside_letters_only():
    assert toxicity.fold("1053 455 1D10T y0u 3.14 l00000l") == " 1053 455 idiot you 3 14 lol "
    assert toxicity.fold("іdiоt ｉｄｉｏｔ id­iot i​diot IDIOOOT $h@pe") == " idiot idiot idiot idiot idiot hape "
    assert toxicity.fold("") == "" and toxicity.fold(" \n.,") == ""


def test_scores_by_plain_search(spark, tables, lexicon):
    """Entries by looking at every word, the score from its formula."""
    docs = tables[0].limit(300)
    spared = {tuple(x.split()) for x in lexicon.exceptions}

    def plain(text):
        words = toxicity.fold(text or "").split()
        found = []
        for i, w in enumerate(words):
            if any(tuple(words[max(0, i - k) : i - k + len(p)]) == p for p in spared for k in range(len(p))):
                continue
            own = [(lexicon.terms[e], e) for e in [w, *(w[:k] + "*" for k in range(1, len(w)))] if e in lexicon.terms]
            if own:
                found.append(max(own))
        total, distinct, n = sum(x for x, _ in found), {e: x for x, e in found}, len(words)
        x = [math.log1p(total), total / math.sqrt(n + 10), 10 * total / (n + 20), math.log1p(sum(distinct.values())), max(distinct.values(), default=0), math.log(n + 10) if found else 0]
        return sigmoid(sum(a * b for a, b in zip(lexicon.weights, x)) + lexicon.weights[-1]), [e for _, e in found]

    hits = 0
    for r in toxicity.score(docs, lexicon).collect():
        score, terms = plain(r["text"])
        assert abs(r["score"] - score) < 1e-9 and r["terms"] == terms
        hits += bool(terms)
    assert hits > 5


def test_a_beginning_needs_several_words(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        own = [f"grobx{rng.randrange(40)}"] if toxic and rng.random() < 0.9 else []
        own += ["pathetic"] if toxic else ["pathway"] if rng.random() < 0.4 else []
        rows.append((i, " ".join([prose(rng, 20), *own]), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "pathetic" in model.terms and not any(t.startswith("path") and t.endswith("*") for t in model.terms)
    assert any(t.startswith("grob") and t.endswith("*") for t in model.terms)
    got = toxicity.score(spark.createDataFrame([("grobx77 and grobx99",), ("the pathfinder",)], "text string"), model).collect()
    assert [r["score"] >= 0.5 for r in got] == [True, False]


def test_no_label_of_one_kind_in_the_calibration(spark):
    docs = spark.createDataFrame([(i, "idiot" if i < 3 else "fine words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1)) for i in range(40)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}


# -------------------------------------------------------------------------------- quality


def test_scores_by_compressing_again(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, use=~fitting.held_out(F.col("doc_id")))

    def size(text, raw=None):
        kw = {} if raw is None else {"dict_data": zstandard.ZstdCompressionDict(raw)}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, **kw).compress(text))

    some = docs.limit(150).unionByName(spark.createDataFrame([(-1, "", "en", "s", 0), (-2, None, None, None, 0)], docs.schema))
    for r in quality.score(some, model).collect():
        text = (r["text"] or "").encode()
        z = model.weights[-1]
        if text:
            alone, good, bad, long = size(text), size(text, model.good), size(text, model.bad), len(text) + 16
            d, gap, ratio, log = (bad - good) / alone, bad - good, alone / long, math.log(long)
            x = [d, gap / long, math.copysign(abs(d) ** 0.5, d), math.copysign(math.log1p(abs(gap)), gap), ratio, ratio**2, ratio * d, log, log * d, log * ratio]
            z += sum(a * b for a, b in zip(model.weights, x))
        assert abs(r["score"] - sigmoid(z)) < 1e-6


@pytest.mark.parametrize("kind", ["absent", "cut"])
def test_shares_are_those_of_labelled_documents(spark, kind):
    """Labels without documents, and a sample that ends at its bytes, leave the shares as they are."""
    rng = random.Random(11)
    rows = [(i, prose(rng, 60), int(i % 50 >= 7)) for i in range(1000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = [(i, y) for i, _, y in rows] + ([(5000 + i, 0) for i in range(3000)] if kind == "absent" else [])
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels, max_rows=400, **({} if kind == "absent" else {"max_bytes": 60_000}))
    scores = [r["score"] for r in quality.score(docs, model).select("score").collect()]
    assert abs(sum(scores) / len(scores) - 0.86) < 0.06


def test_samples_are_bounded_by_bytes_not_by_length(spark):
    docs = spark.createDataFrame([(i, "x" * (50_000 if i % 2 else 10)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(200)], "doc_id long, quality int")
    got = fitting.labelled_sample(docs, labels, "doc_id", "text", "quality", None, 1000, 1_000_000)
    assert {y for _, y, _ in got} == {0, 1} and any(len(t) == 50_000 for t, _, _ in got)
    for label in (0, 1):
        own = [(len(t), w) for t, y, w in got if y == label]
        assert sum(n for n, _ in own) < 550_001 and abs(sum(w for _, w in own) - 100) < 1e-6


# ----------------------------------------------------------------------------------- pii

SEEN = [
    ("number", "please ring the phone 0221-4711099 tomorrow", "0221-4711099"), ("number", "his cell is (212) 555 0187, he said", "(212) 555 0187"),
    ("number", "Tel 089/12345678 oder", "089/12345678"), ("number", "tel: 020 7946 0123.", "020 7946 0123"), ("number", "my ssn, 219-09-9999, was", "219-09-9999"),
    ("account", "send it to NL91 ABNA 0417 1643 00 please", "NL91 ABNA 0417 1643 00"), ("account", "IBAN GB82WEST12345698765432.", "GB82WEST12345698765432"),
    ("handle", "mail anna.k at posteo dot de any time", "anna.k at posteo dot de"), ("handle", "write tom_b [at] firm.org now", "tom_b [at] firm.org"),
    ("ip6", "ping 2001:db8:85a3::8a2e:370:7334 first", "2001:db8:85a3::8a2e:370:7334"), ("ip6", "from fe80::1ff:fe23:4567:890a on", "fe80::1ff:fe23:4567:890a"),
]
UNSEEN = [
    "lot 4432-1181-22 was sold", "invoice 2023-000451-77 is paid", "version 4.12.2201.7 came", "in 1914-1918 there were", "isbn 978-3-16-148410-0 by", "the score was 102-98 200-150",
    "IBAN NL91 ABNA 0417 1643 01 please", "code AB12 CDEF GHIJ KLMN of", "we stopped at noon. then it rained", "sales at ten. The rest", "use std::vector a::b here", "at 12:30:45:10 sharp", "1 000 000 000 people",
    "article 20230001123 of the list", "look at this. Next time",
]


@pytest.fixture(scope="module")
def personal(spark, tables):
    return pii.fit(tables[0])


def test_spans_of_formats_never_learned_from(spark, personal):
    rows = [(k, t) for k, (_, t, _) in enumerate(SEEN)] + [(100 + k, t) for k, t in enumerate(UNSEEN)]
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["pii"] if s["kind"] in pii.PROPOSED] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string"), personal).collect()}
    right = sum(got[k] == [(kind, span)] for k, (kind, _, span) in enumerate(SEEN))
    wrong = sum(len(got[100 + k]) for k in range(len(UNSEEN)))
    assert right >= 0.8 * len(SEEN) and wrong <= 1, got


def test_every_kind_can_be_chosen(personal):
    assert set(personal.thresholds) == set(pii.PROPOSED) and max(personal.thresholds.values()) <= 1


def test_formats_are_left_out_whole(spark):
    rows = pii.examples(spark).select("s.kind", "label", "learn", "s.left", F.length("s.text").alias("n")).distinct().collect()
    for kind in pii.PROPOSED:
        for label in (0, 1):
            assert {r["learn"] for r in rows if r["kind"] == kind and r["label"] == label} == {True, False}
    both = Counter((r["kind"], r["label"], r["left"], r["n"]) for r in rows)
    assert max(both.values()) == 1


def test_case_expressions_are_the_fitted_trees(spark, tables):
    rows = pii.sample(tables[0], max_docs=300).cache()
    fitted, trees = pii.fit_trees(rows)
    names = [f"f_{n}" for n in pii.FEATURES]
    told = rows.select(pii.Model(trees, {}).probability(F.col("s")).alias("mine"), *[c.alias(n) for c, n in zip(pii.described(F.col("s")), names)])
    theirs = fitted.transform(VectorAssembler(inputCols=names, outputCol="features").transform(told)).select("mine", "probability").collect()
    assert max(abs(r["mine"] - r["probability"][1]) for r in theirs) < 1e-9 and len(theirs) > 1000


def test_check_digits(spark):
    good = ["DE44 5001 0517 5407 3249 31", "GB82WEST12345698765432", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606"]
    bad = ["DE45 5001 0517 5407 3249 31", "GB82WEST12345698765431"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] == 1 for r in df.select(pii.account_rest(F.col("t"))).collect()] == [True] * 4 + [False] * 2
    books = spark.createDataFrame([("9783161484100",), ("9783161484101",), ("1234567890123",)], "t string")
    assert [r[0] for r in books.select(pii.book_number(F.col("t"))).collect()] == [True, False, False]


# --------------------------------------------------------------------------------- mixing


@pytest.mark.parametrize("alike", [100, 1, 2500])
def test_alike_rows_are_drawn_one_by_one(spark, alike):
    """Rows that nothing tells apart: a target is met to within one of them."""
    rows = [(None, "w " * 10, "a")] * alike + [(i, "w " * 10, "b") for i in range(100)] + [(7, "x y z", "c")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mixing.plan_mix(df)
    each = mixing.each_copy(plan).collect()
    assert len(each) == len(rows) and all(0 <= r["repeats"] <= 3 for r in each)
    taken, mixed = Counter(), Counter()
    for r in each:
        taken[r["source"]] += r["size"] * r["repeats"]
    for r in mixing.mix(df).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert taken == mixed
    for r in plan.select("source", "target").distinct().collect():
        assert abs(taken[r["source"]] - r["target"]) <= 5, (r, taken)


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, "w", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.plan_mix(df)


# ------------------------------------------------------------------------- training order


def feistel(x, size, key):
    """The permutation on plain integers: six rounds on two halves, walked until it is in range."""
    m64 = (1 << 64) - 1

    def stir(v):
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & m64
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & m64
        return v ^ v >> 31

    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(6):
            left, right = right, left ^ (stir((right + stir(key) + stir(r)) & m64) & mask)
        x = left << half | right
        if x < size:
            return x


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_permutation_by_plain_integers(size):
    for key in (1, training_order.KEY):
        assert training_order.permute(np.arange(size), size, key).tolist() == [feistel(x, size, key) for x in range(size)]


def test_end_mark_and_width_of_ids(spark, monkeypatch):
    model = training_order.tokenizer(training_order.VOCABULARY)
    assert training_order.id_format(model) == (training_order.END, "<u2") and training_order.id_format(model, 7)[0] == 7
    with pytest.raises(ValueError):
        training_order.id_format(model, 10**6)
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(50)], "doc_id long, text string")
    read = lambda: sorted((r["slot"], r["doc_id"], tuple(r["ids"])) for r in training_order.read_sequences(training_order.training_shards(df, length=16, per_shard=8, end=9), length=16, per_shard=8).collect())
    narrow = read()
    monkeypatch.setattr(training_order, "id_format", lambda model, end=None: (end, "<u4"))
    assert read() == narrow and narrow[0][2][-1] == 9 or any(9 in ids for _, _, ids in narrow)


def test_ids_by_word_are_those_of_the_whole_text():
    import pyarrow as pa
    import sentencepiece

    texts = ["a  b", " lead", "trail ", "a\nb c\td", "▁x y", "a▁ b", "", None, "x" * 3000, "é ü   z", "\U0001f600 q", "a b c", "  ", "same words same words", "<s> </s> <unk>"]
    texts += [t for _, t, _ in odd_texts()]
    sp = sentencepiece.SentencePieceProcessor(model_file=training_order.VOCABULARY)
    model = training_order.tokenizer(training_order.VOCABULARY)
    assert training_order._encoder(model)[2]
    for _ in range(2):  # the second time from the words that are kept
        got = training_order._encode(model, pa.array(texts), training_order.END, "<u2")
        assert [x.tolist() for x in got] == [[*sp.encode(t or ""), training_order.END] for t in texts]
    sp, known, _ = training_order._encoders[next(iter(training_order._encoders))]
    training_order._encoders[next(iter(training_order._encoders))] = (sp, known, False)  # a vocabulary that joins words
    got = training_order._encode(model, pa.array(texts), training_order.END, "<u2")
    assert [x.tolist() for x in got] == [[*sp.encode(t or ""), training_order.END] for t in texts]
    training_order._encoders.clear()


def test_personal_data_is_learned_from_every_document(spark):
    # 30,000 documents, far more than weigh in full: every labelled span counts, scaled to the share of so many
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call +49 30 "), F.lpad((F.col("id") * 7919).cast("string"), 9, "4"), F.lit(" now")).alias("text"))
    found = pii.labelled(docs)
    assert found.filter("s.kind = 'phone' and label = 1").count() == 30_000
    tallies = pii.tallied(found).collect()
    assert sum(r.n for r in tallies) == found.count() and len(tallies) < 1_000
    seen = []
    kept, pii.fit_trees = pii.fit_trees, lambda rows: (None, seen.append(rows.agg(F.sum(F.when(F.col("s.kind") == "phone", F.col("weight")))).first()[0]) or [])
    try:
        pii.fit(docs, weight_docs=3_000)
    finally:
        pii.fit_trees = kept
    assert abs(seen[0] - 3_000) < 1e-6
