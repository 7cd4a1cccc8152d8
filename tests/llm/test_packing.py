"""Packing: plans of any histogram, ids against the tokenizer, round trip of the sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from presswork.llm import packing

from .conftest import odd_texts


def placed(plan, histogram):
    """Every piece of a histogram with its place: (length, sequence, offset)."""
    out = []
    for length, n in histogram.items():
        if n:
            sequence, offset = plan.place(np.full(n, length), np.arange(n))
            out += zip([length] * n, sequence.tolist(), offset.tolist())
    return out


def best_fit_decreasing(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        k = min((k for k, r in enumerate(room) if r >= x), key=lambda k: room[k], default=None)
        if k is None:
            room.append(capacity - x)
        else:
            room[k] -= x
    return len(room)


def check(histogram, capacity, **kw):
    plan = packing.plan(histogram, capacity, **kw)
    rows = sorted(placed(plan, histogram), key=lambda r: r[1:])
    ends = Counter()
    for length, sequence, offset in rows:
        assert offset == ends[sequence]
        ends[sequence] += length
    assert sorted(ends) == list(range(plan.n_sequences))
    assert max(ends.values(), default=0) <= capacity
    return plan.n_sequences


HISTOGRAMS = {
    "nothing": {}, "one": {7: 1}, "full": {100: 5}, "alike": {34: 1000}, "halves": {50: 7, 51: 3}, "ones": {1: 950}, "thirds": {33: 50, 34: 50, 35: 2},
    "all lengths": {x: 3 for x in range(1, 101)}, "large only": {x: 10 for x in range(60, 100)}, "two": {99: 1, 1: 1},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_of_odd_histograms(name):
    h = HISTOGRAMS[name]
    n = check(h, 100)
    assert n <= 1.02 * best_fit_decreasing([x for x, k in h.items() for _ in range(k)], 100) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_random_histograms(seed):
    rng = random.Random(seed)
    h = Counter(min(200, int(rng.lognormvariate(3.6, 0.9)) + 1) for _ in range(rng.choice([10, 300, 4000])))
    best = best_fit_decreasing(list(h.elements()), 200)
    assert check(h, 200, groups=rng.choice([1, 8]), small_part=rng.choice([2, 3, 8])) <= sum(h.values())
    assert check(h, 200, small_part=rng.choice([3, 4])) <= 1.02 * best + 1


def test_size_of_a_plan_does_not_follow_the_number_of_pieces():
    h = Counter(random.Random(3).choices(range(1, 2049), weights=[1 / x for x in range(1, 2049)], k=5000))
    few, many = (packing.plan({x: times * n for x, n in h.items()}) for times in (1_000, 10_000_000))
    assert len(many.lo) < 1.2 * len(few.lo)
    assert abs(many.n_sequences / 10_000_000 - few.n_sequences / 1_000) < 0.01 * few.n_sequences / 1_000


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups({10: 5, 9: 1, 7: 6, 3: 4}, 4)
    assert groups == [(10, 4), (10, 4), (7, 4), (3, 4)]


TEXTS = odd_texts() + [
    (300, "Hello<|endoftext|>there <|startoftext|> it's we'll 12345 ÅΣΑΣ ſtraße é ́x y z\x1cq İI", "a"),
    (301, "don't\tstop\x0bnow ... !!! 'S 你好世界 กำ \U0001f468‍\U0001f469", "a"),
]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(i, t, 5, 6, "p") for i, t, _ in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence long, part string").repartition(3)
    return packing.pack(df, capacity=512, with_ids=True).cache()


def test_pieces_are_what_the_tokenizer_gives(packed):
    encoder = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, t, _ in TEXTS:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 512)):
            part = ids[s : s + 512]
            want[i, k, s, len(part), zlib.crc32(part.tobytes()), part.tobytes()] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["crc32"], bytes(r["ids"])) for r in packed.collect()) == want


def test_sequences_hold_their_pieces(packed):
    rows = {r["sequence"]: r for r in packing.sequences(packed).collect()}
    seen = 0
    for r in packed.collect():
        whole = rows[r["sequence"]]
        assert bytes(whole["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert whole["doc_ids"][whole["starts"].index(r["offset"])] == r["id"]
        seen += r["length"]
    assert sum(len(r["ids"]) for r in rows.values()) == 4 * seen  # no gaps
    assert max(len(r["ids"]) for r in rows.values()) <= 4 * 512
    assert len(rows) <= best_fit_decreasing([r["length"] for r in packed.collect()], 512) + 1


def test_nothing(spark, nothing):
    found = packing.pack(nothing)
    assert found.columns == ["id", "piece", "start", "length", "crc32", "sequence", "offset"] and found.count() == 0
