"""Mixing, vectors, training order, the registered queries against SQL, and the pipeline."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from catalog.check import difference, duck
from presswork.llm import mixing, training_order, vectors
from presswork.llm.oracles import ORACLES
from presswork.llm.queries import REGISTRY

from .conftest import odd_texts

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(REGISTRY[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) is None


# --------------------------------------------------------------------------------- mixing


def filled(sizes, weights, most):
    """Targets by clamping and sharing again, one round after the other."""
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    names = sorted(f"s{k}" for k in range(rng.randint(1, 12)))
    sizes = {n: rng.choice([0, 1, 10, 500, 10_000]) for n in names}
    weights = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(names)}
    got = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes, weights, 3) if sum(sizes.values()) else dict.fromkeys(names, 0.0)
    assert {r["source"]: round(r["target"], 6) for r in got} == {n: round(t, 6) for n, t in want.items()}


def test_mix(odd, nothing):
    plan = mixing.plan_mix(odd).collect()
    assert sum(r["copies"] for r in plan) == odd.count()
    taken, sizes, target, longest = Counter(), Counter(), {}, Counter()
    for r in plan:
        assert r["repeats"] <= 3
        taken[r["source"]] += r["size"] * r["repeats"] * r["copies"]
        sizes[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"] * r["copies"])
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    assert all(r["source_size"] == sizes[r["source"]] for r in plan)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    rows = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mix(odd).collect())
    want = {(r["id"], r["source"], r["size"]): r["repeats"] for r in plan}
    own = Counter((r["doc_id"], r["source"], r["text"]) for r in odd.collect())
    count = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert rows == Counter({k: n * want[k[0], k[1], count(k[2])] for k, n in own.items() if want[k[0], k[1], count(k[2])]})
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == 0


# -------------------------------------------------------------------------------- vectors


def brute_vectors(rows):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    use = [(i, y, unit(v) if i is not None and y is not None else None) for i, v, y in rows]
    links = defaultdict(set)
    for a, (_, ya, va) in enumerate(use):
        for b, (_, yb, vb) in enumerate(use):
            if a != b and va is not None and vb is not None and ya == yb and len(va) == len(vb) and va @ vb >= 0.98:
                links[a].add(b)
    out = []
    for a, (i, _, _) in enumerate(use):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((use[b][0] for b in seen if use[b][0] is not None), default=None)
        out.append((-1 if i is None else i, len(links[a]), -1 if low is None else low, i is None or i == low))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0, float("nan")] * 4, 1), (5, [1.0, None] * 4, 1), (6, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (7, [1.0] * 8, None), (8, [1.0] * 4, 1), (9, [1.0] * 8, 1), (9, [1.0] * 8, 1), (10, [2.0] * 8, 1), (11, [2.0] * 8, 2), (12, [1e-30] * 8, 1)]
    for k in range(12):
        middle = rng.standard_normal(8)
        for j in range(rng.integers(1, 12)):
            rows.append((100 * k + 20 + j, [float(x) for x in np.float32(middle + rng.standard_normal(8) * rng.choice([0.0, 0.05, 0.15]))], int(rng.integers(1, 3))))
    df = spark.createDataFrame([(i, v, y, "k", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, key string, vid long")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = [(-1 if r["id"] is None else r["id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()]
    assert sorted(got) == brute_vectors(exact)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_true_pairs_meet():
    """Pairs at the threshold meet in a table, and reach the count, as calibrated."""
    rng = np.random.default_rng(8)
    n, dim, deviation = 3_000, 64, math.sqrt(2 - 2 * 0.98)
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1)[:, None]
    met = (vectors.interval_keys(a, deviation) == vectors.interval_keys(b, deviation)).any(1)
    p = vectors._directions(dim)[0][:, : vectors.COUNTED]
    counted = (np.abs((a - b) @ p) <= vectors.WINDOW * deviation).sum(1) >= vectors._needed()
    assert (met & counted).mean() > 0.998


# ------------------------------------------------------------------------- training order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_permutation(n):
    slots = training_order.permute(np.arange(n), n, 7)
    assert sorted(slots) == list(range(n))
    assert (training_order.permute(slots, n, 7, back=True) == np.arange(n)).all()
    assert n < 100 or (slots != training_order.permute(np.arange(n), n, 8)).any()


def test_round_trip_and_resuming(spark, odd, nothing):
    shards = training_order.training_shards(odd, length=32, per_shard=16)
    again = training_order.training_shards(odd, length=32, per_shard=16)
    rows = {r["shard"]: r for r in shards.collect()}
    assert {k: (bytes(r["payload"]), r["doc_ids"]) for k, r in rows.items()} == {r["shard"]: (bytes(r["payload"]), r["doc_ids"]) for r in again.collect()}
    total = sum(r["n_sequences"] for r in rows.values())
    assert sorted(rows) == list(range(-(-total // 16))) and all(r["first_slot"] == 16 * k for k, r in rows.items())
    assert all(r["n_sequences"] == 16 and len(r["payload"]) == 16 * 64 for k, r in rows.items() if k < max(rows))
    read = training_order.read_sequences(shards, length=32, per_shard=16).collect()
    ids = {r["slot"]: r["ids"] for r in read}
    assert sorted(ids) == list(range(total))
    part = training_order.read_sequences(shards, 21, 40, length=32, per_shard=16).collect()
    assert {r["slot"]: r["ids"] for r in part} == {s: ids[s] for s in range(21, 40)}
    sizes = {r["first_slot"] + k: n for r in rows.values() for k, n in enumerate(r["n_tokens"])}
    order = training_order.permute(np.arange(total), total, training_order.KEY)
    stream = [x for s in order for x in ids[int(s)][: sizes[int(s)]]]
    sp = sentencepiece.SentencePieceProcessor(model_file=training_order.VOCABULARY)
    texts, held = [], []
    for x in stream:
        if x == training_order.END:
            texts.append(sp.decode(held))
            held = []
        else:
            held.append(x)
    assert Counter(texts) == Counter(t or "" for _, t, _ in odd_texts()) and not held
    assert training_order.training_shards(nothing).count() == 0


# ------------------------------------------------------------------------------- pipeline


def test_pipeline(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.count() > 0
            assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, nothing, SF).count() == 0
    assert corpus_pipeline.one_of_each(spark, odd, SF).filter("doc_id between 8 and 10").count() == 1
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_sequences")).first()[0] > 0


def test_pipeline_leaves_its_result_only(spark, monkeypatch):
    from presswork import session

    paths = []
    fresh = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: paths.append(fresh(s, name)) or paths[-1])
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = [p for p in paths if Path(p.removeprefix("file://")).exists()]
    assert len(paths) > 20 and len(left) == 1 and "token-ID" in left[0]
