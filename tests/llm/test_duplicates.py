"""Near-duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from presswork.llm import components, decontamination, near_duplicates, substrings, words

from .conftest import odd_texts, prose


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    return [top(x) for x in range(n)]


def test_words_are_split_and_hashed_alike():
    texts = ["a b", None, "", " B\ta  b", "b a", "été b"]
    w = words.split(pa.array(texts), words.NON_SPACE, lower=True)
    assert w.counts.tolist() == [2, 0, 0, 3, 1, 2]
    assert [w.text(i, i + 1, lower=True) for i in range(8)] == ["a", "b", "b", "a", "b", "b a", "été", "b"]
    groups = defaultdict(set)
    for i in range(8):
        groups[w.text(i, i + 1, lower=True)].add(int(w.hashes[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_word_runs_stay_within_their_text():
    w = words.split(pa.array(["a b c", "a b", "c a b"]), words.NON_SPACE)
    two, ok = words.runs(w, 2), words.whole(w, 2)
    assert np.flatnonzero(ok).tolist() == [0, 1, 3, 5, 6]
    assert two[0] == two[3] == two[6] != two[1]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(300, links)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[a] == want[b])
    assert 7 in got and components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(rows):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if rows[a][0] is not None and rows[b][0] is not None and sets[a]
        and (rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    ]
    of = roots(len(rows), links)
    low = {}
    for (i, _, _), r in zip(rows, of):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    return sorted(
        (i if i is not None else -1, len(s), low[r] if i is not None else -1, i is None or i == low[r]) for (i, _, _), s, r in zip(rows, sets, of)
    )


def result_near(df):
    return sorted((-1 if r["id"] is None else r["id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


def test_near_duplicates(odd, nothing):
    assert result_near(near_duplicates.near_duplicates(odd)) == brute_near(odd_texts())
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_small_blocks(odd, monkeypatch):
    """A cluster over many blocks, and many members unlike their centre."""
    monkeypatch.setattr(near_duplicates, "CLUSTER_BLOCK", 400)
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(near_duplicates, "LIKE", 0.97)
    assert result_near(near_duplicates.near_duplicates(odd)) == brute_near(odd_texts())


def same_components(vid, sets, links, similarity=0.85):
    """Whether ``links`` join just the sets that true links join."""
    n, percent = len(sets), round(similarity * 100)
    full = [set(s.tolist()) for s in sets]
    want = roots(n, [(a, b) for a in range(n) for b in range(a) if 100 * len(full[a] & full[b]) >= percent * len(full[a] | full[b])])
    at = {int(v): i for i, v in enumerate(vid)}
    got = roots(n, [(at[a], at[b]) for a, b in links])
    return all((got[a] == got[b]) == (want[a] == want[b]) for a in range(n) for b in range(a))


def test_verify_when_the_largest_component_changes():
    """k0-k-j-k1 with company in the order k0, k, k1, j: k and then j lie in the component that is largest."""
    fresh = iter(range(10**6))
    take = lambda count: [next(fresh) for _ in range(count)]

    def changed(elements, part):
        out = list(elements)
        out[6 * part : 6 * part + 6] = take(6)
        return out

    k0 = take(100)
    k = changed(k0, 0)
    j = changed(k, 1)
    k1 = changed(j, 2)
    sets = [k0, k, k1, j, changed(k0, 3), changed(k1, 4), changed(k1, 5)]
    part = lambda of, p: of[6 * p : 6 * p + 6]
    for elements, times in ((part(k0, 0), 4), (part(k0, 1), 8), (part(k1, 2), 4), (k0[18:36], 40)):
        sets += [elements + take(120) for _ in range(times)]
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    vid = np.arange(len(sets)) + 50
    assert same_components(vid, sets, near_duplicates._verify(vid, sets, 0.85))


@pytest.mark.parametrize("seed", range(20))
def test_verify_equals_brute_force(seed):
    """Trees of sets with a few elements changed, among sets that only give company."""
    rng = random.Random(seed)
    sets = [[rng.randrange(10**9) for _ in range(60)]]
    for _ in range(40):
        s = list(rng.choice(sets))
        for i in rng.sample(range(60), rng.choice([2, 4, 4, 5, 8])):
            s[i] = rng.randrange(10**9)
        sets.append(s)
    sets += [rng.sample(rng.choice(sets), 35) + [rng.randrange(10**9) for _ in range(20)] for _ in range(60)]
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    vid = np.array(rng.sample(range(1000), len(sets)))
    assert same_components(vid, sets, near_duplicates._verify(vid, sets, 0.85))


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    for j in (0.3, 0.6, 0.85, 0.95):
        got = []
        for _ in range(60):
            n = 600
            common = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
            r = near_duplicates.registers([a, b])
            got.append(near_duplicates.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(got) - j) < 0.04


def test_registers_merge_by_the_larger_value():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(2))
    r = near_duplicates.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def brute_substrings(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    first = {}
    for (i, _, _), w in zip(rows, split):
        if i is not None:
            for s in range(len(w) - 12):
                k = tuple(w[s : s + 13])
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _, _), w in zip(rows, split):
        gone = set()
        if i is not None:
            for s in range(len(w) - 12):
                if first[tuple(w[s : s + 13])] < i:
                    gone |= set(range(s, s + 13))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("slots", "frequent"), [(8, 2), (20, 2), (20, 32), (27, 4)])
def test_substrings(odd, slots, frequent, monkeypatch):
    """A sketch of any size gives one result, as does any share of salted windows."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    got = substrings.remove_repeats(odd, slots=slots).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_substrings(odd_texts())


def test_substrings_of_nothing(nothing):
    assert substrings.remove_repeats(nothing, slots=10).count() == 0


def brute_hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    out = []
    for i, t, _ in rows:
        w, hit, of = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    of |= windows[k]
        out.append((-1 if i is None else i, len(w), len(hit), sorted(x for x in of if x is not None)))
    return sorted(out)


def test_decontamination(spark, odd, nothing):
    rng = random.Random(9)
    texts = [t for _, t, _ in odd_texts() if t and len(t.split()) > 60]
    items = [(1, None), (2, ""), (3, "..."), (4, "ONE"), (5, "two three"), (6, prose(rng, 30)), (7, "w1 w2 w1")]
    for i, t in enumerate(texts[:6]):
        w = t.split()
        items.append((10 + i, "so, " + ", ".join(w[15:28]) + "!" if i % 2 else " ".join(w[20:34])))
    items.append((10, items[-1][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(odd, bench).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["n_words"], r["n_hit"], sorted(r["items"] or [])) for r in got) == brute_hits(odd_texts(), items)
    assert decontamination.find_contamination(nothing, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(odd, empty).filter("n_hit > 0").count() == 0


def test_digests_are_of_the_kept_text(spark):
    row = substrings.remove_repeats(spark.createDataFrame([(1, " a  b\n")], "doc_id long, text string")).first()
    assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()


def colliding_words():
    """Two words of 1,024 letters that any polynomial hash modulo a power of two takes for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_modulo_powers_of_two(spark):
    x, y = colliding_words()
    w = words.split(pa.array([f"{x} {y}"]), words.NON_SPACE)
    assert w.hashes[0] != w.hashes[1]
    rest = [f"r{k}" for k in range(12)]
    rows = [(1, " ".join([x, *rest]), None), (2, " ".join([y, *rest]), None), (3, x, None), (4, y, None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert result_near(near_duplicates.near_duplicates(df)) == brute_near(rows)
    assert sorted(tuple(r) for r in substrings.remove_repeats(df, slots=10).collect()) == brute_substrings(rows)


def test_long_words_are_hashed_piece_by_piece(monkeypatch):
    texts = ["ab" * 500, "ab" * 500 + "a", "x", "b" + "ab" * 500]
    whole = words.split(pa.array(texts), words.NON_SPACE).hashes.tolist()
    monkeypatch.setattr(words, "_STRETCH", 64)
    assert words.split(pa.array(texts), words.NON_SPACE).hashes.tolist() == whole and len(set(whole)) == 4


def test_plain_words():
    w = words.split(pa.array(["A  b\n", None, "", "Ünï\tÇ x", "Z"]), words.NON_SPACE, lower=True)
    plain, starts, ends = w.plain
    assert plain.decode() == "a b Ünï Ç x z " and [plain[a:b].decode() for a, b in zip(starts, ends)] == ["a", "b", "Ünï", "Ç", "x", "z"]


def test_results_do_not_rest_on_the_hash(spark, odd, monkeypatch):
    """With hashes that agree all the time the words still decide what is linked and what goes."""
    w = words.split(pa.array(["a b c d e f", "a b c d e g", "q w e r t y"]), words.NON_SPACE)
    assert not near_duplicates.alike("a b c d e f", "q w e r t y", 5, 85) and near_duplicates.alike("A b c", "a  B c", 5, 85)
    sets = [np.array([1, 2], np.uint64)] * 3
    texts = ["a b c d e f", "a b c d e f", "q w e r t y"]
    links = near_duplicates._verify(np.array([7, 8, 9]), sets, 0.85, lambda x, y: near_duplicates.alike(texts[x], texts[y], 5, 85))
    assert {frozenset(x) for x in links} == {frozenset((7, 8))} and len(w.starts) == 18


@pytest.mark.parametrize("similarity", [0.45, 0.6, 0.8, 0.85, 0.95])
def test_links_at_any_similarity_are_found(spark, similarity):
    """Pairs just above the threshold among documents that only give company."""
    rng = random.Random(int(100 * similarity))
    rows, n = [], 200
    for k in range(80):
        base = [f"p{k}w{i}" for i in range(n + 4)]
        # d changed words at distances of five or more cost five shingles each
        d = max(d for d in range(1, 40) if (n - 5 * d) / (n + 5 * d) >= similarity + 0.001)
        other = list(base)
        for i in range(d):
            other[4 + 5 * i] = f"x{k}y{i}"
        rows += [(2 * k, " ".join(base), None), (2 * k + 1, " ".join(other), None)]
    rows += [(1000 + k, prose(rng, 150), None) for k in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, similarity=similarity).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(80))
    assert found >= 0.97 * 80
    assert all(got[1000 + k] == 1000 + k for k in range(60))


def test_similarities_that_cannot_be_found_are_refused(spark, nothing):
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(nothing, similarity=0.1)


@pytest.mark.parametrize("block", [150, 1000])
def test_large_clusters_by_their_centre(spark, monkeypatch, block):
    """Chains and stars in clusters of many blocks: members far from the centre meet all others."""
    monkeypatch.setattr(near_duplicates, "CLUSTER_BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(90)]
    rows, texts = [], [base]
    for i in range(70):
        t = list(rng.choice(texts[-6:] if i % 3 else texts))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"e{i}{rng.randrange(99)}"
        texts.append(t)
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)] + [(3, "other words under an id that is there", None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    want = {r[0]: r[2] for r in brute_near(rows[:-1])}
    got = {(r["id"], r["n_shingles"]): r["component_id"] for r in near_duplicates.near_duplicates(df).collect()}
    assert {i: c for (i, n), c in got.items() if n > 20} == want and len(set(want.values())) > 1
