"""Filter audit: coalitions against running every order of the filters over the documents."""

import math
import random
from itertools import permutations

import pytest

from presswork.llm import audit
from presswork.llm.queries import REGISTRY

from .conftest import odd_texts


def by_running(docs, filters):
    """(part, order, step) -> counts, by applying the filters to (part, failed filters, good, bad)."""
    found, removed_by = {}, {}
    for part in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == part]
        for order in permutations(filters):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                found[part, "".join(order), step] = [
                    len(left), len(out), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in out), sum(d[3] for d in out),
                ]
                gone += out
                removed_by[part, f] = removed_by.get((part, f), 0) + len(out)
    for (part, order, step), row in found.items():
        row.append(removed_by[part, order[step - 1]])
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_any_number_of_filters(spark, n):
    rng = random.Random(n)
    names = list("WXYZ")[:n]
    docs = [(rng.choice(["p", "q", ""]), {f for f in names if rng.random() < 0.4}, rng.randint(0, 1), rng.randint(0, 1)) for _ in range(300)]
    rows = spark.createDataFrame(
        [(p, sum(1 << k for k, f in enumerate(names) if f in fails), g or None, b) for p, fails, g, b in docs], "part string, mask int, good int, bad int"
    )
    got = audit.audit(rows, names, "part", "mask", {"good": "good_lost", "bad": "bad_lost"}).collect()
    want = by_running(docs, names)
    assert len(got) == len(want) == len({d[0] for d in docs}) * math.factorial(n) * n
    for r in got:
        assert [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["bad_lost"], r["shapley"]] == want[r["part"], r["filter_order"], r["step"]]


def test_shapley_values_share_out_what_all_filters_remove(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([("p", rng.randrange(32)) for _ in range(500)], "part string, mask int")
    got = audit.audit(rows, list("ABCDE"), "part", "mask", {}).filter("filter_order = 'ABCDE'").collect()
    assert sum(r["shapley"] for r in got) == 120 * sum(r["removed"] for r in got)


def test_number_of_filters_is_checked(spark):
    rows = spark.createDataFrame([("p", 0)], "part string, mask int")
    for names in ([], list("ABCDEFG")):
        with pytest.raises(ValueError):
            audit.audit(rows, names, "part", "mask", {})


def query_rows(texts, langs, labels):
    """What the five filters of the query find, in plain Python; texts are (id, text)."""
    first = {}
    for i, t in texts:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for (i, t), lang in zip(texts, langs):
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        good, bad = labels.get(i, (0, 0))
        docs.append((lang or "", fails, good == 1, bad == 1))
    return by_running(docs, "ABCDE")


def test_query(spark, odd, tmp_path):
    rng = random.Random(4)
    texts = [(i, t) for i, t, _ in odd_texts()]
    texts += [(200, "A lot # of\vsigns"), (201, "ÀÉ %" * 40), (202, "a " * 120), (202, "a " * 120), (203, None), (None, None)]
    langs = [rng.choice(["en", "fr", "", None]) for _ in texts]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _ in texts if i is not None and rng.random() < 0.7}
    rows = [(i, t, lang, "hot") for (i, t), lang in zip(texts, langs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, g, b) for i, (g, b) in labels.items()] + [(None, 1, 1), (200, None, None), (999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = REGISTRY["op11_filter_audit"](spark, str(tmp_path)).collect()
    want = query_rows(texts, langs, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want
    assert len(got) == len(want)


def test_query_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert REGISTRY["op11_filter_audit"](spark, str(tmp_path)).count() == 0
