"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: compatibility forms, upper case, zero-width and combining marks,
look-alike letters of other scripts, signs put for letters, and digits put for letters where
a word has letters as well (a plain number stays a number).  The folded words,
joined by single blanks, are read once by an automaton of all lexicon entries and exception
phrases; an entry inside an exception phrase does not count.  The sum of the weights,
normalised by length, goes through a logistic function.

The lexicon is learned: words whose share among toxic texts is significantly above their
share among clean ones, weighted by the log ratio.  A word beginning (``bad*``) is an entry only
if ``CARRIERS`` different words that toxic texts use more begin with it and no clean text's word
does more often; it is weighed by the words that are no entries themselves.  Exception phrases
are pairs of words around an entry that clean texts use.  At most ``max_rows`` labelled
documents are used, half of them for the lexicon and half for the calibration, in which each
row counts for all labelled documents of its kind that it stands for; only word counts and
features of these reach the driver, at most ``max_terms`` words.

Defined cases: null and empty texts have no matches; labels that are null are not used;
several labels of one id count as their largest; without labels of both kinds, or with an
empty lexicon, every score is 0, as it is where one label is missing in the half for the
calibration.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import written

from .fitting import labelled_rows, logistic_fit

MAX_ROWS, MAX_BYTES = 20_000, 160 << 20
MAX_TERMS = 5_000
#: Texts that must have a word, and its log-likelihood ratio against chance, for the lexicon.
MIN_TEXTS, MIN_RATIO = 3, 15.0
#: Lengths of word beginnings that may be entries, and the different words that must have one.
STEMS, CARRIERS = range(4, 9), 3
#: Words whose folded form a worker keeps, and the longest of them.
KEPT_WORDS, LONGEST_KEPT = 300_000, 40

# Look-alikes of the letters a to z, and signs written for letters.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "ьв", "c": "сϲ", "d": "ԁ", "e": "еєεё", "g": "ɡ", "h": "һн", "i": "іιıїlӏ", "j": "јϳ",
    "k": "кκ", "m": "м", "n": "ηп", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ",
    "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

_FOLD = {ord(c): k for k, v in LOOK_ALIKES.items() for c in v}
_FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")
_MARK = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
_LONG_RUN = re.compile(r"(\w)\1{2,}")


_DIGIT = str.maketrans(DIGITS)
_kept: dict[str, str] = {}


def _fold_word(word: str) -> str:
    """The folded words in a stretch without white space, joined by blanks."""
    if not word.isascii():
        word = _MARK.sub("", unicodedata.normalize("NFKC", word)).lower().translate(_FOLD)
    else:
        word = word.lower()
    found = _WORD.findall(_LONG_RUN.sub(r"\1", _SIGN.sub(lambda m: SIGNS[m[0]], word)))
    # digits stand for letters only beside letters; what that makes threefold is shortened as well
    return " ".join(w if w.isdigit() or w.isalpha() else _LONG_RUN.sub(r"\1", w.translate(_DIGIT)) for w in found)


def fold(text: str) -> str:
    """Folded words, with a blank before and after each."""
    out = []
    for word in text.split():
        folded = _kept.get(word)
        if folded is None:
            folded = _fold_word(word)
            if len(word) <= LONGEST_KEPT:
                if len(_kept) >= KEPT_WORDS:
                    _kept.clear()
                _kept[word] = folded
        if folded:
            out.append(folded)
    return f" {' '.join(out)} " if out else ""


@dataclass
class Model:
    """Weights of entries, exception phrases, and the calibration."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] | None = None

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.terms:
            return None
        a = ahocorasick.Automaton()
        for word, weight in self.terms.items():
            a.add_word(f" {word[:-1]}" if word.endswith("*") else f" {word} ", (word, weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (phrase, None))
        a.make_automaton()
        return a


def matches(automaton: ahocorasick.Automaton | None, folded: str) -> list[tuple[str, float]]:
    """Entries found outside of exception phrases, the heaviest one of each word."""
    if automaton is None or not folded:
        return []
    found: dict[int, tuple[str, float]] = {}
    spared: set[int] = set()
    for end, (word, weight) in automaton.iter(folded):
        start = end - len(word) + (1 if word.endswith("*") else -1)
        if weight is None:
            spared |= {start} | {start + 1 + k for k, c in enumerate(word) if c == " "}
        elif start not in found or found[start][1] < weight:
            found[start] = (word, weight)
    return [x for at, x in sorted(found.items()) if at not in spared]


def features(found: list[tuple[str, float]], n_words: int) -> list[float]:
    total = sum(x for _, x in found)
    distinct = {w: x for w, x in found}
    return [
        math.log1p(total), total / math.sqrt(n_words + 10.0), 10 * total / (n_words + 20.0),
        math.log1p(sum(distinct.values())), max(distinct.values(), default=0.0), math.log(n_words + 10.0) * bool(found),
    ]


def _beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def _pairs(folded: str, terms: dict[str, float]) -> set[str]:
    words = folded.split()
    near = {i for i, w in enumerate(words) if w in terms or any(w[:k] + "*" in terms for k in STEMS if len(w) > k)}
    return {f"{words[i]} {words[i + 1]}" for k in near for i in (k - 1, k) if 0 <= i < len(words) - 1}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    use: Column | None = None,
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
    max_terms: int = MAX_TERMS,
    exceptions: tuple[str, ...] = (),
) -> Model:
    """Lexicon, exception phrases and calibration; ``exceptions`` adds phrases of one's own."""
    rows = labelled_rows(docs, labels, id_col, text_col, label_col, use, max_rows, max_bytes).select(
        F.col("_text").alias("text"), F.col("_y").alias("y"), F.col("_weight").alias("weight"), (F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0).alias("learn")
    )
    rows = written(rows, "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in rows.filter("learn").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Model()

    def counted(what) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = b.column("y").to_pylist()
                out = [(w, k) for t, k in zip(b.column("text"), y) for w in what(fold(t.as_py() or ""))]
                for k in range(0, len(out), 50_000):
                    w, of = zip(*out[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(of, pa.int32())], ["term", "y"])

        made = rows.filter("learn").select("text", "y").mapInArrow(run, "term string, y int")  # each text's terms once
        toxic = F.sum((F.col("y") == 1).cast("int"))
        clean = F.sum((F.col("y") == 0).cast("int"))
        return made.groupBy("term").agg(toxic.alias("a"), clean.alias("b")).withColumn(
            "w", F.log((F.col("a") + 0.5) / (sizes[1] + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
        )

    n1, n0, n, k = sizes[1], sizes[0], sizes[1] + sizes[0], F.col("a") + F.col("b")
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    ratio = 2 * (
        part(F.col("a"), k * n1 / n) + part(F.col("b"), k * n0 / n) + part(n1 - F.col("a"), (n - k) * n1 / n) + part(n0 - F.col("b"), (n - k) * n0 / n)
    )
    told = (F.col("a") >= MIN_TEXTS) & (F.col("w") > 0) & (ratio >= MIN_RATIO)
    words = written(counted(lambda t: set(t.split())), "toxicity-words")
    best = words.filter(told).orderBy(ratio.desc(), "term").limit(max_terms).collect()
    model = Model({r["term"]: r["w"] for r in best})
    if not model.terms:
        return model
    # beginnings that several words share which toxic texts use more, and that no clean word has more often
    begins = F.filter(F.transform(F.array(*[F.lit(k) for k in STEMS]), lambda k: F.when(F.length("term") > k, F.concat(F.left(F.col("term"), k), F.lit("*")))), lambda x: x.isNotNull())
    shared = words.select("a", "b", "w", F.explode(begins).alias("begin")).groupBy("begin").agg(
        F.count_if((F.col("a") >= MIN_TEXTS) & (F.col("w") > 0)).alias("carriers"), F.max("a").alias("most"), F.max("b").alias("clean")
    )
    shared = shared.filter((F.col("carriers") >= CARRIERS) & (F.col("clean") <= F.col("most"))).orderBy(F.desc("carriers"), "begin").limit(max_terms)
    allowed, whole = {r["begin"] for r in shared.select("begin").collect()}, set(model.terms)
    if allowed:
        unexplained = counted(lambda t: {s for w in set(t.split()) - whole for s in _beginnings(w) if s in allowed})
        model.terms |= {r["term"]: r["w"] for r in unexplained.filter(told).orderBy(ratio.desc(), "term").limit(max_terms - len(model.terms)).collect()}
    terms = model.terms
    spared = counted(lambda t: _pairs(t, terms)).filter((F.col("b") >= MIN_TEXTS) & (F.col("w") < 0)).orderBy("w", "term").limit(max_terms)
    model.exceptions = [r["term"] for r in spared.collect()] + [fold(x).strip() for x in exceptions if fold(x)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            folded = [fold(t.as_py() or "") for t in b.column("text")]
            x = [features(matches(automaton, t), t.count(" ") - 1 if t else 0) for t in folded]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("weight"), pa.array(x, pa.list_(pa.float64()))], ["y", "weight", "x"])

    got = rows.filter("not learn").select("y", "weight", "text").mapInArrow(measure, "y int, weight double, x array<double>").toPandas()
    y = got["y"].to_numpy(float)
    if len(got) and 0 < y.sum() < len(y):
        order = np.lexsort(np.vstack([np.stack(got["x"]).T, y]))  # the same sums whatever the order of rows
        model.weights = logistic_fit(np.stack(got["x"])[order], y[order], weight=got["weight"].to_numpy(float)[order])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with (score, terms), in place of columns of these names: the lexicon entries found, in order."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "terms")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, w = model.automaton(), model.weights
        for b in batches:
            scores, terms = [], []
            for t in b.column("_text_"):
                folded = fold(t.as_py() or "")
                found = matches(automaton, folded)
                s = 0.0
                if w:
                    z = sum(a * x for a, x in zip(w, features(found, folded.count(" ") - 1 if folded else 0))) + w[-1]
                    s = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))
                scores.append(s)
                terms.append([x for x, _ in found])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(terms, pa.list_(pa.string()))], [*b.schema.names[:-1], "score", "terms"]
            )

    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType()))]
    )
    return docs.select(*keep, F.col(text_col).alias("_text_")).mapInArrow(run, schema)
