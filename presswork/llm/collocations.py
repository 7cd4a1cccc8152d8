"""Phrases whose words keep company, from count streams in prefix and suffix order.

1.  Counting, one order of phrases after the other.  A phrase of ``n`` words can be frequent
    only if its first and its last ``n - 1`` words are, so from two words on a text hands on
    nothing but phrases whose both parts are marked in a bitmap of the frequent shorter
    ones.  Counts are summed per batch, per task, and at last by phrase; the bitmap lets
    some infrequent phrases through and never holds back a frequent one.
2.  Suffix order.  All frequent phrases, sorted by their words read backwards, are one
    stream in which a phrase comes right after its own endings.  A walk in lockstep with the
    open endings, at most as many as a phrase has words, gives each phrase the counts of
    all its endings and the most frequent extension to the left.
3.  Prefix order.  The stream is sorted by its words read forwards, and the same walk gives
    the counts of all beginnings and the most frequent extension to the right.

Streams are cut into ranges of their order, so a common first word may span many tasks: a
beginning that is still open where a range starts is sent there as well, once per range.
Nothing is looked up by hash, and no task holds more than the open phrases.

What every task gets is the bitmap: 16 bits for each frequent phrase, at most ``2**30`` bits
(128 MB); a fuller one only lets more phrases through to the exact counts.

Defined cases: null text is empty and has no words; a null language counts as ``und``;
ids are not looked at, so repeated rows count as often as they are there; a language without
candidates, and an empty table, give no rows.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import written

from . import words as W

MOST_WORDS, LEAST, UNKNOWN = 5, 100, "und"
#: Phrases in one range of a stream, most ranges, and sampled phrases per range.
ROWS_PER_RANGE, MOST_RANGES, SAMPLES = 50_000, 4096, 20
#: Parts of a language's phrases that are listed by themselves before the list of all.
PARTS = 32
#: Bits of the bitmap per frequent phrase, its least and greatest size, and one block of it.
BITS_EACH, LEAST_LOG2, MOST_LOG2, BLOCK_LOG2 = 16, 16, 30, 16

_U = np.uint64
_breaks = np.zeros(256, bool)
_breaks[[10, 11, 12, 13, *b".,;:!?"]] = True
_inside = ~_breaks
_inside[[9, 32]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


# -------------------------------------------------------------------------------- counting


class Pieces:
    """Words of a run of texts, lower-cased and each followed by one blank, and what links them."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        w = W.split(texts, _inside, lower=True)
        n = len(w.starts)
        size = w.ends - w.starts
        letters = _lower[w.data[_inside[w.data]]]
        self.data = np.full(len(letters) + n, 32, np.uint8)
        self.data[np.arange(len(letters)) + np.repeat(np.arange(n), size)] = letters
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        owner = np.repeat(np.arange(len(w.counts)), w.counts)
        piece = np.cumsum(_breaks[w.data])[w.starts] if n else np.zeros(0, np.int64)
        #: Whether the next word belongs to the same piece.
        self.linked = np.zeros(n, bool)
        self.linked[:-1] = (owner[1:] == owner[:-1]) & (piece[1:] == piece[:-1])
        names = langs.dictionary_encode()
        self.names, self.lang = names.dictionary, names.indices.to_numpy()[owner]
        seeds = np.array([zlib.crc32(x.encode()) for x in self.names.to_pylist()], _U)
        self.seed = seeds[self.lang] if n else np.zeros(0, _U)

    def grams(self, n: int) -> np.ndarray:
        """A hash of the ``n`` words from each word on and their language.

        A word goes in by its length and its first and last eight bytes, which cost one look
        each; what that confuses only lets more phrases through the bitmap.
        """
        eight = np.ndarray(len(self.data), _U, self.data.tobytes() + bytes(7), 0, (1,))
        size = self.ends - self.starts
        first = eight[self.starts] << (8 * np.maximum(8 - size, 0)).astype(_U)
        last = np.where(size > 8, eight[np.maximum(self.ends - 8, 0)], _U(0))
        words = W.mix(first * _U(0x9E3779B97F4A7C15) + W.mix(last + size.astype(_U)))
        return W.mix(_run_hashes(words, n) + self.seed)

    def whole(self, n: int) -> np.ndarray:
        """Which words begin ``n`` words of one piece."""
        ok = np.ones(len(self.linked), bool)
        for k in range(n - 1):
            ok[: len(ok) - k] &= self.linked[k:]
            ok[len(ok) - k :] = False
        return ok

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases of ``n`` words that begin at these words."""
        first, size = self.starts[at], self.ends[at + n - 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        letters = self.data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        phrases = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
        phrases = phrases.dictionary_encode()
        many = max(1, len(phrases.dictionary))
        keys, times = np.unique(self.lang[at].astype(np.int64) * many + phrases.indices.to_numpy(), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [self.names.take(pa.array(keys // many)), phrases.dictionary.take(pa.array(keys % many)).cast(pa.string()), pa.array(times.astype(np.int64))],
            ["lang", "phrase", "n"],
        )


def _run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(hashes), _U)
    for k in range(n):
        out *= _U(0x2545F4914F6CDD1D)
        out[: len(out) - k] += hashes[k:]
    return out


def count_phrases(texts: DataFrame, n: int, marked: Bitmap | None) -> DataFrame:
    """(lang, phrase, n): occurrences of all phrases of ``n`` words that ``marked`` lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            p = Pieces(b.column("text"), b.column("lang"))
            ok = p.whole(n)
            if shared.value is not None and len(ok):
                known = shared.value.holds(p.grams(n - 1))
                ok[:-1] &= known[:-1] & known[1:]
                ok[-1] = False
            at = np.flatnonzero(ok)
            if len(at):
                yield p.counted(at, n)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


class Bitmap:
    """Slots of hashed phrases."""

    def __init__(self, log2: int):
        self.log2, self.bits = log2, np.zeros(1 << (log2 - 3), np.uint8)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.log2)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots(hashes)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def mark(frequent: DataFrame, n: int) -> Bitmap:
    """The bitmap of a table of phrases of ``n`` words, merged block by block."""
    log2 = min(MOST_LOG2, max(LEAST_LOG2, math.ceil(math.log2(BITS_EACH * frequent.count() + 1))))
    out, size = Bitmap(log2), 1 << BLOCK_LOG2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = Pieces(b.column("phrase"), b.column("lang"))
            slot = np.unique(out.slots(p.grams(n)[::n]))
            at = np.searchsorted(slot, np.arange(0, (1 << log2) + 1, size))
            of = np.flatnonzero(np.diff(at))
            low = (slot & (size - 1)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), pa.array([low[at[k] : at[k + 1]].tobytes() for k in of], pa.binary())], ["block", "slots"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("slots")):
                blocks.setdefault(block, np.zeros(size, bool))[np.frombuffer(payload.as_buffer(), np.uint16)] = True
        for block, bits in blocks.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "slots"]
            )

    schema = "block long, slots binary"
    for r in frequent.select("lang", "phrase").mapInArrow(deal, schema).repartition("block").mapInArrow(merge, schema).toLocalIterator():
        out.bits[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["slots"], np.uint8)
    return out


# --------------------------------------------------------------------------------- streams

Key = tuple[str, list[str]]


def _bounds(stream: DataFrame, rows: int) -> list[Key]:
    """Keys that cut a stream into ranges of about equal size, from a sample of bounded size."""
    ranges = min(MOST_RANGES, math.ceil(rows / ROWS_PER_RANGE))
    if ranges <= 1:
        return []
    target = ranges * SAMPLES
    sample = stream.select("lang", "key").sample(min(1.0, target / rows), seed=17).limit(2 * target).collect()
    points = sorted((r["lang"], list(r["key"])) for r in sample)
    points = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
    step = max(1, len(points) // ranges)
    return points[step::step]


def in_order(stream: DataFrame, bounds: list[Key]) -> DataFrame:
    """The stream in ranges of (lang, key), sorted, with the beginnings open at a range's start.

    Such copies have ``home`` false.
    """
    open_: dict[tuple[str, tuple[str, ...]], list[int]] = {}
    for k, (lang, key) in enumerate(bounds):
        for n in range(1, len(key)):
            open_.setdefault((lang, tuple(key[:n])), []).append(k + 1)
    names, home = stream.columns, stream.columns.index("home")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column("lang").to_pylist(), b.column("key").to_pylist()))
            extra = [(i, to) for i, (lang, key) in enumerate(keys) for to in open_.get((lang, tuple(key)), ())]
            at = [*range(len(keys)), *(i for i, _ in extra)]
            to = [*(bisect_right(bounds, k) for k in keys), *(k for _, k in extra)]
            t = b.take(pa.array(at, pa.int64())) if extra else b
            columns = list(t.columns)
            columns[home] = pa.array([*b.column("home").to_pylist(), *[False] * len(extra)])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(to, pa.int32())], [*names, "to"])

    if bounds:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", to int"
        stream = stream.mapInArrow(deal, schema).repartitionById(len(bounds) + 1, "to").drop("to")
    else:
        stream = stream.coalesce(1)
    return stream.sortWithinPartitions("lang", "key")


def walk(batches: Iterator[pa.RecordBatch], done: Callable[[dict], None]) -> Iterator[None]:
    """Give ``done`` each phrase of a sorted stream once its extensions have gone by.

    ``parts`` has the counts of its beginnings, shortest first; ``ext`` the greatest count
    of phrases one word longer that begin with it.  Rows of one key are merged.
    """
    stack: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            key, lang = row["key"], row["lang"]
            while stack and not (stack[-1]["lang"] == lang and stack[-1]["key"] == key[: len(stack[-1]["key"])]):
                done(stack.pop())
            if stack and len(stack[-1]["key"]) == len(key):
                top = stack[-1]
                top["side"] = max(top["side"], row["side"])
                if row["home"]:
                    top["home"], top["tails"] = True, row["tails"]
                continue
            if stack:
                stack[-1]["ext"] = max(stack[-1]["ext"], row["f"])
            stack.append(row | {"parts": [x["f"] for x in stack], "ext": 0})
        yield
    while stack:
        done(stack.pop())
    yield


def extend(stream: DataFrame, rows: int) -> DataFrame:
    """(lang, key, f, home, tails, side, parts, ext) of every phrase of a stream in key order."""
    schema = "lang string, key array<string>, f long, home boolean, tails array<long>, side long, parts array<long>, ext long"
    types = pa.schema([("lang", pa.string()), ("key", pa.list_(pa.string())), ("f", pa.int64()), ("home", pa.bool_()),
                       ("tails", pa.list_(pa.int64())), ("side", pa.int64()), ("parts", pa.list_(pa.int64())), ("ext", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _ in walk(batches, out.append):
            kept = [r for r in out if r["home"] or r["ext"]]  # copies only tell what extends them
            out.clear()
            if kept:
                yield pa.RecordBatch.from_pylist(kept, types)

    return in_order(stream, _bounds(stream, rows)).mapInArrow(run, schema)


def phrase_statistics(frequent: DataFrame) -> DataFrame:
    """(lang, words, a, beginnings, endings, longer) of a table of all frequent phrases.

    ``beginnings`` and ``endings`` have the counts of the first and last words, shortest
    first; ``longer`` is the greatest count of a phrase one word longer around it.
    """
    rows = frequent.count()
    none = F.array().cast("array<long>")
    suffix = frequent.select(
        "lang", F.reverse(F.split("phrase", " ")).alias("key"), "f", F.lit(True).alias("home"), none.alias("tails"), F.lit(0).cast("long").alias("side")
    )
    backwards = written(extend(suffix, rows), "suffix-order")
    prefix = backwards.select("lang", F.reverse("key").alias("key"), "f", "home", F.col("parts").alias("tails"), F.col("ext").alias("side"))
    found = written(extend(prefix, rows), "prefix-order")
    # A beginning open at the start of a range has its other extensions there.
    late = found.filter("not home").groupBy("lang", "key").agg(F.max("ext").alias("late"))
    longer = F.greatest("side", "ext", F.coalesce("late", F.lit(0)))
    return found.filter("home").join(late, ["lang", "key"], "left").select(
        "lang", F.col("key").alias("words"), F.col("f").alias("a"), F.col("parts").alias("beginnings"), F.col("tails").alias("endings"), longer.alias("longer")
    )


# ---------------------------------------------------------------------------------- phrases


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases with ``least`` occurrences, and (lang, n) words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    counts = written(count_phrases(texts, 1, None), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    found = [counts.filter(F.col("f") >= least)]
    for n in range(2, most_words + 1):
        more = count_phrases(texts, n, mark(found[-1], n - 1)).filter(F.col("f") >= least)
        found.append(written(more, f"phrases-{n}"))
        if found[-1].isEmpty():
            break
    frequent = found[0]
    for more in found[1:]:
        frequent = frequent.unionAll(more)
    return frequent, totals


def _lowest_cut(a: Column, n: Column, beginnings: Column, endings: Column) -> Column:
    """(score, k, l, r) of the lowest-scoring cut; products have up to 38 digits."""
    whole = lambda c: c.cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        left, right = F.get(beginnings, k - 1), F.get(endings, F.size(endings) - k)
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(17,0)") * n.cast("decimal(17,0)"), whole(left.cast("decimal(18,0)") * right.cast("decimal(18,0)")))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(beginnings)), cut))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST,
    covered: int = 100, top: int | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of two words and more.

    Phrases are dropped where a longer one has ``covered`` percent of their occurrences.
    ``top`` limits each language's list.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, most_words, least)
    rows = phrase_statistics(frequent).filter(F.size("words") > 1).filter(100 * F.col("longer") < covered * F.col("a"))
    rows = rows.join(totals, "lang").withColumn("cut", _lowest_cut(F.col("a"), F.col("n"), F.col("beginnings"), F.col("endings")))
    rows = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # a language's phrases are listed in parts first, so that its list is made of bounded ones
        part = Window.partitionBy("lang", "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_rank", F.row_number().over(part))
        rows = rows.filter(F.col("_rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        rows = rows.filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
