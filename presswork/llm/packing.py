"""Best-fit packing of documents into sequences by linear grouping.

1.  Every document becomes token ids and an end mark; documents longer than a sequence are
    cut into pieces of its length.  Pieces are written once, numbered within their length:
    each task counts its own, and the counts of earlier tasks are added.
2.  The histogram of lengths, at most ``capacity`` numbers, is all that the driver gets.
    Large lengths, in descending order, are dealt into groups of equal cardinality and
    rounded up to the largest of their group.  For these few sizes configurations are
    optimised by column generation (a knapsack over the dual prices gives the next one);
    whole multiples of them are taken, and what is left over, a bounded number of pieces, is
    placed largest first.
3.  Actual lengths then take the places of the rounded ones, but for the shortest place of
    each configuration: rounding leaves too little room for any piece, so that place is
    left open.  All pieces that remain, large or small, then go longest first where they
    leave least room.  Sequences with the same room are handled together, so all of this
    works on counts: the plan is a list of segments "pieces from number ``lo`` on of this
    length go to the sequences from ``s`` on, at this offset".  Its size depends on the
    capacity and the number of groups, not on the number of pieces.
4.  A piece finds its segment by length and number, with one binary search.

Defined cases: null text is empty, and an empty text is a single end mark; rows that share
an id are packed one by one, null ids like others; an empty table has no pieces.  Lengths,
counts and the number of sequences are the same in every run; which of the pieces of one
length takes a place depends on the input's splits.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import written

from . import words as W

CAPACITY, END = 2048, 0
#: Lengths above this part of the capacity are large; groups of them.
SMALL_PART, GROUPS = 3, 64
#: Column generation ends when no configuration is better than this, or after so many.
GAIN, MOST_COLUMNS = 1e-4, 3000
#: Words whose ids a Python worker keeps, and the longest such word in bytes.
KEPT_WORDS, LONGEST_KEPT = 800_000, 64

_encoders: dict[int, tuple] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: ASCII letters, 2: signs that keep their word whole; second bytes of two-byte letters.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[39, 60]] = _KIND[128:] = 2
_LATIN = np.zeros(256, bool)
_LATIN[128:192] = True
_LATIN[[0x97, 0xB7]] = False
#: What the rules of a vocabulary have to hold so that parts of words can be encoded by themselves.
RULES = ['{"type": "NFC"}', '{"type": "Lowercase"}', json.dumps("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------------------ token ids


def _encoder(model: str) -> tuple:
    """The tokenizer, the ids of parts seen by this worker, and which ids end a word.

    The last is None for a vocabulary whose rules are others than ``RULES``.
    """
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(model)
        rules = json.dumps([parts["normalizer"], parts["pre_tokenizer"]])
        ends = None
        if all(r in rules for r in RULES):
            vocabulary, mark = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[k for word, k in vocabulary.items() if word.endswith(mark)]] = True
        _encoders[key] = (Tokenizer.from_str(model), {}, ends)
    return _encoders[key]


def _encode_parts(encoder, parts: list[str], word_ends: np.ndarray) -> dict[str, bytes]:
    """Little-endian ids of each part; those of plain letters, one word each, are encoded as one text."""
    plain = [x for x in parts if x.isascii() and x.isalpha()]
    ids = np.array(encoder.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
    ends = (4 * (np.flatnonzero(word_ends[ids]) + 1)).tolist()
    if len(ends) != len(plain):  # not one word each after all
        plain, ends = [], []
    raw = ids.tobytes()
    found = {x: raw[a:b] for x, a, b in zip(plain, [0, *ends], ends)}
    rest = [x for x in parts if x not in found]
    found.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(rest, encoder.encode_batch_fast(rest, add_special_tokens=False)))
    return found


def encode(model: str, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end``, and where each text begins.

    A vocabulary whose rules are ``RULES`` cuts a word where letters meet other signs, but for
    apostrophes, and knows no capitals, so equal parts have equal ids wherever they are:
    distinct parts are encoded once and their ids are put together.  Words with an
    apostrophe, a ``<`` (a special token may begin there) or characters beyond the Latin
    letters of one and two bytes stay whole.  Other vocabularies get whole texts.
    """
    encoder, known, word_ends = _encoder(model)
    if word_ends is None:
        ids = [np.array([*e.ids, end], "<u4") for e in encoder.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    w = W.split(texts, W.NON_SPACE)
    n_texts = len(w.counts)
    if not len(w.starts):
        return np.full(n_texts, end, "<u4"), np.arange(n_texts + 1)
    letters = w.data[W.NON_SPACE[w.data]]
    size = w.ends - w.starts
    first = np.cumsum(size) - size
    kind = _KIND[letters]
    latin = (letters[:-1] == 0xC3) & _LATIN[letters[1:]]  # two bytes, one letter
    kind[:-1][latin] = kind[1:][latin] = 1
    whole = np.maximum.reduceat(kind, first) == 2
    new = np.empty(len(letters), bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    low = _LOWER[letters]
    for s, n in zip(first[whole].tolist(), size[whole].tolist()):
        new[s : s + n], low[s : s + n] = False, letters[s : s + n]
    new[first] = True
    letters, starts = low, np.flatnonzero(new)
    owner = np.repeat(np.repeat(np.arange(n_texts), w.counts), np.add.reduceat(new, first, dtype=np.int64))
    ends = np.append(starts, len(letters)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    distinct, which = parts.dictionary.to_pylist(), parts.indices.to_numpy()
    if len(known) > KEPT_WORDS:
        known.clear()
    new = [x for x in distinct if x not in known]
    found = _encode_parts(encoder, new, word_ends)
    known.update((x, ids) for x, ids in found.items() if len(x) <= LONGEST_KEPT)
    ids = [known[x] if x in known else found[x] for x in distinct]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    sizes, starts = sizes[which], starts[which]
    before = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()) + n_texts, end, "<u4")
    steps = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    out[np.repeat(before + owner, sizes) + steps] = flat[np.repeat(starts, sizes) + steps]
    total = np.bincount(owner, weights=sizes, minlength=n_texts).astype(np.int64) + 1
    return out, np.concatenate([[0], np.cumsum(total)])


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, model: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, crc32, part, number[, ids]); numbers run within part and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in W.chunks(batches, "text"):
            ids, at = encode(model, b.column("text"), end)
            many = -(-np.diff(at) // capacity)
            owner = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            first = at[owner] + start
            length = np.minimum(at[owner + 1] - first, capacity)
            raw = [ids[f : f + n].tobytes() for f, n in zip(first.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=capacity + 1)
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            out = [
                b.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.full(len(length), part), pa.int32()), pa.array(number),
            ]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(raw, pa.binary())] if with_ids else []), names)

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "crc32")]
    fields += [T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    names = [f.name for f in fields]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


# ------------------------------------------------------------------------------------ plan


@dataclass
class Plan:
    """Segments as columns, sorted by length and first number, and how many sequences there are."""

    length: np.ndarray
    lo: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their lengths and numbers within these."""
        key = lambda a, b: (a.astype(np.uint64) << np.uint64(44)) | b.astype(np.uint64)
        k = np.searchsorted(key(self.length, self.lo), key(length, number), "right") - 1
        return self.sequence[k] + number - self.lo[k], self.offset[k]


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded length, pieces) of groups of equal cardinality, longest first."""
    lengths = sorted(counts, reverse=True)
    ends = np.cumsum([counts[x] for x in lengths])
    total = int(ends[-1])
    groups = min(groups, total)
    cuts = [total * g // groups for g in range(groups + 1)]
    return [(lengths[int(np.searchsorted(ends, a, "right"))], b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration, by an unbounded knapsack; sizes ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(int(sizes[0]), capacity + 1):
        got = best[c - sizes[: fits[c]]] + worth[: fits[c]]
        j = int(got.argmax())
        if got[j] > best[c - 1]:
            best[c], last[c] = got[j], j
        else:
            best[c] = best[c - 1]
    config, c = np.zeros(len(sizes)), capacity
    while c >= sizes[0]:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
        else:
            config[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), config


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and how often to use each, from the linear relaxation.

    ``sizes`` ascend and differ.  The basis has one configuration per size; in each round
    the configuration that the dual prices favour most enters it.
    """
    s, need = np.array(sizes), np.array(counts, float)
    basis = np.diag(np.floor(capacity / s))
    inverse = np.diag(1 / np.floor(capacity / s))
    for _ in range(MOST_COLUMNS):
        value, new = _best_configuration(s, inverse.sum(0), capacity)
        if value <= 1 + GAIN:
            break
        times, change = inverse @ need, inverse @ new
        ratio = np.where(change > 1e-9, times / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        inverse = np.linalg.inv(basis)
    times = np.maximum(inverse @ need, 0)
    return [(basis[:, j].astype(int).tolist(), float(times[j])) for j in range(len(s)) if times[j] > 1e-9]


def _whole_configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes, longest first, number of sequences) that take every piece of ``groups`` once."""
    left: dict[int, int] = {}
    for size, n in groups:
        left[size] = left.get(size, 0) + n
    sizes = sorted(left)
    found = []
    for config, times in configurations(sizes, [left[x] for x in sizes], capacity):
        times = min([int(times + 1e-6), *(left[x] // k for x, k in zip(sizes, config) if k)])
        if times:
            for x, k in zip(sizes, config):
                left[x] -= k * times
            found.append(([x for x, k in zip(reversed(sizes), reversed(config)) for _ in range(k)], times))
    bins: list[tuple[int, list[int]]] = []
    for size in reversed(sizes):  # what is left: fewer than one configuration per size
        for _ in range(left[size]):
            k = min((k for k in range(len(bins)) if bins[k][0] >= size), key=lambda k: bins[k][0], default=None)
            if k is None:
                bins.append((capacity - size, [size]))
            else:
                bins[k] = (bins[k][0] - size, [*bins[k][1], size])
    return found + [(b, 1) for _, b in bins]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> Plan:
    """Places for all pieces of a histogram of lengths."""
    segments: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # unused ids -> runs of sequences
    used = histogram.get(capacity, 0)
    if used:
        segments.append((capacity, 0, 0, 0))
    small = capacity // small_part
    rest = [(x, 0, n) for x, n in histogram.items() if x <= small and n]  # length, first number, pieces
    large = {x: n for x, n in histogram.items() if small < x < capacity and n}
    if large:
        lengths = sorted(large, reverse=True)
        first = dict(zip(lengths, np.cumsum([0, *(large[x] for x in lengths)]).tolist()))
        ends = np.cumsum([large[x] for x in lengths])
        grouped = linear_groups(large, groups)
        # Pieces of a rounded length are consecutive in the descending order.
        at: dict[int, int] = {}
        begin = 0
        for size, n in grouped:
            at.setdefault(size, begin)
            begin += n
        for config, times in _whole_configurations(grouped, capacity):
            done = 0
            ranks = []
            for size in config[: max(1, len(config) - 1)]:  # the shortest one is best-fit below
                ranks.append(at[size])
                at[size] += times
            while done < times:  # as far as no place changes its actual length
                actual = [lengths[int(np.searchsorted(ends, r + done, "right"))] for r in ranks]
                run = min([times - done, *(first[x] + large[x] - r - done for x, r in zip(actual, ranks))])
                offset = 0
                for x, r in zip(actual, ranks):
                    segments.append((x, r + done - first[x], used, offset))
                    offset += x
                room.setdefault(capacity - offset, []).append((used, run))
                used, done = used + run, done + run
        begin = 0
        for size, n in grouped:  # pieces without a place yet
            begin += n
            while at[size] < begin:
                r = at[size]
                x = lengths[int(np.searchsorted(ends, r, "right"))]
                rest.append((x, r - first[x], min(begin, first[x] + large[x]) - r))
                at[size] += rest[-1][2]
    for x, number, todo in sorted(rest, reverse=True):
        for free in range(x, capacity + 1):  # least room first
            if not todo:
                break
            runs = room.pop(free, [])
            if free == capacity:
                fresh = -(-todo // (capacity // x))
                runs, used = [*runs, (used, fresh)], used + fresh
            each = free // x
            for start, n in runs:
                full, more = min(n, todo // each), 0
                if full < n and todo < each * n:
                    more = todo % each
                for k in range(each if full else 0):
                    segments.append((x, number + k * full, start, capacity - free + k * x))
                number, todo = number + full * each, todo - full * each
                for k in range(more):
                    segments.append((x, number + k, start + full, capacity - free + k * x))
                number, todo = number + more, todo - more
                for left, begin, many in (
                    (free - each * x, start, full),
                    (free - more * x, start + full, min(more, 1)),
                    (free, start + full + min(more, 1), n - full - min(more, 1)),
                ):
                    if many:
                        room.setdefault(left, []).append((begin, many))
    columns = [np.array(c, np.int64) for c in zip(*sorted(segments))] if segments else [np.zeros(0, np.int64)] * 4
    return Plan(*columns, used)


# --------------------------------------------------------------------------------- placing


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY,
    end: int = END, groups: int = GROUPS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, piece, start, length, crc32, sequence, offset[, ids])."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        model = f.read()
    pieces = written(cut_pieces(docs, id_col, text_col, model, capacity, end, with_ids), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(histogram, capacity, groups)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("number") + F.col("base")).drop("part", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = found.place(b.column("length").to_numpy(), b.column("number").to_numpy())
            made = {"sequence": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in names], names)

    schema = T.StructType([f for f in pieces.schema if f.name not in ("part", "number", "ids")])
    schema.add("sequence", T.LongType()).add("offset", T.LongType())
    if with_ids:
        schema.add("ids", T.BinaryType())
    names = schema.fieldNames()
    return numbered.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence, ids, starts, doc_ids): the packed sequences of ``pack(..., with_ids=True)``.

    ``starts`` has where each piece begins, ``doc_ids`` the document that it is from; ids are
    little-endian 32-bit numbers.  A sequence is at most one capacity, so rows stay small.
    """
    kind = placed.schema["id"].dataType
    rows = placed.select("sequence", "offset", "id", "ids").repartition("sequence").sortWithinPartitions("sequence", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type)) for c in ("offset", "id")]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0].column("sequence")[0].as_py()], pa.int64()), pa.array([b"".join(t.column("ids").to_pylist())], pa.binary()), *lists],
                ["sequence", "ids", "starts", "doc_ids"],
            )

        for b in batches:
            of = b.column("sequence").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                if held and held[0].column("sequence")[0].as_py() != of[first]:
                    yield row()
                    held = []
                held.append(b.slice(first, last - first))
        if held:
            yield row()

    return rows.mapInArrow(
        run,
        T.StructType([T.StructField("sequence", T.LongType()), T.StructField("ids", T.BinaryType()),
                      T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("doc_ids", T.ArrayType(kind))]),
    )
