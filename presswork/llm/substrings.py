"""Substring de-duplication with a count-min prefilter.

A window is ``LENGTH`` consecutive words of a document.  A word goes if one of the windows
over it also starts in a document with a smaller id; windows are judged on the input.

1.  Each task counts window fingerprints in a count-min sketch, one count per document; the
    sketches are merged block by block.  What is counted for a window is its smallest
    ``GRAM``-word run, which neighbouring windows mostly share: equal windows have equal
    runs, so the estimate never falls below the window's own count, with a fraction of the
    insertions.
2.  Only windows estimated to be in two documents are grouped: by their hash and, as hashes
    of words may agree by chance, a cryptographic digest of their words (64 bits each).  They
    are sorted by both and id, and whatever follows the smallest id goes.
    Windows that the sketch holds for frequent in many tasks are dealt out by hash and salt;
    the smallest ids of their salts meet in a second, small grouping.
3.  Windows with a smaller id elsewhere go back to their documents, one array each.

The sketch has a fixed size (two rows of 2^27 one-bit answers and one of frequent slots,
48 MB), so it may be shared with every task.  Beyond some hundred million distinct
fingerprints it lets more windows through to the exact step, never fewer.  A group without
salt has no more rows than a few tasks hold, and is read as a stream.

Defined cases: null text has no words; documents without id neither lose words nor make
others lose any; rows with one id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import written

from . import words as W

LENGTH, GRAM = 13, 8
#: Slots in one row of the sketch, and slots in one block of it, as powers of two.
SLOTS_LOG2, BLOCK_LOG2, ROWS = 27, 16, 2
#: Fingerprints that a task gathers before it hands on what it has, and the most that it
#: counts for one slot; slots with ``FREQUENT`` or more in all are salted.
FLUSH, MOST, FREQUENT, SALTS = 2_000_000, 8, 32, 64

_U = np.uint64


def _fingerprints(w: W.Words, length: int, gram: int) -> np.ndarray:
    return W.sliding_min(W.runs(w, gram), length - gram + 1)


def _digests(w: W.Words, at: np.ndarray, length: int) -> np.ndarray:
    """A digest of the ``length`` words from each of these words on."""
    plain, starts, ends = w.plain
    raw = b"".join(blake2b(plain[a:b], digest_size=8).digest() for a, b in zip(starts[at].tolist(), ends[at + length - 1].tolist()))
    return np.frombuffer(raw, np.int64)


def _owners(w: W.Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.counts)), w.counts)


def _slot(fp: np.ndarray, row: int, slots: int) -> np.ndarray:
    return (fp >> _U(32 * row)) & _U((1 << slots) - 1) if slots <= 32 else W.mix(fp + _U(row)) & _U((1 << slots) - 1)


def sketch(texts: DataFrame, length: int, gram: int, slots: int = SLOTS_LOG2) -> np.ndarray:
    """For each row of the sketch a bitmap of the slots counted twice or more; last, of frequent ones."""
    block_bits = min(BLOCK_LOG2, slots)
    size = 1 << block_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held)
            blocks, payloads = [], []
            for row in range(ROWS):
                slot, times = np.unique(_slot(fps, row, slots), return_counts=True)
                slot = np.repeat(slot, np.minimum(times, MOST)).astype(np.int64)
                at = np.searchsorted(slot, np.arange(0, (1 << slots) + 1, size))
                low = (slot & (size - 1)).astype(np.uint16)
                for b in np.flatnonzero(np.diff(at)):
                    blocks.append((row << 32) + int(b))
                    payloads.append(low[at[b] : at[b + 1]].tobytes())
            for k in range(0, len(blocks), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(blocks[k : k + 2000], pa.int64()), pa.array(payloads[k : k + 2000], pa.binary())], ["block", "slots"])

        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.NON_SPACE)
            ok = W.whole(w, length)
            fp, owner = _fingerprints(w, length, gram)[ok], _owners(w)[ok]
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)  # neighbours mostly share theirs
            new[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
            fp, owner = fp[new], owner[new]
            order = np.lexsort((fp, owner))
            fp, owner = fp[order], owner[order]
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
            held.append(fp[new])
            total += int(new.sum())
            if total >= FLUSH:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("slots")):
                have = counts.setdefault(block, np.zeros(size, np.uint8))
                more = np.bincount(np.frombuffer(payload.as_buffer(), np.uint16), minlength=size)
                np.minimum(have + more, 255, out=have, casting="unsafe")
        keys = list(counts)
        if keys:
            for least, row in ((2, None), (FREQUENT, ROWS)):
                of = [k for k in keys if row is None or k >> 32 == 0]
                bits = [np.packbits(counts[k] >= least, bitorder="little").tobytes() for k in of]
                of = [k if row is None else (row << 32) + k for k in of]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(bits, pa.binary())], ["block", "slots"])

    schema = "block long, slots binary"
    merged = texts.mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema)
    bitmap = np.zeros((ROWS + 1, 1 << (slots - 3)), np.uint8)
    for r in merged.toLocalIterator():
        row, b = r["block"] >> 32, r["block"] & 0xFFFFFFFF
        bitmap[row, b * size // 8 : (b + 1) * size // 8] = np.frombuffer(r["slots"], np.uint8)
    return bitmap


def find_repeats(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, slots: int) -> DataFrame:
    """(id, hash, more) of windows that also start in a document with a smaller id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull()
    )
    shared = docs.sparkSession.sparkContext.broadcast(sketch(rows.select("text"), length, gram, slots))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        marked = lambda row, slot: (bitmap[row][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.NON_SPACE)
            ok = W.whole(w, length)
            fp = _fingerprints(w, length, gram)
            for row in range(ROWS):
                ok &= marked(row, _slot(fp, row, slots).astype(np.int64))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h, owner = W.runs(w, length)[at], _owners(w)[at]
            order = np.lexsort((h, owner))
            h, owner, fp = h[order], owner[order], fp[at][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner, fp = h[new], owner[new], fp[new]
            more = _digests(w, at[order][new], length)
            salt = np.where(marked(ROWS, _slot(fp, 0, slots).astype(np.int64)), b.column("salt").to_numpy()[owner], 0)
            ids = b.column("id").take(pa.array(owner))
            for k in range(0, len(h), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(k, 100_000), pa.array(h[part].view(np.int64)), pa.array(more[part]), pa.array(salt[part], pa.int8())],
                    ["id", "hash", "more", "salt"],
                )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by window, salt and id: those after the smallest id, and salted smallest ones."""
        last, first = None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h, more, salt = (b.column(c).to_numpy() for c in ("hash", "more", "salt"))
            ids = b.column("id").to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1]) | (salt[1:] != salt[:-1])
            new[0] = (h[0], more[0], salt[0]) != last
            of = np.cumsum(new)
            firsts = ids[np.concatenate([[0], np.flatnonzero(new)])]
            if not new[0]:
                firsts[0] = first
            gone = ids != firsts[of]
            last, first = (h[-1], more[-1], salt[-1]), firsts[of[-1]]
            at = np.flatnonzero(gone | (new & (salt > 0)))
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in ("id", "hash", "more")), pa.array(~gone[at])], ["id", "hash", "more", "lead"]
                )

    own = T.StructField("id", docs.schema[id_col].dataType)
    window = [T.StructField("hash", T.LongType()), T.StructField("more", T.LongType())]
    salted = rows.withColumn("salt", (F.pmod(F.xxhash64("id"), F.lit(SALTS)) + 1).cast("byte"))
    picked = salted.mapInArrow(pick, T.StructType([own, *window, T.StructField("salt", T.ByteType())]))
    dealt = picked.repartition("hash", "more", "salt").sortWithinPartitions("hash", "more", "salt", "id")
    found = written(dealt.mapInArrow(follow, T.StructType([own, *window, T.StructField("lead", T.BooleanType())])), "repeats")
    leads = found.filter("lead").drop("lead")
    firsts = leads.groupBy("hash", "more").agg(F.min("id").alias("first"))
    later = leads.join(firsts, ["hash", "more"]).filter("id > first")
    return found.filter("not lead").select("id", "hash", "more").unionAll(later.select("id", "hash", "more"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    slots: int = SLOTS_LOG2,
) -> DataFrame:
    """One row per document: (id, n_words, n_removed, kept_text), kept words joined by blanks."""
    repeats = find_repeats(docs, id_col, text_col, length, gram, slots)
    gone = repeats.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("hash", "more")).alias("windows"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(gone, F.col("id") == F.col("_id"), "left").select("id", "text", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.NON_SPACE)
            n = len(w.starts)
            lists = b.column("windows")
            at = np.flatnonzero(W.whole(w, length))
            gone = np.zeros(n + 1, np.int64)
            if lists.null_count < len(lists) and len(at):
                h, owner = W.runs(w, length)[at], _owners(w)[at]
                first, last = np.searchsorted(owner, np.arange(len(lists))), np.searchsorted(owner, np.arange(len(lists)), "right")
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                    bad, digests = (lists[int(i)].values.field(c).to_numpy(zero_copy_only=False) for c in ("hash", "more"))
                    s = at[first[i] : last[i]][np.isin(h[first[i] : last[i]], bad.view(_U))]
                    s = s[np.isin(_digests(w, s, length), digests)]  # the words decide
                    gone[s] += 1
                    gone[s + length] -= 1
            removed = np.cumsum(gone)[:n] > 0
            lost = np.concatenate([[0], np.cumsum(removed)])
            texts = _kept(w, ~removed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(w.counts, pa.int64()), pa.array(lost[w.offsets[1:]] - lost[w.offsets[:-1]], pa.int64()), texts],
                ["id", "n_words", "n_removed", "kept_text"],
            )

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    )
    return rows.mapInArrow(run, schema)


def _kept(w: W.Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words joined by single blanks."""
    data = w.data.copy()
    out = np.zeros(len(data), bool)
    out[W.NON_SPACE[data]] = np.repeat(kept, w.ends - w.starts)
    # A blank goes where a kept word ends, unless it is the last one of its text.
    at, owner = np.flatnonzero(kept), _owners(w)[kept]
    follows = np.zeros(len(at), bool)
    follows[:-1] = owner[1:] == owner[:-1]
    blanks = w.ends[at[follows]]
    data[blanks] = 32
    out[blanks] = True
    sizes = np.zeros(len(w.counts), np.int64)
    np.add.at(sizes, owner, w.ends[at] - w.starts[at] + follows)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[out]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())
