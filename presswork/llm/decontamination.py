"""Benchmark decontamination by winnowing.

The fingerprint of a run of words is the smallest hash of its ``GRAM``-word runs, so two
equal spans of ``SPAN`` words always have the same one.  Fingerprints of all benchmark
windows are marked in a bitmap of fixed size; document windows whose fingerprint is marked
are joined with the benchmark windows by their words, which leaves exact occurrences only.
Items of fewer than ``SPAN`` words are one window; they are looked up by all their words.

Texts are read once and never shuffled.  The bitmap (1 MB) is the only thing that tasks
share; a larger benchmark fills it further and lets more candidates pass, with the same
result.

Defined cases: null text has no words; items without words have no windows; rows are judged
one by one, whatever their ids; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import written

from . import words as W

SPAN, GRAM = 10, 5
BITMAP_BITS = 1 << 23

_CAND = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("words", T.StringType())]))


def _keys(w: W.Words, length: int, span: int, gram: int) -> np.ndarray:
    """Fingerprint of the ``length`` words from each word on; junk where they leave the text."""
    if length < span:
        return W.runs(w, length) ^ np.uint64(length)
    return W.sliding_min(W.runs(w, gram), span - gram + 1)


def _windows(bench: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(item, words, len, key) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.ALNUM, lower=True)
            keys = {}
            rows: list[tuple] = []
            for i, (first, last) in enumerate(zip(w.offsets[:-1], w.offsets[1:])):
                n = int(last - first)
                length = min(n, span)
                if not length:
                    continue
                if length not in keys:
                    keys[length] = _keys(w, length, span, gram).view(np.int64)
                for s in range(first, last - length + 1):
                    rows.append((i, w.text(s, s + length, lower=True), length, int(keys[length][s])))
            if rows:
                at, text, length, key = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("item").take(pa.array(at, pa.int64())), pa.array(text, pa.string()), pa.array(length, pa.int32()), pa.array(key, pa.int64())],
                    ["item", "words", "len", "key"],
                )

    schema = T.StructType(
        [T.StructField("item", bench.schema[id_col].dataType), T.StructField("words", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("key", T.LongType())]
    )
    return bench.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Marks of all fingerprints, ``BITMAP_BITS`` bits whatever the benchmark's size."""
    slot = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    cells = (
        windows.groupBy(F.shiftright(slot, 5).cast("int").alias("cell"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {BITMAP_BITS}) & 31 as int))")).alias("bits"))
        .toPandas()
    )
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    return bitmap


def _scan(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, lengths: list[int], span: int, gram: int) -> DataFrame:
    """(row, id, n_words, candidates) of every document."""
    bits = BITMAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            w = W.split(b.column("text"), W.ALNUM, lower=True)
            found = []
            for length in lengths:
                slot = _keys(w, length, span, gram) & np.uint64(bits - 1)
                marked = (bitmap[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1
                found += [(int(s), length) for s in np.flatnonzero(W.whole(w, length) & (marked == 1))]
            found.sort()
            owner = np.searchsorted(w.offsets, [s for s, _ in found], "right") - 1 if found else np.zeros(0, np.int64)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            inner = pa.StructArray.from_arrays(
                [
                    pa.array([s - int(w.offsets[o]) for (s, _), o in zip(found, owner)], pa.int32()),
                    pa.array([n for _, n in found], pa.int32()),
                    pa.array([w.text(s, s + n, lower=True) for s, n in found], pa.string()),
                ],
                ["pos", "len", "words"],
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)],
                ["id", "n_words", "cands"],
            )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("cands", _CAND)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document: (id, n_words, n_hit, spans, items).

    ``spans`` are the occurrences as (pos, len) in words, ``items`` the ids of the items
    they come from; both are null for a clean document.
    """
    windows = written(_windows(bench, item_col, item_text_col, span, gram), "bench-windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # 1 to span
    scanned = _scan(docs, id_col, text_col, _bitmap(windows), lengths, span, gram)
    scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()), "doc-windows")
    cands = scanned.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    hits = written(cands.join(windows.select("words").distinct(), "words"), "hits")
    spans = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"))
    items = (
        hits.select("row", "words").distinct()
        .join(windows.select("words", "item").distinct(), "words")
        .groupBy("row").agg(F.collect_set("item").alias("items"))
    )
    return (
        scanned.select("row", "id", "n_words")
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select("id", "n_words", covered("spans").alias("n_hit"), "spans", "items")
    )


def covered(spans: str) -> F.Column:
    """Number of words inside any of the sorted spans."""
    return F.coalesce(
        F.expr(
            f"""aggregate({spans}, named_struct('to', 0, 'n', 0L),
                (a, s) -> named_struct('to', greatest(a.to, s.pos + s.len),
                                       'n', a.n + greatest(0, s.pos + s.len - greatest(a.to, s.pos))),
                a -> a.n)"""
        ),
        F.lit(0),
    ).cast("long")
