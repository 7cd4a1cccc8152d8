"""Small helpers for models fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import written


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: one in five, by the checksum of the id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None, max_rows: int, max_bytes: int
) -> DataFrame:
    """A bounded sample (_id, _y, _order, _weight, _text) of the labelled documents.

    Documents and labels meet first, by id alone; ids without a text or without a label take
    no part.  Of each label the first ``max_rows / 2`` ids in the order of a hash are taken,
    as long as their texts have not reached ``max_bytes / 2``; texts of any length may be among
    them.  ``_weight`` is the number of documents of the label that each row stands for,
    so the shares of the labels are those of all labelled documents.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if use is not None:
        marks = marks.filter(use)
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")).filter("_y in (0, 1)")
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sizes = texts.groupBy("_doc").agg(F.min(F.octet_length("_text")).cast("long").alias("_bytes"))
    known = written(sizes.join(marks, F.col("_doc") == F.col("_id")).select("_id", "_y", "_bytes", F.xxhash64("_id").alias("_order")), "labelled-ids")
    counts = known.groupBy("_y").agg(F.count(F.lit(1)).alias("_all"))
    first = [known.filter(F.col("_y") == y).orderBy("_order", "_id").limit(max_rows // 2) for y in (0, 1)]
    # no more rows than max_rows from here on
    before = F.sum("_bytes").over(Window.partitionBy("_y").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = first[0].unionAll(first[1]).withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < max_bytes // 2)
    taken = written(taken, "sampled-ids")
    weights = taken.groupBy("_y").agg(F.count(F.lit(1)).alias("_taken")).join(counts, "_y").select("_y", (F.col("_all") / F.col("_taken")).alias("_weight"))
    picked = taken.join(F.broadcast(weights), "_y").select("_id", "_y", "_order", "_weight")  # two rows
    # ids are bounded in number, and only the texts that they name leave the scan
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return rows.groupBy("_id", "_y", "_order", "_weight").agg(F.min("_text").alias("_text"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column | None, max_rows: int, max_bytes: int
) -> list[tuple[str, int, float]]:
    """``labelled_rows`` as triples (text, label, weight), in the order of the hash."""
    got = labelled_rows(docs, labels, id_col, text_col, label_col, use, max_rows, max_bytes).collect()
    return [(r["_text"], r["_y"], r["_weight"]) for r in sorted(got, key=lambda r: (r["_order"], r["_id"]))]


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, weight: np.ndarray | None = None) -> list[float]:
    """Weights of a logistic model by Newton steps; the last one is the constant.

    ``weight`` is the number of rows that each row stands for.
    """
    of = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    middle = np.average(x, axis=0, weights=of)
    spread = np.sqrt(np.average((x - middle) ** 2, axis=0, weights=of)) + 1e-9
    x = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], l2 * of.sum())
    pull[-1] = 1e-9 * of.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (of * (p - y)) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ middle
    return [float(v) for v in w]
