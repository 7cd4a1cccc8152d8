"""Near-duplicate vectors by collision-counting projections.

Vectors are projected onto many random directions.  At the cosine sought, the difference of
two unit vectors along a Gaussian direction is normal with the deviation ``sqrt(2 - 2 cos)``
whatever the dimension, which calibrates everything:

* a table sorts the vectors into the common intervals of ``WIDE`` projections; vectors that
  share an interval in all projections of one of ``TABLES`` tables meet (a pair at the
  threshold meets nowhere once in ten thousand);
* for those that meet, the windows centred on the query that hold the other vector are
  counted over ``COUNTED`` projections, and pairs reaching the count that all but one in
  ten thousand true pairs reach are verified by their cosine in double precision.

Interval keys without a second vector are dropped while rows are narrow.  Equal vectors are
one vertex with a multiplicity.  Intervals with many vectors are dealt out as pairs of
blocks; a task hands on link counts and a spanning set of links, never pairs.  A pair that
meets in several tables is counted in the first of them only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those without label or id, link with nothing; vectors of different length link with
nothing; rows alike in everything are different vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import written

from .components import components
from .words import mix

COSINE = 0.98
TABLES, WIDE, COUNTED = 33, 20, 64
#: Interval width and half window in deviations of a true pair; share of pairs that may miss.
WIDTH, WINDOW, MISS = 12.0, 2.0, 1e-4
BLOCK = 1024


@lru_cache(maxsize=4)
def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77 + dim)
    return rng.standard_normal((dim, TABLES * WIDE)), rng.random(TABLES * WIDE)


def _needed() -> int:
    """The largest count that a true pair falls below with a probability of ``MISS`` at most."""
    p = math.erf(WINDOW / math.sqrt(2))
    below = 0.0
    for k in range(COUNTED + 1):
        below += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if below > MISS:
            return k
    return COUNTED


def interval_keys(units: np.ndarray, deviation: float) -> np.ndarray:
    """One key for each vector and table."""
    a, offset = _directions(units.shape[1])
    cells = np.floor(units @ a / (WIDTH * deviation) + offset).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(units), TABLES, WIDE)
    keys = np.zeros(cells.shape[:2], np.uint64) + np.arange(1, TABLES + 1, dtype=np.uint64)
    for k in range(WIDE):
        keys = mix(keys ^ cells[:, :, k])
    return keys.view(np.int64)


def _units(raw: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1)[:, None]  # squares of the largest doubles would overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE
) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept)."""
    deviation, needed = math.sqrt(2 - 2 * cosine), _needed()
    vec = F.col(vector_col).cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & ~odd & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.coalesce(usable, F.lit(False)), vec).alias("vec")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            raw = [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).tobytes() for v in lists]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(raw, pa.binary())], ["id", "label", "raw"])

    id_type, label_type = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"id {id_type}, label {label_type}, raw binary")
    packed = packed.withColumn("vkey", F.md5("raw"))
    distinct = packed.filter("raw is not null").groupBy("label", "vkey").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")
    )
    distinct = distinct.withColumn("vid", F.monotonically_increasing_id())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column("raw").to_pylist()])
            for n in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == n)))
                keys = interval_keys(_units(part.column("raw")), deviation)
                at = pa.array(np.arange(len(keys) + 1) * TABLES, pa.int32())
                dim = pa.array(np.full(len(keys), n // 8), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, dim, pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1)))], [*b.schema.names, "dim", "keys"])

    fields = f"label {label_type}, vkey string, id {id_type}, copies long, raw binary, vid long, dim int, keys array<long>"
    distinct = written(distinct.mapInArrow(project, fields), "vectors")

    met = distinct.select("label", "dim", "vid", F.posexplode("keys").alias("t", "key"))
    many = met.groupBy("label", "dim", "t", "key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = met.join(many, ["label", "dim", "t", "key"]).withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "dim", "t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "vid")
    met = met.join(distinct.select("vid", "raw", "copies", "keys"), "vid")

    def compare(group: pa.Table) -> pa.Table:
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        vid, mine = group.column("vid").to_numpy(), group.column("mine").to_numpy()
        copies = group.column("copies").to_numpy()
        units = _units(group.column("raw").combine_chunks())
        keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(len(vid), TABLES)
        p = units @ _directions(units.shape[1])[0][:, :COUNTED]
        left = np.flatnonzero(mine == i)
        right = np.flatnonzero(mine == j)
        degree, root, links = np.zeros(len(vid), np.int64), np.arange(len(vid)), []
        for k in left:
            others = right[right > k] if i == j else right
            for c in range(t):  # a pair belongs to the first table that has it
                if not len(others):
                    break
                others = others[keys[others, c] != keys[k, c]]
            if not len(others):
                continue
            others = others[(np.abs(p[others] - p[k]) <= WINDOW * deviation).sum(1) >= needed]
            others = others[units[others] @ units[k] >= cosine]
            degree[others] += copies[k]
            degree[k] += copies[others].sum()
            for r in np.unique(root[others]):
                if r != root[k]:
                    links.append((int(vid[k]), int(vid[r])))
                    root[root == r] = root[k]
        full = np.flatnonzero(degree)
        a = vid[full].tolist() + [x for x, _ in links]
        b = [None] * len(full) + [y for _, y in links]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(degree[full].tolist() + [0] * len(links), pa.int64())})

    found = written(met.groupBy("label", "dim", "t", "key", "i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    degrees = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null"))
    named = distinct.select("vid", "id", "label", "vkey", "copies").join(roots, F.col("vid") == F.col("vertex"), "left")
    named = named.withColumn("root", F.coalesce("root", "vid")).join(degrees, F.col("vid") == F.col("a"), "left")
    lowest = named.groupBy("root").agg(F.min("id").alias("lowest"))
    named = named.join(lowest, "root").select("label", "vkey", "lowest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.coalesce("lowest", "id")
    return packed.select("id", "label", "vkey").join(named, ["label", "vkey"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
