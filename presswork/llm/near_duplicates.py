"""Near-duplicates by SetSketch registers, likelihood estimates and exact verification.

Sketch.  A document is the set of its distinct ``SHINGLE``-word runs (all its words, if it
has fewer).  Register ``i`` holds ``floor(1 - log_b(min h_i))`` over the set, truncated to
the range of the register: exponentially spaced minima, which merge by the larger value and
are equal in two sets with a probability that rises with their similarity.

Candidates.  Documents with the same words are one vertex.  Bands of registers put vertices
into buckets; how many registers a band has follows from the similarity, so that a pair at
the threshold shares no bucket once in some thousand times (at 0.85 once in a hundred
thousand); lower similarities than 0.12 are refused.  In a bucket everybody is compared with
the vertex that shares most buckets overall, the likely original; the similarity is
estimated by maximum likelihood from the numbers of larger, smaller and equal registers
and both set sizes.  Those that are unlike it are compared with one another, in blocks.
What is alike even loosely becomes one cluster, so a true pair is never divided: both margins
follow from the similarity, as distances of sets add up.

Verification.  A cluster of bounded size is one group: a task walks from the set with most
company downwards, finds its exact links to all others by counting common shingles, and
goes on until every set outside of the largest component has been compared with all; links
within a component need no further look.  When another component becomes the largest, the
sets passed over so far have their turn again.  A larger cluster is dealt out in blocks: all
members are compared with the cluster's centre first, and only those that are not linked
to it meet every block.  A link is confirmed on the words of both texts before it counts.
Only a spanning set of links leaves the task.  No step lists all pairs of a group.

Defined cases: null, empty and blank texts have empty sets and are linked with nothing;
documents without id are linked with nothing, have no component and count as kept; rows
with one id are one document in the result's ``component_id``; equal sets are linked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import written

from . import words as W
from .components import components

SHINGLE, SIMILARITY = 5, 0.85
REGISTERS, MISSED = 64, 4e-4
BASE, TOP = 1.02, 2**16 - 2
#: Estimates from which a vertex belongs to its centre, and from which it joins the cluster,
#: for links of 0.85.
LIKE, LOOSE = 0.75, 0.55
#: Vertices in one block of unlike bucket members; shingles in one block of a cluster, of which
#: a task holds the texts, the sets and an index at once (some 150 MB).
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 1 << 19

_U = np.uint64
_rng = np.random.default_rng(20240611)
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = W.split(texts, W.NON_SPACE, lower=True)
    grams, short = W.runs(w, size), {}
    sets = []
    for first, last in zip(w.offsets[:-1], w.offsets[1:]):
        n = int(last - first)
        if n == 0:
            sets.append(np.zeros(0, _U))
        elif n >= size:
            sets.append(np.unique(grams[first : last - size + 1]))
        else:
            if n not in short:
                short[n] = W.runs(w, n)
            sets.append(short[n][first : first + 1] ^ _U(n))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; zeros for an empty one."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    elements = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for i in range(REGISTERS):
        low = np.minimum.reduceat(elements * _MUL[i] + _ADD[i], at)
        h = (low.astype(np.float64) + 1.0) * 2.0**-64
        out[full, i] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP)
    return out


def band_size(similarity: float) -> int:
    """Registers in a band: the most of 4, 2 or 1 with which pairs at the threshold are not missed."""
    for size in (4, 2, 1):
        if (1 - similarity**size) ** (REGISTERS // size) <= MISSED:
            return size
    raise ValueError(f"{REGISTERS} registers cannot find pairs of a similarity of {similarity}")


def margins(similarity: float) -> tuple[float, float]:
    """``LIKE`` and ``LOOSE`` for links of this similarity.

    Distances (1 less the similarity) add up: a set linked with one that is like the centre
    is at most ``1 - similarity`` further away.
    """
    lower = 0.85 - similarity
    return max(LIKE - lower, 0.0), max(LOOSE - 2 * lower, 0.0)


def bands(regs: np.ndarray, size: int = 4) -> np.ndarray:
    kind = {4: np.uint64, 2: np.uint32, 1: np.uint16}[size]
    packed = np.ascontiguousarray(regs).view(kind).astype(_U)
    return W.mix(packed + np.arange(1, packed.shape[1] + 1, dtype=_U) * _U(0x9FB21C651E98DF25))


_GRID = np.linspace(0.02, 1.0, 50)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of row pairs of registers, given both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / np.maximum(na + nb, 1))[:, None]
    v = 1 - u
    top = np.minimum(np.minimum(u / v, v / u), 1.0)  # similarity cannot exceed this
    j = _GRID[None, :] * top
    step = (BASE - 1) / BASE
    p = lambda x: -np.log(np.maximum(1 - np.clip(x, 0, 1) * step, 1e-300)) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tie = np.maximum(1 - up - down, 1e-12)
    score = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(tie)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def text_keys(texts: pa.Array) -> list[bytes | None]:
    """A digest of each text's words, lower-cased and joined by blanks; None without words."""
    w = W.split(texts, W.NON_SPACE, lower=True)
    plain, starts, ends = w.plain
    at = w.offsets.tolist()
    return [blake2b(plain[starts[a] : ends[b - 1]], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, band: int = 4) -> DataFrame:
    """(id, n_shingles, set_key, regs, bands) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            regs = registers(sets)
            keys = text_keys(b.column("text"))
            rows = bands(regs, band)
            at = pa.array(np.arange(len(sets) + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(at, pa.array(rows.reshape(-1).view(np.int64))),
                ],
                ["id", "n_shingles", "set_key", "regs", "bands"],
            )

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
         T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, bucket columns..., similarity) with the estimate of each pair."""
    side = lambda p: vertices.select(F.col("vid").alias(p), F.col("n").alias(f"n{p}"), F.col("regs").alias(f"r{p}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = estimate(_regs(b.column("ra")), _regs(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got)], ["a", "b", "similarity"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return both.mapInArrow(run, "a long, b long, similarity double")


def cluster_links(vertices: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of vertices that are loosely alike."""
    like_from, loose_from = margins(similarity)
    rows = written(vertices.select(F.explode("bands").alias("bucket"), "vid"), "bands")
    # tables of buckets are written, so that a join can split the rows of a large one
    counts = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "bucket-sizes")
    rows = written(rows.join(counts, "bucket"), "buckets")
    company = rows.groupBy("vid").agg(F.sum("many").alias("company"))
    rows = written(rows.join(company, "vid"), "company")
    centres = rows.groupBy("bucket").agg(F.max(F.struct("company", F.negative("vid").alias("vid"))).alias("c"))
    centres = written(centres.select("bucket", F.negative(F.col("c.vid")).alias("centre")), "centres")
    rows = written(rows.join(centres, "bucket").select("bucket", "vid", "centre"), "centred")
    stars = written(
        _estimated(rows.filter("vid != centre").select(F.col("vid").alias("a"), F.col("centre").alias("b")).distinct(), vertices).filter(F.col("similarity") >= loose_from),
        "stars",
    )
    # Members unlike their centre meet one another.
    like = stars.filter(F.col("similarity") >= like_from).select(F.col("a").alias("vid"), F.col("b").alias("centre"))
    odd = rows.filter("vid != centre").join(like, ["vid", "centre"], "left_anti").select("bucket", "vid")
    odd = written(odd, "unlike")
    sizes = written(odd.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "unlike-sizes")
    odd = odd.join(sizes, "bucket").join(vertices.select("vid", "n", "regs"), "vid")
    blocks = F.ceil(F.col("many") / BUCKET_BLOCK).cast("int")
    odd = odd.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    odd = odd.select("bucket", "vid", "n", "regs", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    odd = odd.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "vid", "n", "regs")

    def leaders(t: pa.Table) -> pa.Table:
        vid, n, regs = t.column("vid").to_numpy(), t.column("n").to_numpy(), _regs(t.column("regs").combine_chunks())
        order = np.argsort(vid)
        vid, n, regs = vid[order], n[order], regs[order]
        todo, a, b = np.ones(len(vid), bool), [], []
        for k in range(len(vid)):
            if not todo[k]:
                continue
            got = estimate(regs, np.broadcast_to(regs[k], regs.shape), n, np.full(len(n), n[k]))
            got[k] = 1.0
            near = np.flatnonzero(got >= loose_from)
            todo &= got < like_from
            a += vid[near[near != k]].tolist()
            b += [int(vid[k])] * int((near != k).sum())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = odd.groupBy("bucket", "i", "j").applyInArrow(leaders, "a long, b long")
    return stars.select("a", "b").unionAll(found)


def word_shingles(text: str | None, size: int) -> set[bytes]:
    """The shingles themselves, as words joined by blanks."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").lower())
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def alike(a: str | None, b: str | None, size: int, percent: int) -> bool:
    """Whether two texts are linked, by their words."""
    x, y = word_shingles(a, size), word_shingles(b, size)
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Inverted:
    """Sets by their elements, to count what each has in common with another one."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        elements = np.concatenate(sets) if sets else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(elements, kind="stable")
        elements, self.owner = elements[order], owner[order]
        self.first = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
        self.times = np.diff(np.concatenate([self.first, [len(elements)]]))
        self.distinct = elements[self.first]

    def common(self, s: np.ndarray) -> np.ndarray:
        """Elements that each set shares with ``s``."""
        at = np.searchsorted(self.distinct, s)
        known = at < len(self.distinct)
        at, s = at[known], s[known]
        at = at[self.distinct[at] == s]
        where = np.repeat(self.first[at], self.times[at]) + _steps(self.times[at])
        return np.bincount(self.owner[where], minlength=len(self.sizes))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        common = self.common(s)
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(s) - common))


def _verify(vid: np.ndarray, sets: list[np.ndarray], similarity: float, confirm: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the given sets; ``confirm`` decides on two places."""
    n, percent = len(sets), round(similarity * 100)
    index = _Inverted(sets)
    company = np.bincount(index.owner, weights=np.repeat(index.times, index.times), minlength=n) / np.maximum(index.sizes, 1)
    root, links = np.arange(n), []
    todo = np.lexsort((vid, -company))
    while len(todo):
        members = np.bincount(root, minlength=n)
        largest = members.argmax() if members.max() > 1 else -1
        outside = np.flatnonzero(root[todo] != largest)
        if not len(outside):
            break  # only sets of one component were not looked at, and all others were compared with them
        k, todo = todo[outside[0]], np.delete(todo, outside[0])
        linked = index.linked(sets[k], percent)
        for r in np.unique(root[linked]):
            if r != root[k]:
                at = next((int(x) for x in linked[root[linked] == r] if confirm is None or confirm(int(k), int(x))), None)
                if at is not None:
                    links.append((int(vid[k]), int(vid[at])))
                    root[root == r] = root[k]
    return links


def _steps(times: np.ndarray) -> np.ndarray:
    """0 to t-1 for each t."""
    total = np.cumsum(times)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - times, times)


def _distinct(t: pa.Table) -> tuple[list[int], list[str]]:
    """Vertices of a group, in order, and their texts."""
    found = dict(zip(t.column("vertex").to_pylist(), t.column("text").to_pylist()))
    return sorted(found), [found[v] for v in sorted(found)]


def _large_clusters(large: DataFrame, loose: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components within clusters of several blocks.

    ``large`` has (root, blocks, mine, vertex, text).  The vertex with most loose links is the
    centre; it goes to every block.  What is not linked to it meets all blocks, in blocks
    of its own, so rows are copied as often as there are blocks of such vertices.
    """
    roots = large.select("root", "blocks").distinct()
    ends = loose.select(F.col("a").alias("vertex")).unionAll(loose.select("b"))
    degree = ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("degree")).join(clusters, "vertex").join(roots, "root")
    centres = degree.groupBy("root").agg(F.max(F.struct("degree", F.negative("vertex").alias("v"))).alias("c"))
    centres = written(centres.select("root", F.negative(F.col("c.v")).alias("centre")), "cluster-centres")
    found = large.join(centres, (large["vertex"] == centres["centre"])).select(large["root"], "vertex", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"))
    first = large.select("root", "mine", "vertex", "text", F.lit(False).alias("centre")).unionByName(found.withColumn("centre", F.lit(True)))

    def near_centre(t: pa.Table) -> pa.Table:
        middle = t.filter(t.column("centre"))
        centre, text = middle.column("vertex")[0].as_py(), middle.column("text")[0].as_py()
        vid, texts = _distinct(t)
        sets = shingle_sets(pa.array([text, *texts], pa.large_string()), size)
        linked = {int(k) for k in _Inverted(sets[1:]).linked(sets[0], percent)}
        linked = {k for k in linked if vid[k] != centre and alike(text, texts[k], size, percent)}
        rows = [(centre, v, k not in linked) for k, v in enumerate(vid) if v != centre]
        a, b, left = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "left": pa.array(left, pa.bool_())})

    met = written(first.groupBy("root", "mine").applyInArrow(near_centre, "a long, b long, left boolean"), "centre-links")
    links = met.filter("not left").select("a", "b")
    left = written(met.filter("left").select(F.col("b").alias("vertex")), "unlinked")
    if left.isEmpty():
        return links
    rest = large.join(left, "vertex")
    # as many rows as the vertices left bring, a character being no shorter than its share of a shingle
    shares = rest.groupBy("root").agg(F.ceil(F.sum(F.length("text")) / (4 * CLUSTER_BLOCK)).cast("int").alias("parts"))
    shares = written(shares, "unlinked-sizes")
    rest = rest.join(shares, "root").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vertex"), F.col("parts")).cast("int"))
    rest = rest.select("root", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"), "vertex", "text", F.lit(True).alias("left"))
    others = large.join(left.withColumn("own", F.lit(True)), "vertex", "left").join(shares, "root")
    others = others.select(
        "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "mine", "vertex", "text", F.lit(False).alias("left"), F.col("own").isNull().alias("settled")
    )
    both = others.unionByName(rest.withColumn("settled", F.lit(False)))

    def meet(t: pa.Table) -> pa.Table:
        mine = t.filter(t.column("left"))
        vid, text = _distinct(mine)
        other = t.filter(pc.invert(t.column("left")))
        ids, texts = _distinct(other)
        settled = dict(zip(other.column("vertex").to_pylist(), other.column("settled").to_pylist()))
        sets = shingle_sets(pa.array([*text, *texts], pa.large_string()), size)
        index = _Inverted(sets[len(vid) :])
        links = []
        for k, v in enumerate(vid):
            done = False  # one settled vertex stands for all of them
            for x in index.linked(sets[k], percent).tolist():
                if ids[x] == v or (done and settled[ids[x]]) or not alike(text[k], texts[x], size, percent):
                    continue
                done = done or settled[ids[x]]
                links.append((v, ids[x]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return links.unionAll(both.groupBy("root", "part", "mine").applyInArrow(meet, "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept)."""
    rows = written(sketches(docs, id_col, text_col, size, band_size(similarity)), "sketches")
    vertices = rows.filter("set_key is not null and id is not null").groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")
    )
    vertices = written(vertices.withColumn("vid", F.monotonically_increasing_id()), "vertices")
    loose = written(cluster_links(vertices, similarity), "loose-links")
    clusters = components(loose)
    sizes = clusters.join(vertices.select(F.col("vid").alias("vertex"), "n"), "vertex").groupBy("root").agg(F.sum("n").alias("shingles"))
    dealt = (
        clusters.join(written(sizes, "cluster-sizes"), "root")
        .withColumn("blocks", F.ceil(F.col("shingles") / CLUSTER_BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
        .join(vertices.select(F.col("vid").alias("vertex"), "id", "set_key"), "vertex")
        .select("root", "blocks", "mine", "vertex", F.col("id").alias("_id"), "set_key")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = texts.join(dealt, F.col("id") == F.col("_id")).drop("id", "_id")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches, "text"):
            # Rows that repeat an id with another text are not the one that was meant.
            right = [i for i, (mine, key) in enumerate(zip(text_keys(b.column("text")), b.column("set_key").to_pylist())) if mine == key]
            at = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in names], names)

    names = ["root", "blocks", "mine", "vertex", "text"]
    loaded = dealt.select("root", "blocks", "mine", "vertex", "set_key", "text").mapInArrow(load, "root long, blocks int, mine int, vertex long, text string")
    loaded = written(loaded, "cluster-texts")
    percent = round(similarity * 100)

    def check(t: pa.Table) -> pa.Table:
        """Spanning links of a whole cluster."""
        vid, text = _distinct(t)
        sets = shingle_sets(pa.array(text, pa.large_string()), size)
        links = _verify(np.array(vid), sets, similarity, lambda x, y: alike(text[x], text[y], size, percent))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = loaded.filter("blocks = 1").select("root", "vertex", "text").groupBy("root").applyInArrow(check, "a long, b long")
    large = loaded.filter("blocks > 1")
    if not large.isEmpty():
        links = links.unionAll(_large_clusters(large, loose, clusters, size, percent))
    roots = components(links)
    named = vertices.select("vid", "set_key", "id").join(roots, F.col("vid") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "vid"))
    lowest = named.groupBy("root").agg(F.min("id").alias("lowest"))
    named = named.join(lowest, "root").select("set_key", "lowest")
    out = rows.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
