"""Phrases of a dictionary of any size in texts, for dictionaries too large to ship.

A bitmap of fixed size says which beginnings of phrases there may be.  Texts are walked in
blocks where they are, and a run of tokens goes on as long as the bitmap knows it, so what is
left is, but for a few, in the dictionary.  Each distinct run of a block is then asked for once:
the dictionary is dealt into parts by its phrases, a block's questions to a part are one row, and
so is the answer.  A text itself is kept as the packed numbers of its runs, the most common runs
of its block having the smallest ones; block by block they meet the answers.

Nothing is sent per token or per text and run, and tasks hold a block or a part.  A fuller
bitmap lets more runs be asked for, never fewer; the dictionary decides on the words themselves.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shuffles_removed, written
from . import trie
from .packed import packed, unpacked

#: Bits of the bitmap, and of each of the pages that it is sent in.
BITS, PAGE = 1 << 27, 1 << 19
#: Bytes of token text in a block; a longer text has a block of its own.
BLOCK = 1 << 21
#: Phrases of a dictionary in a part, about, and the least number of parts.
PART, PARTS = 50_000, 128
#: Values that are put together at a time.
EXPANDED = 1 << 21

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BEGINS, _ENDS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter((int.from_bytes(blake2b(t, digest_size=8).digest(), "little") for t in tokens.cast(pa.binary()).to_pylist()), np.uint64, len(tokens))


def _bit(state: np.ndarray, kind: np.uint64) -> np.ndarray:
    """The place in the bitmap of runs with these hashes, as a beginning or as a whole phrase."""
    mixed = (state ^ (state >> np.uint64(31))) * kind
    return (mixed >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _known(bitmap: np.ndarray, state: np.ndarray, kind: np.uint64) -> np.ndarray:
    at = _bit(state, kind)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Beginnings and ends of all phrases; pages of the bitmap are put together where they meet."""
    size = PAGE // 8

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            lists = pc.split_pattern(batch.column(0), " ")
            flat = lists.flatten().dictionary_encode()
            token = _hashes(flat.dictionary)[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
            begin, n = lists.offsets.to_numpy()[:-1], pc.list_value_length(lists).to_numpy()
            state = np.zeros(len(n), np.uint64)
            for k in range(n.max(initial=0)):
                on = np.flatnonzero(n > k)
                state[on] = state[on] * _STEP + token[begin[on] + k]
                for at in (_bit(state[on], _BEGINS), _bit(state[on[n[on] == k + 1]], _ENDS)):
                    np.bitwise_or.at(made, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for page in np.flatnonzero(made.reshape(-1, size).any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "bits": pa.array([made[page * size : (page + 1) * size].tobytes()])})

    def together(pages: pa.Table) -> pa.Table:
        made = np.zeros(size, np.uint8)
        for bits in pages["bits"]:
            made |= np.frombuffer(bits.as_py(), np.uint8)
        return pa.table({"page": pages["page"].slice(0, 1), "bits": pa.array([made.tobytes()])})

    kind = "page int, bits binary"
    found = phrases.select("phrase").mapInArrow(of_task, kind).groupBy("page").applyInArrow(together, kind).toArrow()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for page, bits in zip(found["page"].to_pylist(), found["bits"]):
        bitmap[page * size : (page + 1) * size] = np.frombuffer(bits.as_py(), np.uint8)
    return bitmap


def _runs(tokens: pa.Array, owner: np.ndarray, end: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Place and number of every run that may be a phrase, by place and length; the runs of each length."""
    coded = tokens.dictionary_encode()
    code, token = coded.indices.to_numpy().astype(np.int64), _hashes(coded.dictionary)
    # node: the number of a run among those of its length; one: a place where it is; state: its hash
    start = here = np.arange(len(code))
    node, one, state = code, np.zeros(len(token), np.int64), token
    one[code[::-1]] = start[::-1]
    hits, runs, n = [], [], 0
    while len(start):
        on = _known(bitmap, state, _BEGINS)[node]
        start, here, node = start[on], here[on], node[on]
        ends = _known(bitmap, state, _ENDS) & _known(bitmap, state, _BEGINS)
        number = n + np.cumsum(ends) - 1
        whole = ends[node]
        hits.append((start[whole], number[node[whole]]))
        first = one[ends]
        words = [coded.dictionary.take(pa.array(code[first + k])) for k in range(len(runs) + 1)]
        runs.append(pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0])
        n += len(runs[-1])
        on = here + 1 < end[owner[start]]
        start, here, node = start[on], here[on] + 1, node[on]
        # most runs end here by the bitmap, before they are numbered
        after = state[node] * _STEP + token[code[here]]
        on = _known(bitmap, after, _BEGINS)
        start, here, node, after = start[on], here[on], node[on], after[on]
        _, at, node = np.unique(node * len(token) + code[here], return_index=True, return_inverse=True)
        one, state = start[at], after[at]
    length = np.repeat(np.arange(len(hits)), np.array([len(x[0]) for x in hits], np.int64))
    start, number = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 2
    order = np.argsort(start * max(1, len(hits)) + length, kind="stable")
    return start[order], number[order], runs


def _block(texts: pa.Array, bitmap: np.ndarray, parts: int) -> tuple[pa.Array, list[tuple[int, pa.Array, np.ndarray]]]:
    """The packed runs of every text, in the order of their first places; runs and numbers by part."""
    lists = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(lists).to_numpy() * (pc.binary_length(texts).to_numpy() > 0)
    flat = lists.flatten()
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    owner, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    start, number, runs = _runs(flat, owner, end, bitmap)
    runs = pa.concat_arrays(runs) if runs else pa.array([], pa.string())
    _, first = np.unique(owner[start] * max(1, len(runs)) + number, return_index=True)
    first.sort()
    mine, number = owner[start[first]], number[first]
    by_count = np.argsort(-np.bincount(number, minlength=len(runs)), kind="stable")
    rank = np.empty(len(runs), np.int64)
    rank[by_count] = np.arange(len(runs))
    part = np.fromiter((zlib.crc32(x) % parts for x in runs.cast(pa.binary()).to_pylist()), np.int64, len(runs))
    order = np.lexsort((rank, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    asked = [(int(part[x[0]]), runs.take(pa.array(x)), rank[x]) for x in np.split(order, cuts) if len(x)]
    return packed(rank[number], np.cumsum(np.bincount(mine, minlength=len(texts)))), asked


def _ask(df: DataFrame, text: Column, bitmap: np.ndarray, parts: int) -> DataFrame:
    """Rows of both kinds: (block, id, runs) of the texts, (block, part, phrases, numbers) of the questions."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    kinds = [("block", T.StringType()), ("id", df.schema["id"].dataType), ("runs", T.BinaryType()), ("part", T.IntegerType()), ("phrases", T.StringType()), ("numbers", T.BinaryType())]
    schema = T.StructType([T.StructField(k, t) for k, t in kinds])
    arrow = to_arrow_schema(schema)

    def rows(n: int, name: str, given: dict[str, pa.Array]) -> pa.RecordBatch:
        full = {"block": pa.array([name]).take(pa.array(np.zeros(n, np.int64))), **given}
        return pa.RecordBatch.from_arrays([full[f.name].cast(f.type) if f.name in full else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // BLOCK)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                kept, asked = _block(texts[a:b], shared.value, parts)
                name = uuid.uuid4().hex
                pa.default_memory_pool().release_unused()
                yield rows(b - a, name, {"id": ids[a:b], "runs": kept})
                if asked:
                    phrases = [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), "\n") for _, x, _ in asked]
                    numbers = packed(np.concatenate([x for *_, x in asked]), np.cumsum([len(x) for *_, x in asked]))
                    yield rows(len(asked), name, {"part": pa.array([p for p, *_ in asked]), "phrases": pa.concat_arrays(phrases), "numbers": numbers})

    return df.select("id", text.alias("text")).mapInArrow(ask, schema)


def _answer(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(block, numbers, sizes, places, phrases): the runs that are phrases, and how many values each has, and these."""
    schema = T.StructType([T.StructField("block", T.StringType()), *[T.StructField(k, T.BinaryType()) for k in ("numbers", "sizes", "places")], T.StructField("phrases", T.StringType())])
    arrow = to_arrow_schema(schema)

    def answer(asked: pa.Table, terms: pa.Table) -> pa.Table:
        if not asked.num_rows or not terms.num_rows:
            return arrow.empty_table()
        coded = terms["phrase"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        values = terms["place"].combine_chunks().to_numpy()[np.argsort(code, kind="stable")]
        number, count = unpacked(asked["numbers"].combine_chunks())
        runs = pc.split_pattern(asked["phrases"].combine_chunks(), "\n").flatten()
        met = pc.fill_null(pc.index_in(runs, value_set=coded.dictionary), -1).to_numpy().astype(np.int64)
        hit = np.flatnonzero(met >= 0)
        row, met = np.repeat(np.arange(len(count)), count)[hit], met[hit]
        ends = np.cumsum(np.bincount(row, minlength=len(count)))
        size = first[met + 1] - first[met]
        which, at = trie._spans(first[met], size)
        value_ends = np.cumsum(np.bincount(row[which], minlength=len(count)))
        phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), runs.take(pa.array(hit))), "\n")
        return pa.Table.from_arrays([asked["block"], packed(number[hit], ends), packed(size, ends), packed(values[at], value_ends), phrases], schema=arrow)

    return asked.select("block", "part", "phrases", "numbers").groupBy("part").cogroup(terms.groupBy("part")).applyInArrow(answer, schema)


def found(df: DataFrame, text: Column, terms: DataFrame, made: Callable[..., pa.Array], kind: T.DataType) -> DataFrame:
    """(id, found): for each id what ``made`` makes of the phrases in its text; ids without any are left out.

    ``df`` has ``id``, which stands for one text, in as many rows as it likes; ``text`` are its
    tokens, joined by one blank.  ``terms`` has (phrase, place), places being numbers from 0.
    ``made(n, owner, number, first, places, phrases)`` gets the hits of ``n`` texts in text order, the
    number of each hit's phrase, and for each phrase by its number where its places begin.
    """
    # a part holds PART phrases, about, each with its places
    parts = max(PARTS, -(-terms.select("phrase").distinct().count() // PART))
    dealt = terms.select("phrase", "place", F.pmod(F.crc32(F.encode("phrase", "utf-8")), F.lit(parts)).cast("int").alias("part"))
    with shuffles_removed(df.sparkSession):
        bitmap = _bitmap(terms.select("phrase").distinct())
        both = written(_ask(df, text, bitmap, parts), "runs-of-blocks")
        answers = written(_answer(both.filter("part is not null"), dealt), "answers")
        texts = both.filter("part is null").select("block", "id", "runs")
        # an id that is in several blocks is answered in one of them, which a row without runs tells
        once = written(texts.groupBy("id").agg(F.min("block").alias("block")), "blocks-of-texts")
    texts = texts.unionByName(once.select("block", "id", F.lit(None).cast("binary").alias("runs")))
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("found", kind)])
    arrow = to_arrow_schema(schema)

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return arrow.empty_table()
        number, _ = unpacked(answers["numbers"].combine_chunks())
        size, _ = unpacked(answers["sizes"].combine_chunks())
        places, _ = unpacked(answers["places"].combine_chunks())
        phrases = pc.split_pattern(answers["phrases"].combine_chunks(), "\n").flatten()
        phrases = phrases.filter(pc.greater(pc.binary_length(phrases), 0))
        here = texts.filter(pc.is_null(texts["runs"]))["id"].combine_chunks()
        ids = pc.index_in(texts["id"].combine_chunks(), value_set=here)
        told = pc.and_(pc.is_valid(texts["runs"]).combine_chunks(), pc.is_valid(ids)).to_numpy(zero_copy_only=False)
        if not told.any():
            return arrow.empty_table()
        rows = np.flatnonzero(told)[np.unique(ids.filter(pa.array(told)).to_numpy(), return_index=True)[1]]
        run, count = unpacked(texts["runs"].combine_chunks().take(pa.array(rows)))
        # the answer of each run, -1 for those that are no phrase
        answer = np.full(max(run.max(initial=-1), number.max(initial=-1)) + 1, -1)
        answer[number] = np.arange(len(number))
        hit = answer[run]
        owner, hit = np.repeat(np.arange(len(rows)), count)[hit >= 0], hit[hit >= 0]
        first = np.concatenate([[0], np.cumsum(size)])
        load = np.cumsum(np.bincount(owner, size[hit], len(rows)))
        cuts = np.flatnonzero(np.diff(load // EXPANDED)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            x, y = np.searchsorted(owner, [a, b])
            out.append(made(b - a, owner[x:y] - a, hit[x:y], first, places, phrases).cast(arrow.field("found").type))
        some = np.bincount(owner, minlength=len(rows)) > 0
        table = pa.Table.from_arrays([texts["id"].combine_chunks().take(pa.array(rows)), pa.concat_arrays(out)], schema=arrow)
        return table.filter(pa.array(some))

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def values(owner: np.ndarray, number: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text and a place of its phrases, in order."""
    which, at = trie._spans(first[number], first[number + 1] - first[number])
    pairs = np.unique((owner[which] << 32) + places[at])
    return pairs >> 32, pairs & 0xFFFFFFFF
