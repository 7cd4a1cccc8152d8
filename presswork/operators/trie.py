"""Dictionaries of phrases as a goto table that is walked once per text, in place.

The table is made of plain arrays: distinct tokens, sorted edges (node, token), and for each
node the phrase that ends there, with the phrase's values; a row of a dictionary takes some
tens of bytes.  It is broadcast; ``TRIE_ROWS`` bounds the rows that may be.  Texts are
tokenized in the JVM, and only token arrays go through Arrow: tokens are numbered once per
distinct token of a batch, all walks of a batch go on together, one token a round, and a walk
ends where no phrase goes on.  No run of tokens is made or sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a dictionary that may be shipped with every task.
TRIE_ROWS = 2_000_000
#: Texts of a batch that are walked at a time.
PART = 500
#: Values of a phrase that are put into one list.
LISTED = 256


def fits(terms: DataFrame, most: int | None = None) -> bool:
    """Whether a dictionary may be shipped; no more than one row beyond the bound is looked at."""
    most = TRIE_ROWS if most is None else most
    return terms.limit(most + 1).count() <= most


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans of an array, the number of the span and the place in the array of all that they hold."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class GotoTable:
    """Rows (phrase, value), phrases being tokens joined by one blank, ready to be walked."""

    def __init__(self, rows: pa.Table) -> None:
        coded = rows["phrase"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        self.phrases = coded.dictionary
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.phrases)))])
        self.values = rows["value"].combine_chunks().take(pa.array(np.argsort(code, kind="stable")))
        lists = pc.split_pattern(self.phrases, " ")
        flat = lists.flatten().dictionary_encode()
        self.tokens, token = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        begin, size = lists.offsets.to_numpy()[:-1], pc.list_value_length(lists).to_numpy()
        # nodes are numbered level by level, so edges are sorted, and the i-th one leads to node i + 1
        node, edges, known = np.zeros(len(size), np.int64), [np.zeros(0, np.int64)], 1
        for k in range(size.max(initial=0)):
            on = np.flatnonzero(size > k)
            new, at = np.unique(node[on] * len(self.tokens) + token[begin[on] + k], return_inverse=True)
            node[on] = known + at
            edges.append(new)
            known += len(new)
        self.edges = np.concatenate(edges)
        self.ending = np.full(known, -1, np.int64)
        self.ending[node] = np.arange(len(node))
        self.goes_on = np.zeros(known, bool)
        self.goes_on[self.edges // max(1, len(self.tokens))] = True

    def find(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, place in it from 0, and phrase of every hit, by list, place and length."""
        flat, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        if not len(flat) or not len(self.edges):
            return (np.zeros(0, np.int64),) * 3
        coded = flat.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        token = number[coded.indices.to_numpy()]
        owner, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        start, phrase = self.walk(token, owner, end)
        return owner[start], start - (end - sizes)[owner[start]], phrase

    def walk(self, token: np.ndarray, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and phrase of every hit among numbered tokens, by place and length; -1 is no token of the table.

        ``owner`` is the list of each token, ``end`` the place behind each list.
        """
        if not len(self.edges):
            return (np.zeros(0, np.int64),) * 2
        start = np.flatnonzero(token >= 0)
        node, here, found = np.zeros(len(start), np.int64), start, []
        while len(start):
            key = node * len(self.tokens) + token[here]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            met = self.edges[edge] == key
            start, node, here = start[met], edge[met] + 1, here[met]
            phrase = self.ending[node]
            found.append((start[phrase >= 0], phrase[phrase >= 0]))
            on = self.goes_on[node] & (here + 1 < end[owner[start]])
            start, node, here = start[on], node[on], here[on] + 1
            known = token[here] >= 0
            start, node, here = start[known], node[known], here[known]
        start, phrase = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(start, kind="stable")
        return start[order], phrase[order]

    @cached_property
    def upto(self) -> np.ndarray:
        """How many values there are before each value and in all, each as often as its field ``times`` says."""
        return np.concatenate([[0], np.cumsum(self.values.field("times").to_numpy(), dtype=np.int64)])

    def values_of(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases, the number of the phrase and the place in ``values`` of all their values."""
        return _spans(self.first[phrase], self.first[phrase + 1] - self.first[phrase])


def _shared(terms: DataFrame, names: pa.Array | None = None):
    return terms.sparkSession.sparkContext.broadcast((GotoTable(terms.select("phrase", "value").toArrow()), names))


def _once(table: GotoTable, owner: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of list and phrase without repetitions."""
    size = max(1, len(table.phrases))
    pairs = np.unique(owner * size + phrase)
    return pairs // size, pairs % size


def _listed(owner: np.ndarray, n: int, fields: list[pa.Array] | pa.Array, kind: pa.DataType) -> pa.Array:
    """An array of ``n`` lists of type ``kind`` from what they hold, in the order of lists."""
    items = pa.StructArray.from_arrays(fields, fields=list(kind.value_type)) if isinstance(fields, list) else fields
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), items).cast(kind)


def _in_parts(lists: pa.Array, find: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``find`` of a batch, some texts at a time, as a walk takes several arrays of all their tokens."""
    made = pa.concat_arrays([find(lists.slice(i, PART)) for i in range(0, max(1, len(lists)), PART)])
    pa.default_memory_pool().release_unused()
    return made


def matches(terms: DataFrame, tokens: Column) -> Column:
    """Every phrase of a dictionary among the tokens: array of (pos, path, value), by position.

    ``terms`` has ``phrase``, tokens joined by one blank, and ``value``; it has to fit.
    """
    kind = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("value", terms.schema["value"].dataType)]))
    shared, arrow = _shared(terms), to_arrow_type(kind)

    def find(lists: pa.Array) -> pa.Array:
        table, _ = shared.value
        owner, place, phrase = table.find(lists)
        hit, at = table.values_of(phrase)
        fields = [pa.array(place[hit] + 1, pa.int32()), table.phrases.take(pa.array(phrase[hit])), table.values.take(pa.array(at))]
        return _listed(owner[hit], len(lists), fields, arrow)

    @F.arrow_udf(kind)
    def walk(lists: pa.Array) -> pa.Array:
        return _in_parts(lists, find)

    return walk(tokens)


def first_hits(terms: DataFrame, tokens: Column, made: Callable[..., pa.Array], kind: T.DataType) -> Column:
    """What ``made`` makes of the phrases among the tokens, as in ``asking.found``; ``terms`` has (phrase, value).

    Each phrase counts once a text, in the order of its first place, and only what is made of it leaves the walk.
    """
    shared, arrow = _shared(terms), to_arrow_type(kind)

    def find(lists: pa.Array) -> pa.Array:
        table, _ = shared.value
        owner, _, phrase = table.find(lists)
        first = np.sort(np.unique(owner * max(1, len(table.phrases)) + phrase, return_index=True)[1])
        return made(len(lists), owner[first], phrase[first], table.first, table.values.to_numpy(), table.phrases).cast(arrow)

    @F.arrow_udf(kind)
    def walk(lists: pa.Array) -> pa.Array:
        return _in_parts(lists, find)

    # else a filter that is inferred from a generator would be pushed below and walk all texts a second time
    return walk.asNondeterministic()(tokens)


def named(terms: DataFrame, tokens: Column, names: pa.Array) -> Column:
    """The distinct names of the phrases among the tokens, in the order of ``names``; a value of ``terms`` is a place there."""
    kind = T.ArrayType(T.StringType())
    shared, arrow = _shared(terms, names=names), to_arrow_type(kind)

    def find(lists: pa.Array) -> pa.Array:
        table, names = shared.value
        owner, phrase = _once(table, *table.find(lists)[::2])
        hit, at = table.values_of(phrase)
        pairs = np.unique((owner[hit] << 32) + table.values.to_numpy()[at])
        return _listed(pairs >> 32, len(lists), names.take(pa.array(pairs & 0xFFFFFFFF)), arrow)

    @F.arrow_udf(kind)
    def walk(lists: pa.Array) -> pa.Array:
        return _in_parts(lists, find)

    return walk(tokens)


def scored(terms: DataFrame, fields: list[tuple[Column, int]]) -> tuple[Column, Callable[[Column], Column]]:
    """Array of (score, begin, size) for the phrases that some field has, and what gives such an entry's values.

    ``fields`` are tokens joined by one blank, with their weights: of a batch of texts strings take
    a part of what token arrays take.  A phrase's score is the sum of the weights of the fields
    that have it.  ``terms`` has (phrase, value), and a value is given as often as its field
    ``times`` says.  A phrase has an entry for every ``LISTED`` values, as a phrase that is
    common among texts and searches alike has far more of them than a batch of texts can hold.
    """
    kind = T.ArrayType(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("size", T.IntegerType())]))
    shared, arrow = _shared(terms), to_arrow_type(kind)
    weights = np.array([w for _, w in fields])

    def find(lists: pa.Array) -> pa.Array:
        (table, _), n, size = shared.value, len(weights), len(shared.value[0].phrases) or 1
        field, phrase = _once(table, *table.find(pc.split_pattern(lists.flatten(), " "))[::2])
        rows, which = np.unique(field // n * size + phrase, return_inverse=True)
        score = np.bincount(which, weights[field % n], minlength=len(rows)).astype(np.int32)
        return _listed(*entries_of(table, rows // size, rows % size, score, len(lists)), arrow)

    @F.arrow_udf(kind)
    def walk(lists: pa.Array) -> pa.Array:
        return _in_parts(lists, find)

    return walk.asNondeterministic()(F.array(*[text for text, _ in fields])), values_by(shared, terms)


def entries_of(table: GotoTable, owner: np.ndarray, phrase: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, int, list[pa.Array]]:
    """The entries (score, begin, size) of hits, and whose they are; places count each value as often as its ``times`` says."""
    begin, end = table.upto[table.first[phrase]], table.upto[table.first[phrase + 1]]
    size = end - begin
    hit, entry = _spans(np.zeros(len(size), np.int64), -(-size // LISTED))
    at = entry * LISTED
    return owner[hit], n, [pa.array(score[hit]), pa.array(begin[hit] + at), pa.array(np.minimum(LISTED, size[hit] - at).astype(np.int32))]


def values_by(shared, terms: DataFrame) -> Callable[[Column], Column]:
    """From an entry with ``begin`` and ``size`` to the array of its values, without ``times``."""
    given = [f for f in terms.schema["value"].dataType.fields if f.name != "times"]
    kind = T.ArrayType(T.StructType(given))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def values(begin: pa.Array, size: pa.Array) -> pa.Array:
        table, _ = shared.value
        owner, place = _spans(begin.to_numpy(), size.to_numpy().astype(np.int64))
        # where no value is given twice, a place is that of the value
        at = place if table.upto[-1] == len(table.values) else np.searchsorted(table.upto, place, side="right") - 1
        made = _listed(owner, len(begin), [table.values.field(f.name).take(pa.array(at)) for f in given], arrow)
        pa.default_memory_pool().release_unused()
        return made

    return lambda entry: values.asNondeterministic()(entry["begin"], entry["size"])
