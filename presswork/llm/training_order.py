"""Token ids as fixed-stride binary shards in training order.

Every document becomes the token ids of its text and an end mark, cut into sequences of
``length`` ids, the last one filled up with end marks.  Token ids are written once, in the
order of the input; the place of a sequence in that table is its number, and a keyed Feistel
permutation with cycle-walking turns the number into the global slot.  Retries and lost
executors read the same table, hence give the same slots; a rerun over the same files and
splits gives the same shards, and another layout another, equally uniform order.

Slots are dense, so the range that a sequence belongs to is plain arithmetic: the exchange
deals out ranges of whole shards without sampling, each is sorted by slot, and one row per
shard holds the ids as little-endian numbers of 16 bits, or of 32 bits for vocabularies of over
65,536 ids, so each sequence has the same number of bytes.
Sequence ``s`` is in shard ``s // per_shard`` at the offset ``s % per_shard`` strides, so a
reader starts anywhere and resumes by slot.

Texts are read once and not shuffled; sequences are shuffled once, compressed.

Defined cases: null text counts as empty, an empty text is one sequence of end marks; rows
alike in everything get sequences each; null ids are numbered like others; an empty table
has no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import scratch_path

from .words import chunks, mix, split, text_bytes

#: A public vocabulary and the id of its end mark.
VOCABULARY, END = "/opt/tokenizers/piece_bpe_32k.model", 2
LENGTH, PER_SHARD, KEY = 512, 4096, 20240611
ROUNDS = 6
#: Shards dealt to one task, and the number of tasks that is not exceeded.
SHARDS_PER_TASK, MOST_TASKS = 4, 100_000

#: What a vocabulary has in place of a blank; a text that shows whether others are rewritten; words kept by a worker.
BLANK, PROBE, KEPT_WORDS = "\u2581", "A\u00a0\t\ufb01  b ", 250_000

_U = np.uint64
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[32] = False
_encoders: dict[int, tuple] = {}


def permute(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each number below ``size``, or with ``back`` the number of each slot."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, rounds = _U((1 << half) - 1), range(ROUNDS)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> _U(half), x & mask
        for r in reversed(rounds) if back else rounds:
            salt = mix(np.array([key, r], _U))
            if back:
                a, b = b ^ (mix(a + salt[0] + salt[1]) & mask), a
            else:
                a, b = b, a ^ (mix(b + salt[0] + salt[1]) & mask)
        return (a << _U(half)) | b

    out = once(index.astype(_U))
    while (far := out >= _U(size)).any():  # walk along the cycle until back in range
        out[far] = once(out[far])
    return out.astype(np.int64)


def tokenizer(path: str) -> bytes:
    """The vocabulary's bytes, so that tasks need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


def id_format(model: bytes, end: int | None = None) -> tuple[int, str]:
    """The end mark of a vocabulary, its own unless one is given, and the numpy type of its ids."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    end = sp.eos_id() if end is None else end
    if not 0 <= end < sp.get_piece_size():
        raise ValueError("the vocabulary has no end mark; name an id to end sequences with")
    return end, "<u2" if sp.get_piece_size() <= 1 << 16 else "<u4"


def _encoder(model: bytes) -> tuple:
    """The tokenizer, the ids of words seen by this worker, and whether words can be encoded one by one.

    They can if no piece goes on beyond a blank and texts are not rewritten first.
    """
    key = zlib.crc32(model)
    if key not in _encoders:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        parted = not any(BLANK in sp.id_to_piece(i).lstrip(BLANK) for i in range(sp.get_piece_size()))
        as_is = sp.normalize(PROBE) == BLANK + PROBE.replace(" ", BLANK)
        _encoders[key] = (sp, {}, parted and as_is)
    return _encoders[key]


def _encode(model: bytes, texts: pa.Array, end: int, kind: str) -> Iterator[np.ndarray]:
    """The ids of each text and the end mark.

    A text whose words stand between single blanks has the ids of its words, one after the
    other: distinct words are encoded once.  Other texts are encoded whole.
    """
    sp, known, by_word = _encoder(model)
    w = split(texts, _NOT_BLANK)
    lengths = np.diff(text_bytes(texts)[1])
    size = w.ends - w.starts
    before = np.concatenate([[0], np.cumsum(size)])
    plain = (w.counts > 0) & (before[w.offsets[1:]] - before[w.offsets[:-1]] + w.counts - 1 == lengths) & by_word
    letters = w.data[_NOT_BLANK[w.data]]
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(before.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
    words = words.dictionary_encode()
    distinct = words.dictionary.to_pylist()
    ids = [known.get(x) for x in distinct]
    at = [k for k, x in enumerate(ids) if x is None] if plain.any() else []
    if len(known) + len(at) > KEPT_WORDS:
        known.clear()
    lists = sp.encode([distinct[k] for k in at], num_threads=1)
    ends = (np.cumsum([0, *map(len, lists)]) * np.dtype(kind).itemsize).tolist()
    raw = np.fromiter(chain.from_iterable(lists), kind).tobytes()
    for k, a, b in zip(at, ends[:-1], ends[1:]):
        known[distinct[k]] = ids[k] = raw[a:b]
    which, mark = words.indices.to_numpy().tolist(), np.array([end], kind).tobytes()
    at = w.offsets.tolist()
    for i, text in enumerate(texts):
        whole = None if plain[i] else text.as_py() or ""
        if whole is None and BLANK not in (whole := text.as_py()):
            yield np.frombuffer(b"".join([ids[k] for k in which[at[i] : at[i + 1]]]) + mark, kind)
        else:
            yield np.array([*sp.encode(whole), end], kind)


def training_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    end: int | None = None,
) -> DataFrame:
    """One row per shard: (shard, first_slot, n_sequences, payload, doc_ids, n_tokens).

    ``doc_ids`` and ``n_tokens`` have the document and the ids before filling up of each
    sequence, in slot order.
    """
    model, spark = tokenizer(vocabulary), docs.sparkSession
    end, width = id_format(model, end)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for b in chunks(batches, "text"):
            ids = list(_encode(model, b.column("text"), end, width))
            n = np.array([-(-len(x) // length) for x in ids], np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part), pa.int32()), pa.array(places), pa.array(n), b.column("id"), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "place", "n", "id", "ids"],
            )

    own = T.StructField("id", kind)
    longs = [T.StructField("place", T.LongType()), T.StructField("n", T.LongType())]
    path = scratch_path(spark, "token-ids")
    tokens = rows.mapInArrow(encode, T.StructType([T.StructField("part", T.IntegerType()), *longs, own, T.StructField("ids", T.BinaryType())]))
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    parts = tokens.groupBy("part").agg(F.sum("n").alias("all"))  # one row per task that wrote
    total = parts.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()["n"]
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    tokens = tokens.join(F.broadcast(parts), "part").select("id", (F.col("base") + F.col("place")).alias("start"), "ids")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at, starts, sizes, out = [], [], [], []
            for i, (raw, start) in enumerate(zip(b.column("ids").to_pylist(), b.column("start").to_pylist())):
                ids = np.frombuffer(raw, width)
                n = -(-len(ids) // length)
                filled = np.full(n * length, end, width)
                filled[: len(ids)] = ids
                at += [i] * n
                starts.append(np.arange(start, start + n))
                sizes += [min(length, len(ids) - k * length) for k in range(n)]
                out += [squeeze(x.tobytes()) for x in filled.reshape(n, length)]
                if len(out) >= 4096:
                    yield packed(b, at, starts, sizes, out)
                    at, starts, sizes, out = [], [], [], []
            if out:
                yield packed(b, at, starts, sizes, out)

    def packed(b, at, starts, sizes, out) -> pa.RecordBatch:
        slots = permute(np.concatenate(starts), total, key)
        return pa.RecordBatch.from_arrays(
            [pa.array(slots), b.column("id").take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())],
            ["slot", "id", "n_tokens", "ids"],
        )

    fields = T.StructType([T.StructField("slot", T.LongType()), own, T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    n_shards = -(-total // per_shard)
    per_task = max(SHARDS_PER_TASK, -(-n_shards // MOST_TASKS))
    ordered = (
        tokens.mapInArrow(sequences, fields)
        .repartitionById(max(1, -(-n_shards // per_task)), F.floor(F.col("slot") / (per_shard * per_task)).cast("int"))
        .sortWithinPartitions("slot")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, restore = None, zstandard.ZstdDecompressor().decompress

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            payload = b"".join(map(restore, t.column("ids").to_pylist()))
            lists = [pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type)) for c in ("id", "n_tokens")]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([shard * per_shard], pa.int64()), pa.array([t.num_rows], pa.int32()), pa.array([payload], pa.binary()), *lists],
                ["shard", "first_slot", "n_sequences", "payload", "doc_ids", "n_tokens"],
            )

        for b in batches:
            of = b.column("slot").to_numpy() // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                if held and of[first] != shard:
                    yield row()
                    held = []
                shard = int(of[first])
                held.append(b.slice(first, last - first))
        if held:
            yield row()

    return ordered.mapInArrow(
        pack,
        T.StructType(
            [T.StructField("shard", T.LongType()), T.StructField("first_slot", T.LongType()), T.StructField("n_sequences", T.IntegerType()), T.StructField("payload", T.BinaryType()),
             T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", T.ArrayType(T.IntegerType()))]
        ),
    )


def read_sequences(shards: DataFrame, start: int = 0, stop: int | None = None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, doc_id, ids) of the slots from ``start`` to before ``stop``; other shards are not read."""
    rows = shards.filter(F.col("shard") >= start // per_shard)
    if stop is not None:
        rows = rows.filter(F.col("shard") <= (stop - 1) // per_shard)
    kind = shards.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, payload, ids in zip(b.column("first_slot").to_pylist(), b.column("payload").to_pylist(), b.column("doc_ids").to_pylist()):
                width = "<u2" if len(payload) == 2 * length * len(ids) else "<u4"
                lines = np.frombuffer(payload, width).reshape(-1, length).astype(np.int32)
                keep = [k for k in range(len(lines)) if first + k >= start and (stop is None or first + k < stop)]
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first + k for k in keep], pa.int64()), pa.array([ids[k] for k in keep]).cast(b.schema.field("doc_ids").type.value_type), pa.array([lines[k] for k in keep], pa.list_(pa.int32()))],
                        ["slot", "doc_id", "ids"],
                    )

    return rows.select("first_slot", "payload", "doc_ids").mapInArrow(
        run, T.StructType([T.StructField("slot", T.LongType()), T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    )
