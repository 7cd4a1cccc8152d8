"""Quality score by compression with dictionaries of good and of bad text.

A text that is like the good examples compresses better with a zstandard dictionary made
of them than with one made of bad examples.  The score is a logistic function, fitted on
labelled texts that took no part in the dictionaries, of the difference of both sizes over
the size without a dictionary, of that size over the length, and of the length.

The model is fitted on at most ``max_rows`` labelled documents, taken in the order of a hash
of the id until their texts reach ``max_bytes``.  In the calibration each row counts for all
labelled documents of its kind that it stands for, so a score does not depend on where a
label's rows were cut.  Every text is scored whole.

Defined cases: null and empty texts get the score of neutral features; labels that are null
are not used; several labels of one id count as their largest; with no labels of either
kind every score is 0.5; ids without text are ignored in fitting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fitting import labelled_sample, logistic_fit

#: Labelled rows used for fitting and the bytes of their texts; bytes of a dictionary.
MAX_ROWS, MAX_BYTES = 6_000, 48 << 20
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2048
LEVEL = 3


class Model:
    """Two dictionaries and the calibration."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def tools(self) -> tuple:
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        made = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return plain, *made


def features(tools: tuple, text: bytes) -> list[float]:
    """What the three compressed sizes say about a text; zeros for an empty one."""
    if not text:
        return [0.0] * 10
    alone, good, bad = (len(t.compress(text)) for t in tools)
    gap, long = bad - good, len(text) + 16.0
    d, ratio, size = gap / alone, alone / long, math.log(long)
    return [
        d, gap / long, math.copysign(math.sqrt(abs(d)), d), math.copysign(math.log1p(abs(gap)), gap),
        ratio, ratio * ratio, ratio * d, size, size * d, size * ratio,
    ]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of ``size`` bytes, or of a tenth of the texts if they are few.

    Texts are cut into samples of 2 KB, all of them used.  Texts too few to train on serve
    as they are.
    """
    samples = [t[k : k + SAMPLE_BYTES] for t in texts for k in range(0, len(t), SAMPLE_BYTES)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(1024, min(size, total // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    use: Column | None = None,
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
    dict_bytes: int = DICT_BYTES,
) -> Model:
    """Dictionaries from one half of the sampled texts, calibration on the other half."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, use, max_rows, max_bytes)
    texts = {(half, y): [] for half in (0, 1) for y in (0, 1)}
    weights = {}
    for i, (text, y, weight) in enumerate(rows):
        texts[i % 2, y].append((text or "").encode("utf-8", "replace"))
        weights[y] = weight
    model = Model(_dictionary(texts[0, 1], dict_bytes), _dictionary(texts[0, 0], dict_bytes), [0.0] * 11)
    if not (texts[1, 1] and texts[1, 0] and model.good and model.bad):
        return model
    tools = model.tools()
    x = [features(tools, t) for y in (0, 1) for t in texts[1, y]]
    y = [y for y in (0, 1) for _ in texts[1, y]]
    model.weights = logistic_fit(np.array(x), np.array(y, float), l2=1e-4, weight=np.array([weights[k] for k in y]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score, in place of a column of that name; ``keep`` names the columns kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    good, bad, w = model.good, model.bad, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Model(good, bad, w).tools() if good and bad else None
        for b in batches:
            got = []
            for t in b.column("_text_"):
                f = features(tools, (t.as_py() or "").encode("utf-8", "replace")) if tools else []
                z = sum(a * x for a, x in zip(w, f)) + w[-1]
                got.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], [*b.schema.names[:-1], out])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    return docs.select(*keep, F.col(text_col).alias("_text_")).mapInArrow(run, schema)
