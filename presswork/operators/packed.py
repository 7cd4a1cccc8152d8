"""Lists of numbers as bytes: seven bits a byte, lowest first, the highest bit set but in a number's last byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lists of numbers from 0, which end before ``ends``, and where each list's bytes end."""
    numbers = numbers.astype(np.int64)
    size = np.ones(len(numbers), np.int64)
    bits = 7
    while bits < 63 and (more := numbers >> bits > 0).any():
        size += more
        bits += 7
    until = np.cumsum(size)
    out = np.zeros(until[-1] if len(until) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        on = np.flatnonzero(size > k)
        out[until[on] - size[on] + k] = (numbers[on] >> 7 * k & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, np.concatenate([[0], until])[ends]


def packed(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``pack`` as binary values."""
    data, until = pack(numbers, ends)
    offsets = np.concatenate([[0], until]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some bytes, and how many of them end up to each place from 0 on, with a 0 before."""
    last = data < 128
    until = np.flatnonzero(last) + 1
    begin = np.concatenate([[0], until[:-1]])[: len(until)]
    out = np.zeros(len(until), np.int64)
    length = until - begin
    for k in range(length.max(initial=0)):
        on = np.flatnonzero(length > k)
        out[on] |= (data[begin[on] + k].astype(np.int64) & 127) << 7 * k
    return out, np.concatenate([[0], np.cumsum(last)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values, one value after the other, and how many each has."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    data = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    numbers, upto = unpack(data)
    return numbers, np.diff(upto[offsets - offsets[0]])
