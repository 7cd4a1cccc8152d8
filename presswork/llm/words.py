"""Words and word runs of many texts at once, as 64-bit hashes in numpy.

Texts are handled as UTF-8 bytes.  Every separator used here is ASCII, so a byte table
finds word borders without decoding; work and memory follow the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one go.
CHUNK_BYTES = 4 << 20

_U = np.uint64
#: Hashes of words are polynomials modulo a prime, for two random bases.
_PRIME, _BITS = _U(2**31 - 1), _U(31)
_random = np.random.default_rng(0x77A1D5)
_BASES = [int(x) for x in _random.integers(2**20, 2**31 - 2, 2)]
_LETTERS = _random.permutation(np.arange(1, 2**31 - 1, (2**31 - 2) // 256, dtype=_U))[:256]
#: Bytes that one running sum goes over.
_STRETCH = 1 << 18
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse."""
    if not _powers:
        prime = int(_PRIME)
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, prime)):
                p = np.ones(1, _U)
                while len(p) < _STRETCH:
                    p = np.concatenate([p, p * _U(pow(b, len(p), prime)) % _PRIME])
                both.append(p)
            _powers.append((both[0], both[1]))
    return _powers


def _part(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder."""
    return (x & _PRIME) + (x >> _BITS)


def _byte_table(lower: bool) -> np.ndarray:
    table = _LETTERS.copy()
    if lower:
        table[65:91] = table[97:123]
    return table


_spaces = np.zeros(256, bool)
_spaces[[9, 10, 11, 12, 13, 32]] = True
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[65:91] = _alnum[97:123] = True
_alnum[128:] = True

#: What a word is made of: anything but ASCII white space, or ASCII letters, digits and
#: every character beyond ASCII.
NON_SPACE, ALNUM = ~_spaces, _alnum


@dataclass
class Words:
    """Words of a run of texts: text ``i`` has the words ``offsets[i]:offsets[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    lower: bool = False

    @cached_property
    def hashes(self) -> np.ndarray:
        return _hashes(self.data, self.starts, self.ends, self.lower)

    @cached_property
    def plain(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by one blank, and where each begins and ends.

        The words ``i`` to ``j`` joined by blanks are ``plain[starts[i]:ends[j]]`` if they are
        of one text; words of a ``lower`` split have no capitals from A to Z.
        """
        size = self.ends - self.starts
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        letters = self.data[np.cumsum(inside[:-1]).astype(bool)]
        if self.lower:
            letters = np.where((letters >= 65) & (letters < 91), letters + 32, letters).astype(np.uint8)
        out = np.full(len(letters) + len(size), 32, np.uint8)
        out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
        ends = np.cumsum(size + 1) - 1
        return out.tobytes(), ends - size, ends

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, first: int, last: int, lower: bool = False) -> str:
        """The words ``first:last`` joined by one space."""
        raw = self.data.tobytes() if len(self.data) < 4096 else None
        parts = [
            (raw[s:e] if raw is not None else self.data[s:e].tobytes())
            for s, e in zip(self.starts[first:last], self.ends[first:last])
        ]
        joined = b" ".join(parts)
        return (joined.lower() if lower else joined).decode("utf-8", "replace")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins; null counts as empty."""
    texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``CHUNK_BYTES`` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def split(texts: pa.Array, kind: np.ndarray, lower: bool = False) -> Words:
    data, at = text_bytes(texts)
    n = len(data)
    inside = kind[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    if n:
        after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), lower)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each word; two words agree by chance, whatever they are made of.

    The remainders come from running sums over stretches of the bytes; a longer word is put
    together from several.
    """
    out = np.empty(len(starts), _U)
    table, first = _byte_table(lower), 0
    while first < len(starts):
        begin = starts[first]
        last = int(np.searchsorted(ends, begin + _STRETCH, "right"))
        if last <= first:
            out[first] = _long_hash(table, data[begin : ends[first]])
            first += 1
            continue
        letters = table[data[begin : ends[last - 1]]]
        s, e = starts[first:last] - begin, ends[first:last] - begin
        both = []
        for up, down in _tables():
            sums = np.zeros(len(letters) + 1, _U)
            np.cumsum(_part(letters * up[: len(letters)]), out=sums[1:])
            rest = _part(_part(_part(sums[e] - sums[s]) * down[s]))
            both.append(np.where(rest >= _PRIME, rest - _PRIME, rest))
        out[first:last] = both[0] | (both[1] << _BITS)
        first = last
    return mix(out + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def _long_hash(table: np.ndarray, word: np.ndarray) -> int:
    prime, both = int(_PRIME), []
    for base, (up, _) in zip(_BASES, _tables()):
        rest = 0
        for k in range(0, len(word), _STRETCH):
            letters = table[word[k : k + _STRETCH]]
            rest += int(_part(letters * up[: len(letters)]).sum()) * pow(base, k, prime)
        both.append(rest % prime)
    return both[0] | (both[1] << 31)


def runs(words: Words, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; those that leave their text are junk."""
    h, n = words.hashes, len(words.starts)
    out = np.zeros(n, _U)
    m = n - length + 1
    if m > 0:
        total = np.zeros(m, _U)
        for k in range(length):
            total *= _U(0x2545F4914F6CDD1D)
            total += h[k : k + m]
        out[:m] = mix(total)
    return out


def whole(words: Words, length: int) -> np.ndarray:
    """Which words begin a run of ``length`` words within their text."""
    end = np.repeat(words.offsets[1:], words.counts)
    return np.arange(len(end)) + length <= end


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` values from each place on, of fewer at the end."""
    low = x.copy()
    for k in range(1, min(n, len(x))):
        np.minimum(low[:-k], x[k:], out=low[:-k])
    return low
