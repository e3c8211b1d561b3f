"""Word sequences of a batch of texts as arrays: bounds, hashes and window hashes.

Words are runs of anything but ASCII white space. Every lane has its own 64-bit
hash of a word's bytes: eight bytes at a time go through a mixing step that is
chained from one to the next and starts from the lane's seed. A prefix sum of these, weighted by powers of an odd number
modulo 2**64, then gives the hash of a short run of words with a subtraction and
one multiplication, whatever white space stands between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER_TABLE

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_LOWER = np.frombuffer(LOWER_TABLE, np.uint8)
#: White space, control characters and ASCII punctuation.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Odd multipliers of the polynomials, and their inverses modulo 2**64.
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Where the chain of each lane starts.
_SEEDS = (0xA0761D6478BD642F, 0x2D358DCCAA6C78A5)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes [start, end) of every word."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = np.full(len(starts), _SEEDS[lane], np.uint64)
    own = np.arange(len(starts))
    for step in range(0, LONG_WORD, 8):
        if not len(own):
            break
        left = size[own] - step
        value = eight[starts[own] + step]
        cut = left < 8
        value[cut] &= (np.uint64(1) << (8 * left[cut]).astype(np.uint64)) - np.uint64(1)
        out[own] = mix(out[own] ^ value, step + 1)
        own = own[left > 8]
    if len(own):
        from xxhash import xxh3_64_intdigest

        for k in own.tolist():
            out[k] = xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes(), _SEEDS[lane])
    return mix(out ^ (size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))


_powers: list[np.ndarray] = []


def powers(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), kept and grown as needed."""
    while len(_powers) < 4:
        _powers.append(np.ones(1, np.uint64))
    at = lane + 2 * inverse
    if len(_powers[at]) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), (_INVERSE if inverse else _BASE)[lane], np.uint64)
        steps[0] = 1
        _powers[at] = np.multiply.accumulate(steps)
    return _powers[at][:n]


class Words:
    """The words of a string array, documents one after another."""

    def __init__(self, texts: pa.Array, lanes: int = 2, separators: np.ndarray = _SPACE, lower: bool = False) -> None:
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if lower:
            raw = _ASCII_LOWER[raw]
        bounds = offsets - offsets[0]
        self.raw, self.n_docs = raw, len(texts)
        word = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)  # a document starts here
        edge[bounds] = True
        before = np.concatenate([[False], word])
        after = np.concatenate([word, [False]])
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        #: Words of document d are first[d] up to first[d + 1].
        self.first = np.searchsorted(self.starts, bounds)
        self.first[-1] = len(self.starts)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        self._sums = []
        for lane in range(lanes):
            own = word_hashes(raw, self.starts, self.ends, lane) if lane else self.hashes
            weighted = own * powers(lane, len(own))
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)]))

    def runs(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hashes of the word runs [start, end)."""
        sums = self._sums[lane]
        shift = powers(lane, len(sums), True)[starts]
        return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64), 7)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))


#: Text bytes that are held as arrays at once.
CHUNK = 1 << 20


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of some ``CHUNK`` text bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > CHUNK:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
