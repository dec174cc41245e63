"""Text columns as byte buffers: words, their hashes and word shingles, without a Python loop per word.

A batch of texts is one run of UTF-8 bytes. A prefix sum of ``byte * BASE**position`` gives the
hash of any span in constant time (arithmetic modulo 2**64), so words, chunks and windows are
hashed with whole-array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
# Letters, roughly: A-Z, a-z and every byte beyond ASCII.
IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# What a worker keeps between tasks; operators that need none of it let go of all.
_kept: list[Callable[[], None]] = []
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "base" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return _powers[kind][:n]


@dataclass
class Texts:
    """Some texts as bytes; a space follows each, so that no word runs into the next text."""

    data: np.ndarray
    offsets: np.ndarray  # where each text begins, and the end of the last

    def __post_init__(self):
        self._prefix = None

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("base", n), out=self._prefix[1:])
        raw = (self._prefix[ends] - self._prefix[starts]) * _power("inverse", len(self.data) + 1)[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def words(self, letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of bytes of ``letters``: all but space and tab to return."""
        inside = letters[self.data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    """The bytes of a string column (null as empty), with A-Z lowered if asked."""
    strings = pc.fill_null(column.cast(pa.large_string()), "")
    spaced = pc.binary_join_element_wise(strings, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(spaced, pa.ChunkedArray):
        spaced = spaced.combine_chunks()
    if not len(spaced):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = spaced.buffers()
    bounds = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return Texts(_LOWER[raw] if lower else raw, bounds - bounds[0])


def kept_between_tasks(forget: Callable[[], None]) -> None:
    """Register how to drop a cache that lives as long as the worker."""
    _kept.append(forget)


def _give_back() -> None:
    """Return freed memory to the machine; a worker otherwise keeps what its largest task so far took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about SLICE_BYTES of text, or a single longer text.

    A worker serves one operator after another; unless ``keep`` says that this one uses them,
    caches of earlier ones are dropped first. Memory that earlier tasks freed is returned.
    """
    if not keep:
        for forget in _kept:
            forget()
    _give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(False)
        at = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


_ORDER = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def runs_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; entry i covers words i to i + n - 1."""
    count = max(0, len(word_hash) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out += mixed(word_hash[k : k + count] + np.uint64(_ORDER[k % 5] * (k + 1) & (2**64 - 1)))
    return mixed(out)


def shingles(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, ordered: text number, hash; and the count per text.

    A text of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    starts, ends, owner = texts.words()
    hashes = texts.spans_hash(starts, ends)
    count = len(texts.offsets) - 1
    runs = runs_hash(hashes, n)
    keep = owner[: len(runs)] == owner[n - 1 :] if len(runs) else np.zeros(0, bool)
    owners, values = [owner[: len(runs)][keep]], [runs[keep]]
    words = np.bincount(owner, minlength=count)
    first = np.cumsum(words) - words
    for length in range(1, n):
        short = np.flatnonzero(words == length)
        if len(short):
            whole = np.full(len(short), 31 * length, np.uint64)
            for k in range(length):
                whole += mixed(hashes[first[short] + k] + np.uint64(_ORDER[k] * (k + 7) & (2**64 - 1)))
            owners.append(short)
            values.append(mixed(whole))
    owners, values = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    fresh = np.ones(len(owners), bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
    owners, values = owners[fresh], values[fresh]
    return owners, values, np.bincount(owners, minlength=count)
