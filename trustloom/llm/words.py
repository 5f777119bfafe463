"""Words of whole Arrow batches as numpy arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses these bytes inside a character. Word hashes are
sums of one random 64-bit value per byte times powers of an odd number, so the hash of every word of a batch comes out of
one running sum. Texts are worked through in pieces of ``PIECE_BYTES``, cut between words, so that memory per byte is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_draw = np.random.Generator(np.random.PCG64(20_261))
BYTE_VALUES = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
MULTIPLIER = np.uint64(int(_draw.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64 (kept for the largest n so far)."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, MULTIPLIER, dtype=np.uint64)
        down = np.full(size, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word (in place on a copy)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text starts (one entry more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of words before each text (one entry more than texts).

    ``between`` tells for every byte whether it parts words.
    """
    inside = ~between[data]
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    ends[tails] = inside[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash for every span of bytes; spans are in order. ``fold`` maps bytes first (LOWER)."""
    out = np.empty(len(first), dtype=np.uint64)
    at = 0
    values = BYTE_VALUES if fold is None else BYTE_VALUES[fold]
    while at < len(first):
        base = first[at]
        end = max(at + 1, int(np.searchsorted(first, base + PIECE_BYTES)))
        stop = last[end - 1]
        up, down = powers(int(stop - base) + 1)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(values[data[base:stop]] * up[:-1], out=total[1:])
        s, e = first[at:end] - base, last[at:end] - base
        out[at:end] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = end
    return mixed(out)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes (empty if there are fewer).

    Another salt gives an independent hash.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if salt:
        words = mixed(words + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mixed((total[size:] - total[:n]) * down[:n])


def slices(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text each (a longer text alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
