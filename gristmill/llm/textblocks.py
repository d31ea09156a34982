"""Vectorised views of Arrow text columns: byte blocks, words and word shingles.

All helpers work on a *block*: consecutive rows of one Arrow batch whose UTF-8 bytes together stay
near ``BLOCK_BYTES`` (one longer text makes a block of its own). Words are found and hashed in
pieces of ``PIECE`` bytes, so that a long text takes its own bytes, those of its lower-cased copy
and eight bytes for each word and shingle, but no working arrays of its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES, PIECE = 1 << 18, 1 << 20
SHINGLE_WORDS = 5
#: Words up to so many bytes are hashed eight bytes at a time, all together; longer ones one by one.
SHORT_WORD = 64

_STEPS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: A-Z to a-z and nothing else; bytes above 0x7F belong to longer characters and stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit; different values stay different."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, which takes less time and memory than a hash table of them."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values if new.all() else values[new]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)``; offsets start at 0, null reads as empty."""
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_end(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """The first place from ``at`` where no word goes on: white space, or the start of a row."""
    stop, step = int(offsets[np.searchsorted(offsets, at)]), 256
    while at < stop:
        space = np.flatnonzero(SPACE[data[at : min(stop, at + step)]])
        if len(space):
            return at + int(space[0])
        at, step = min(stop, at + step), 2 * step
    return stop


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (low, high, starts, ends): the words between two places of a block, counted from ``low``; no piece cuts a word."""
    low = 0
    while low < len(data):
        high = len(data) if low + PIECE >= len(data) else word_end(data, offsets, low + PIECE)
        inside = ~SPACE[data[low:high]]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[np.searchsorted(offsets, low, side="right") : np.searchsorted(offsets, high)] - low
        before[cuts], after[cuts - 1] = False, False
        yield low, high, np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a block, and for each row the index of its first word (plus the total)."""
    parts = [(starts + low, ends + low) for low, _, starts, ends in word_pieces(data, offsets)]
    starts, ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, equal for equal bytes wherever they stand."""
    length = ends - starts
    out = (length + 1).astype(np.uint64) * np.uint64(_STEPS[0])
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from every place
    some, k = np.flatnonzero((length > 0) & (length <= SHORT_WORD)), 0
    while len(some):
        left = length[some] - k
        out[some] = mix64(out[some] ^ (lanes[starts[some] + k] & _LANE[np.minimum(left, 8)]))
        some, k = some[left > 8], k + 8
    for i in np.flatnonzero(length > SHORT_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's words in order, and for each row the index of its first word (plus the total)."""
    parts, first, total = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64), 0
    for low, high, starts, ends in word_pieces(data, offsets):
        a, b = np.searchsorted(offsets, [low, high], side="right")
        first[a:b] = total + np.searchsorted(starts, offsets[a:b] - low)
        parts.append(word_hashes(data[low:high], starts, ends))
        total += len(starts)
    return np.concatenate(parts) if len(parts) > 2 else parts[-1], first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row, the hashes of its runs of ``size`` words in order; a shorter row has its whole sequence as one."""
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for low in range(0, len(runs), PIECE // 8):
        part = runs[low : low + PIECE // 8]
        for k in range(size):
            part += words[low + k : low + k + len(part)] * np.uint64(_STEPS[k % len(_STEPS)] + 2 * (k // len(_STEPS)))
        part[:] = mix64(part)
    count = np.diff(first)
    short = np.zeros(len(count), np.uint64)
    for n in range(1, size):
        rows = np.flatnonzero(count == n)
        if len(rows):
            short[rows] = whole_runs(words, first[rows], n)
    for row, (a, n) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        yield runs[a : a + n - size + 1] if n >= size else short[row : row + (n > 0)]


def whole_runs(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For the runs of ``size`` words from ``at`` the hash that a text of just these words has as its one shingle."""
    whole = np.full(len(at), size, np.uint64)
    for k in range(size):
        whole = mix64(whole * np.uint64(_STEPS[0]) + words[at + k])
    return whole
