"""Words of many texts at once, from the bytes of an Arrow string column: where they are, and a 64-bit hash of each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Masks for the lowest 0 to 8 bytes of a 64-bit value.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer runs of bytes are hashed one by one.
_LONG = 1 << 12
#: Bytes of text worked on at a time; a longer single text is taken whole.
STEP = 1 << 21


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes and the offsets of each; a null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def steps(offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `step` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, "right")) - 1)
        yield a, b
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw[offsets[0]:offsets[-1]], counted from offsets[0], and the number of words in each text."""
    base = int(offsets[0])
    part = raw[base : int(offsets[-1])]
    inside = np.zeros(len(part) + 2, bool)
    inside[1:-1] = ~((part == 32) | ((part >= 9) & (part <= 13)))
    cuts = (offsets[1:-1] - base).astype(np.int64)
    starts_at = inside[1:] & ~inside[:-1]
    ends_at = inside[:-1] & ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(part))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]  # two texts that meet without white space
    starts_at[joined] = True
    ends_at[joined] = True
    starts, ends = np.flatnonzero(starts_at[:-1]), np.flatnonzero(ends_at)
    counts = np.diff(np.searchsorted(starts, offsets - base))
    return starts, ends, counts


def eights(part: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, zeros behind the end."""
    return np.ndarray((len(part) + 1,), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(raw[int(offsets[0]) : int(offsets[-1])], starts, ends)


def other_bytes(part: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stored: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which runs of part are not the bytes that stored holds at `at`, compared 8 at a time."""
    mine, theirs = eights(part), eights(stored)
    out = np.zeros(len(sizes), bool)
    who, left = np.arange(len(sizes)), sizes
    if len(sizes) and sizes.max() > _LONG:
        for k in np.flatnonzero(sizes > _LONG).tolist():
            out[k] = not np.array_equal(part[starts[k] : starts[k] + sizes[k]], stored[at[k] : at[k] + sizes[k]])
        who = np.flatnonzero(sizes <= _LONG)
        starts, at, left = starts[who], at[who], left[who]
    while len(who):
        out[who[(mine[starts] ^ theirs[at]) & _LOW[np.minimum(left, 8)] != 0]] = True
        more = left > 8
        who, starts, at, left = who[more], starts[more] + 8, at[more] + 8, left[more] - 8
    return out


def run_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: 8 bytes at a time, mixed in one after the other, so that no arithmetic of the bytes cancels out."""
    eight = eights(part)
    left = np.asarray(ends - starts, np.int64)
    out = left.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    who, at = np.arange(len(out)), np.asarray(starts, np.int64)
    if len(out) and left.max() > _LONG:
        long = left > _LONG
        out[long] = [int.from_bytes(hashlib.blake2b(part[s:e].tobytes(), digest_size=8).digest(), "little") for s, e in zip(at[long].tolist(), np.asarray(ends)[long].tolist())]
        who, at, left = who[~long], at[~long], left[~long]
    while len(who):
        out[who] = mixed(out[who] * np.uint64(0x9E3779B97F4A7C15) + (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return out
