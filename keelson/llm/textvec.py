"""Vectorised text handling on Arrow buffers: word boundaries, 64-bit word hashes, shingles.

Everything works on the UTF-8 bytes of whole texts. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D. A text needs 8 bytes a word beyond its own bytes, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers from a fixed seed, one for each lane of eight bytes, and masks of a lane's first bytes.
LANES = 8
MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, LANES, dtype=U64) * U64(2) + U64(1)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, end to end, and its n+1 offsets from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column's bytes stay near a bound; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end].

    Lanes of eight bytes go in one after the other, each through a mix that no ring makes linear; ranges of
    one length up to eight bytes never collide. Ranges beyond LANES lanes take the first bytes of a BLAKE2b.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) << U64(56))
    left = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    for k in range(LANES):
        if not len(left):
            break
        rest = size[left] - 8 * k
        out[left] = mix((out[left] ^ lane[starts[left] + 8 * k] & FIRST_BYTES[np.minimum(rest, 8)]) * MULTIPLIERS[k])
        left = left[rest > 8]
    raw = memoryview(np.ascontiguousarray(data))
    for k in np.flatnonzero(size > 8 * LANES):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the place of its first word (n+1 long)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    blank = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased if asked) and each text's first place among them."""
    starts, ends, first = words(data, offs)
    return segment_hashes(LOWER[data] if lower else data, starts, ends), first


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words inside each text, and each text's first place.

    A text of one word up to width - 1 has one window: its whole sequence. No words, no window.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    place = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1], count) + np.arange(place[-1]) - np.repeat(place[:-1], count)
    length = np.repeat(np.minimum(n, width), count)
    out = length.astype(U64)
    for k in range(width):
        inside = k < length
        word = hashes[np.minimum(start + k, max(0, len(hashes) - 1))] if len(hashes) else out
        out = np.where(inside, mix(out * U64(0x100000001B3) + word), out)
    return out, place


def unique_sets(values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, once each; and the places."""
    parts = [np.unique(values[a:b]) for a, b in zip(place[:-1], place[1:], strict=True)]
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else values[:0]), sizes


def group_sums(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[place[1:]] - total[place[:-1]]
