"""Vectorised byte-level text helpers used inside Arrow tasks.

A block of texts is one ``uint8`` buffer in which every text is followed by a single
newline, so words and lines never run across texts.  Words are maximal runs of bytes
outside ``0x20`` and ``0x09-0x0D``, which are the words ``[^\\x20\\x09-\\x0D]+`` of
the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20  # texts handled together; a longer text is a block of its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lanes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte spans ``buf[starts:ends]`` as runs of 8-byte numbers, the last one filled up
    with zeros: ``(lanes, place of each in its span, first lane of each span)``.  An empty
    span has one lane."""
    size = ends - starts
    n = np.maximum(1, -(-size // 8))
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    out = words[np.repeat(starts, n) + 8 * place]
    out &= _LANE_MASK[np.minimum(np.repeat(size, n) - 8 * place, 8)]
    return out, place, first


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of the byte spans ``buf[starts:ends]``.

    Every 8-byte lane is mixed non-linearly with its place before the lanes are added, so no
    pattern of bytes cancels out: two spans collide only by chance (1 in 2**64)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lane, place, first = lanes(buf, starts, ends)
    salt = mix(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * _GOLD)
    total = np.add.reduceat(mix((lane ^ salt[place]) + _GOLD), first)
    return mix(total + (ends - starts).astype(np.uint64) * _GOLD)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column (null = empty) into blocks ``(first row, buffer, ends)``.

    ``ends[i]`` is the position of the newline that closes text ``i`` of the block.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        ends = offsets[first + 1: last + 1] - offsets[first] + np.arange(last - first)
        buf = np.empty(int(ends[-1]) + 1, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[ends] = False
        buf[keep] = data[offsets[first]: offsets[last]]
        buf[ends] = 10
        yield first, buf, ends
        first = last


def words(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the number of words before and up to each text
    (``bounds[i]:bounds[i+1]`` are the words of text ``i``)."""
    space = SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    return starts, stops, bounds


def owner(bounds: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text."""
    acc = np.concatenate(([0], np.cumsum(values)))
    return acc[bounds[1:]] - acc[bounds[:-1]]
