"""Patched frame-of-reference blocks for integer ids.

A block holds ``BLOCK`` ids: their minimum, a bit width, the low bits of all
differences from the minimum at that width, and an exception list (position,
high bits in two or four bytes) for the outliers. The width is that of one of
the differences' ``PERCENTILES``, whichever makes the block smallest. An index
holds where each block starts.

File: magic, then sections (so that a writer needs memory for one section
only), then a footer of section positions and its length. A section holds
its documents' ids and sizes, the block index, and the blocks.
"""

from __future__ import annotations

import json
import struct

import numpy as np

BLOCK = 128
PERCENTILES = (100, 98, 95, 90, 80)
#: Set in a block's width byte if its exceptions have four bytes.
WIDE = 128
MAGIC = b"PFOR1\n"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each non-negative number below 2**32."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(rest: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of each block's values as bytes, all blocks at once."""
    values = np.ascontiguousarray(rest.T).astype(np.uint64) & np.uint64((1 << w) - 1)
    words = np.zeros((BLOCK * w // 64, values.shape[1]), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        words[word] |= values[j] << np.uint64(bit)
        if bit + w > 64:
            words[word + 1] |= values[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rest), -1)


def _unpack(data: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(data.view("<u8").reshape(len(data), -1).T)
    values = np.empty((BLOCK, len(data)), np.uint64)
    for j in range(BLOCK):
        word, bit = divmod(j * w, 64)
        values[j] = words[word] >> np.uint64(bit)
        if bit + w > 64:
            values[j] |= words[word + 1] << np.uint64(64 - bit)
    return (values & np.uint64((1 << w) - 1)).T.astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids`` and the start of each; the last block is filled with its last id."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.int64)
    blocks = np.append(ids, np.full(-n % BLOCK, ids[-1], ids.dtype)).astype(np.uint32).reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    order = np.sort(rest, axis=1)
    best = None
    for percent in PERCENTILES:
        w = _bits(order[:, BLOCK * percent // 100 - 1])
        n_out = np.count_nonzero(order >> w[:, None].astype(np.uint32), axis=1)
        wide = _bits(order[:, -1]) - w > 16
        size = 6 + w * (BLOCK // 8) + n_out * np.where(wide, 5, 3)
        if best is None:
            best = [size, w, n_out, wide]
        else:
            less = size < best[0]
            best = [np.where(less, x, y) for x, y in zip((size, w, n_out, wide), best, strict=True)]
    sizes, widths, outliers, wide = best
    high = rest >> widths[:, None].astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)

    def put(where: np.ndarray, what: np.ndarray) -> None:
        out[where[:, None] + np.arange(what.shape[1])] = what

    put(starts, low.astype("<u4").view(np.uint8).reshape(-1, 4))
    put(starts + 4, np.stack([widths + WIDE * wide, outliers], axis=1).astype(np.uint8))
    for w in np.unique(widths):
        if w:
            own = np.flatnonzero(widths == w)
            put(starts[own] + 6, _pack(rest[own], int(w)))
    block, place = np.nonzero(high)
    turn = np.arange(len(block)) - (np.cumsum(outliers) - outliers)[block]
    for flag, size in ((False, 3), (True, 5)):
        own = wide[block] == flag
        patch = np.empty((np.count_nonzero(own), size), np.uint8)
        patch[:, 0] = place[own]
        patch[:, 1:] = high[block[own], place[own]].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : size - 1]
        put(starts[block[own]] + 6 + widths[block[own]] * (BLOCK // 8) + turn[own] * size, patch)
    return out.tobytes(), starts


def decode_blocks(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)

    def get(where: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(raw[where[:, None] + np.arange(size)])

    low = get(starts, 4).view("<u4").reshape(-1)
    widths, outliers = get(starts + 4, 2).astype(np.int64).T
    wide = widths >= WIDE
    widths = widths - WIDE * wide
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(widths):
        if w:
            own = np.flatnonzero(widths == w)
            out[own] = _unpack(get(starts[own] + 6, int(w) * BLOCK // 8), int(w))
    block = np.repeat(np.arange(len(starts)), outliers)
    turn = np.arange(len(block)) - (np.cumsum(outliers) - outliers)[block]
    for flag, size in ((False, 3), (True, 5)):
        own = np.flatnonzero(wide[block] == flag)
        at = block[own]
        patch = get(starts[at] + 6 + widths[at] * (BLOCK // 8) + turn[own] * size, size)
        high = np.zeros((len(own), 4), np.uint8)
        high[:, : size - 1] = patch[:, 1:]
        out[at, patch[:, 0]] |= high.view("<u4").reshape(-1) << widths[at].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:n]


class Writer:
    """Writes documents' ids to a binary stream, a section for about ``section`` ids."""

    def __init__(self, stream, section: int = 1 << 20):
        self.stream, self.section = stream, section
        self.at, self.index = 0, []
        self.keys: list = []
        self.sizes: list[int] = []
        self.ids: list[np.ndarray] = []
        self.waiting = self.documents = self.tokens = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.section:
            self.flush()

    def flush(self) -> None:
        if not self.keys:
            return
        data, starts = encode_blocks(np.concatenate(self.ids).astype(np.uint32))
        head = json.dumps(self.keys).encode()
        sizes = np.array(self.sizes, "<i8").tobytes()
        index = starts.astype("<i8").tobytes()
        self.index.append(self.at)
        self._put(struct.pack("<5q", len(head), len(self.sizes), len(starts), self.waiting, len(data)))
        for part in (head, sizes, index, data):
            self._put(part)
        self.documents += len(self.keys)
        self.tokens += self.waiting
        self.keys, self.sizes, self.ids, self.waiting = [], [], [], 0

    def close(self) -> None:
        self.flush()
        footer = np.array(self.index, "<i8").tobytes()
        self._put(footer + struct.pack("<q", len(footer)) + MAGIC)


def read_sections(stream):
    """(keys, sizes, ids) of each section of a stream in turn."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    stream.seek(-len(MAGIC) - 8, 2)
    (footer,) = struct.unpack("<q", stream.read(8))
    stream.seek(-len(MAGIC) - 8 - footer, 2)
    for start in np.frombuffer(stream.read(footer), "<i8").tolist():
        stream.seek(start)
        head, documents, blocks, n, size = struct.unpack("<5q", stream.read(40))
        keys = json.loads(stream.read(head))
        sizes = np.frombuffer(stream.read(8 * documents), "<i8")
        starts = np.frombuffer(stream.read(8 * blocks), "<i8")
        yield keys, sizes, decode_blocks(stream.read(size), starts, n)
