"""Token ids in patched frame-of-reference blocks: a file format, written and read with numpy.

A file, little-endian:

* 8 bytes magic;
* blocks of 128 ids, the last one filled up: least id (4 bytes), width (1), number of exceptions
  (1), the low ``width`` bits of each id minus the least, packed, then of each exception its
  place (1 byte) and its remaining high bits (4 bytes);
* the start of each block in the file (8 bytes each);
* per document its id (8 bytes), 1 if it has one (1), and its number of ids (8);
* numbers of ids, blocks and documents, start of the block index (8 bytes each), magic.

The width covers a share of a block's values; what exceeds it is an exception."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"EKPFOR01"
BLOCK = 128
PERCENTILE = 90
FOOTER = struct.Struct("<4q8s")
HEAD = 6


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers; doubles hold them exactly."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray, base: int, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(blocks, start of each) of 32-bit ids; the first block starts at ``base``."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    n = -(-len(ids) // BLOCK)
    grid = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    least = grid.min(axis=1)
    delta = grid - least[:, None]
    bits = bit_length(delta)
    kth = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, kth, axis=1)[:, kth]
    over = bits > width[:, None]
    outliers = over.sum(axis=1)
    packed = width.astype(np.int64) * (BLOCK // 8)
    sizes = HEAD + packed + 5 * outliers
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    at = starts[:, None]
    out[at + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4] = width
    out[starts + 5] = outliers
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        for begin in range(0, len(rows), 4096):
            part = rows[begin : begin + 4096]
            shifts = np.arange(w, dtype=np.uint32)
            low = ((delta[part][:, :, None] >> shifts) & 1).astype(np.uint8)
            data = np.packbits(low.reshape(len(part), -1), axis=1, bitorder="little")
            out[starts[part][:, None] + HEAD + np.arange(data.shape[1])] = data
    block, place = np.nonzero(over)
    if len(block):
        first = np.cumsum(outliers) - outliers
        rank = np.arange(len(block)) - first[block]
        to = starts[block] + HEAD + packed[block]
        out[to + rank] = place
        high = (delta[block, place] >> width[block].astype(np.uint32)).astype("<u4")
        out[(to + outliers[block] + 4 * rank)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts + base


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks at ``starts`` of ``data`` (bytes), all 128 of each."""
    n = len(starts)
    least = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").reshape(n, 1)
    width, outliers = data[starts + 4], data[starts + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        for begin in range(0, len(rows), 4096):
            part = rows[begin : begin + 4096]
            packed = data[starts[part][:, None] + HEAD + np.arange(int(w) * (BLOCK // 8))]
            low = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), BLOCK, int(w))
            out[part] = (low.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    if outliers.any():
        block = np.repeat(np.arange(n), outliers)
        rank = np.arange(len(block)) - (np.cumsum(outliers) - outliers)[block]
        to = starts[block] + HEAD + width[block].astype(np.int64) * (BLOCK // 8)
        place = data[to + rank]
        high = np.ascontiguousarray(data[(to + outliers[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[block, place] |= high.astype(np.uint32) << width[block].astype(np.uint32)
    return out + least


@dataclass(frozen=True)
class TokenFile:
    """A file's index: where blocks start, and the documents' ids and numbers of tokens."""

    n_tokens: int
    blocks: np.ndarray
    doc_ids: np.ndarray
    has_id: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray) -> TokenFile:
        tail = data[-FOOTER.size :].tobytes()
        n_tokens, n_blocks, n_docs, index, magic = FOOTER.unpack(tail)
        if magic != MAGIC or data[:8].tobytes() != MAGIC:
            raise ValueError("not a token file")
        at = index + 8 * n_blocks
        long = lambda a, n: np.ascontiguousarray(data[a : a + 8 * n]).view("<i8")
        return cls(n_tokens, long(index, n_blocks), long(at, n_docs), data[at + 8 * n_docs : at + 9 * n_docs].astype(bool), long(at + 9 * n_docs, n_docs))


def encode_file(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    blocks, starts = encode_blocks(ids, len(MAGIC))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = len(MAGIC) + len(blocks)
    footer = FOOTER.pack(len(ids), len(starts), len(doc_ids), index, MAGIC)
    docs = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([MAGIC, blocks, starts.astype("<i8").tobytes(), docs.tobytes(), known.tobytes(), np.array(counts, dtype="<i8").tobytes(), footer])


def read_tokens(data: np.ndarray, file: TokenFile, begin: int, end: int) -> np.ndarray:
    """Ids from ``begin`` to ``end`` of a file: only the blocks that hold them are decoded."""
    if begin >= end:
        return np.zeros(0, dtype=np.uint32)
    first, last = begin // BLOCK, -(-end // BLOCK)
    ids = decode_blocks(data, file.blocks[first:last]).ravel()
    return ids[begin - first * BLOCK : end - first * BLOCK]
