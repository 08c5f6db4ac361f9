"""A static range asymmetric numeral system (rANS) coder for token ids.

A segment holds a frequency table that its blocks share. A block is coded by itself, over interleaved lanes, and the index has a
checkpoint for each: where its words begin, the lanes' states and a CRC-32 of its ids, so blocks can be decoded in parallel and
in any order. Here all lanes of all blocks of a segment advance together as one vector.

A segment with more than SCALE distinct ids is coded as the 16-bit halves of its ids, under a magic of its own.

Layout, little-endian: magic, ids, lanes, steps of a block, blocks, bytes of the table | table (zlib) | by block: first word,
CRC-32, lane states | 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the file format.
MAGIC, HALVES = b"QRA1", b"QRA2"
HEAD = struct.Struct("<4sQIIII")
SCALE_BITS = 16
SCALE = 1 << SCALE_BITS
LOW = 1 << 16


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum SCALE, each at least 1."""
    if len(counts) > SCALE:
        raise ValueError(f"more than {SCALE} distinct ids in one segment")
    f = np.maximum(1, counts * SCALE // counts.sum()).astype(np.int64)
    over = int(f.sum()) - SCALE
    if over > 0:
        spare = f - 1
        f -= spare * over // spare.sum()
        over = int(f.sum()) - SCALE
        for at in np.argsort(-f, kind="stable"):
            if not over:
                break
            cut = min(over, int(f[at]) - 1)
            f[at] -= cut
            over -= cut
    f[np.argmax(f)] -= over
    return f


def encode(ids: np.ndarray, lanes: int = 32, block: int = 16384) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, lanes, 0, 0, 0)
    if ids.max() < 1 << 22:  # counting is faster than sorting
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts, index = every[symbols], (np.cumsum(every > 0) - 1).astype(np.uint32)[ids]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    if len(symbols) > SCALE:
        return HALVES + encode(ids.view("<u2"), lanes, block)[len(MAGIC) :]
    f = frequencies(counts)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    steps = -(-min(n, block) // lanes)
    blocks = -(-n // (steps * lanes))
    padded = np.full(blocks * steps * lanes, np.argmax(f), np.uint16)
    padded[:n] = index
    wide = padded.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, -1)  # at most SCALE symbols: 16 bits are enough
    freq, start = f.astype(np.uint32), (np.cumsum(f) - f).astype(np.uint32)
    x = np.full(blocks * lanes, LOW, np.uint32)
    words, out = np.empty(wide.shape, np.uint16), np.empty(wide.shape, bool)
    shift = np.uint32(16)
    for t in range(steps - 1, -1, -1):
        fr = freq[wide[t]]
        out[t] = full = (x >> shift) >= fr
        words[t] = x.astype(np.uint16)
        x = np.where(full, x >> shift, x)
        q = x // fr
        x = (q << shift) + (x - q * fr) + start[wide[t]]
    by_block = (blocks, steps * lanes)
    words = words.reshape(steps, blocks, lanes).transpose(1, 0, 2).reshape(by_block)
    out = out.reshape(steps, blocks, lanes).transpose(1, 0, 2).reshape(by_block)
    first = np.concatenate([[0], np.cumsum(out.sum(axis=1))[:-1]]).astype("<u8")
    size = steps * lanes
    crc = np.array([zlib.crc32(ids[b * size : (b + 1) * size].tobytes()) for b in range(blocks)], "<u4")
    return HEAD.pack(MAGIC, n, lanes, steps, blocks, len(table)) + table + first.tobytes() + crc.tobytes() + x.astype("<u4").tobytes() + words[out].astype("<u2").tobytes()


def decode(data: bytes, only: tuple[int, int] | None = None) -> np.ndarray:
    """All ids, or those of blocks only[0] to only[1] - 1. A wrong checksum raises ValueError."""
    magic, n, lanes, steps, blocks, size = HEAD.unpack_from(data)
    if magic == HALVES:
        return decode(MAGIC + data[len(HALVES) :], only).astype("<u2").view("<u4")
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    if not n:
        return np.empty(0, "<u4")
    at = HEAD.size
    table = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
    symbols, f = np.cumsum(table[: len(table) // 2], dtype=np.uint32), table[len(table) // 2 :].astype(np.int64)
    at += size
    first = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    at += 8 * blocks
    crc = np.frombuffer(data, "<u4", blocks, at)
    at += 4 * blocks
    x = np.frombuffer(data, "<u4", blocks * lanes, at)
    words = np.frombuffer(data, "<u2", -1, at + 4 * blocks * lanes)
    lo, hi = only or (0, blocks)
    x, pointer, width = x[lo * lanes : hi * lanes], first[lo:hi], hi - lo
    slot_symbol, slot_freq = np.repeat(symbols, f), np.repeat(f, f).astype(np.uint32)
    slot_bias = (np.arange(SCALE) - np.repeat(np.cumsum(f) - f, f)).astype(np.uint32)
    words = np.append(words, np.uint16(0)).astype(np.uint32)
    ids, shift, low = np.empty((steps, width * lanes), "<u4"), np.uint32(16), np.uint32(LOW)
    for t in range(steps):
        slot = x & np.uint32(SCALE - 1)
        ids[t] = slot_symbol[slot]
        x = slot_freq[slot] * (x >> shift) + slot_bias[slot]
        need = x < low
        rank = np.cumsum(need.reshape(width, lanes), axis=1)
        where = (pointer[:, None] + rank - 1).reshape(-1)
        x = np.where(need, (x << shift) | words[np.minimum(where, len(words) - 1)], x)
        pointer = pointer + rank[:, -1]
    whole = (x.reshape(width, lanes) == low).all(axis=1)  # every lane is back where the encoder began
    out = ids.reshape(steps, width, lanes).transpose(1, 0, 2).reshape(width, -1)
    last = n - (blocks - 1) * steps * lanes
    got = [row[: last if b == blocks - 1 else None] for b, row in enumerate(out, lo)]
    for b, row in enumerate(got, lo):
        if not whole[b - lo] or zlib.crc32(row.tobytes()) != crc[b]:
            raise ValueError(f"block {b} is damaged")
    return np.concatenate(got) if got else np.empty(0, "<u4")
