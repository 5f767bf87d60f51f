"""Static range asymmetric numeral system over token ids.

One file holds a shared frequency table and independent blocks. A block interleaves
LANES coder states; its header keeps the states (checkpoints), so any block decodes alone,
and all blocks of a file decode side by side in numpy.

Layout (little-endian): magic ``GMRANS1\\n``, uint32 length and JSON header, then zlib-compressed
sections as the header lists them: symbols and frequencies, document ids and sizes, the block
directory (n_tokens, words, crc32), the lane states, and the blocks' 32-bit words.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"GMRANS1\n"
LANES = 256
BITS = 20  # frequencies of a table sum to 2^20
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_B = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Scale positive counts to sum to 2^BITS, each at least 1."""
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError("more symbols than the table can hold")
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    gap = total - int(f.sum())
    if gap > 0:
        f[np.argmax(f)] += gap
    while gap < 0:
        big = np.argsort(-f, kind="stable")[: min(-gap, len(f))]
        big = big[f[big] > 1]
        f[big] -= 1
        gap += len(big)
    return f


def encode_blocks(symbols: np.ndarray, freq: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """symbols: table positions. Returns the states (blocks x LANES) and each block's words."""
    n_blocks = max(1, -(-len(symbols) // block))
    steps = block // LANES
    padded = np.zeros(n_blocks * block, np.int32)
    padded[: len(symbols)] = symbols
    grid = padded.reshape(n_blocks, steps, LANES)
    f64 = freq.astype(np.uint64)
    c64 = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    limit = (LOW >> _B << _32) * f64
    x = np.full((n_blocks, LANES), LOW, np.uint64)
    words = np.zeros(grid.shape, np.uint32)
    out = np.zeros(grid.shape, bool)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t, :]
        f = f64[s]
        full = x >= limit[s]
        words[:, t, :] = x.astype(np.uint32)
        out[:, t, :] = full
        x = np.where(full, x >> _32, x)
        q = x // f
        x = (q << _B) + (x - q * f) + c64[s]
    return x, [words[b][out[b]] for b in range(n_blocks)]


def decode_blocks(states: np.ndarray, words: list[np.ndarray], freq: np.ndarray, block: int) -> np.ndarray:
    """Inverse of encode_blocks: blocks x block table positions."""
    n_blocks = len(states)
    steps = block // LANES
    f64 = freq.astype(np.uint64)
    c64 = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1].astype(np.int64)
    flat = np.concatenate([*words, np.zeros(1, np.uint32)])
    x = states.copy()
    grid = np.empty((n_blocks, steps, LANES), np.int32)
    for t in range(steps):
        slot = x & _MASK
        s = symbol[slot]
        grid[:, t, :] = s
        x = f64[s] * (x >> _B) + slot - c64[s]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        get = np.minimum(at[:, None] + rank - 1, len(flat) - 1)
        x = np.where(need, (x << _32) | flat[get], x)
        at = at + rank[:, -1]
    if not (x == LOW).all():
        raise ValueError("a block doesn't end in its first state")
    return grid.reshape(n_blocks, block)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, block: int = 1 << 16) -> bytes:
    """ids: every document's tokens, one after another; sizes: tokens of each document."""
    block = max(LANES, min(block, -(-len(ids) // LANES) * LANES))
    seen = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
    symbols = np.flatnonzero(seen)
    freq = frequencies(seen[symbols])
    place = np.zeros(len(seen), np.int32)
    place[symbols] = np.arange(len(symbols))
    states, words = encode_blocks(place[ids], freq, block)
    n_tokens = np.diff(np.minimum(np.arange(len(words) + 1) * block, len(ids)))
    bodies = [w.astype("<u4").tobytes() for w in words]
    directory = np.array([[n, len(w), zlib.crc32(b)] for n, w, b in zip(n_tokens, words, bodies, strict=True)], "<u4")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), sizes.astype("<u4").tobytes(), directory.tobytes(), states.astype("<u8").tobytes(),
    ]
    packed = [zlib.compress(p, 3) for p in parts]
    header = json.dumps({"block": block, "lanes": LANES, "bits": BITS, "tokens": len(ids), "documents": len(doc_ids), "sections": [len(p) for p in packed], "crc32": zlib.crc32(b"".join(packed))}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed, *bodies])


def decode_file(data: bytes, blocks: range | None = None) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, document ids and sizes. blocks: decode these blocks alone (the ids are theirs only)."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4
    h = json.loads(data[at : at + n])
    at += n
    if zlib.crc32(data[at : at + sum(h["sections"])]) != h["crc32"]:
        raise ValueError("the sections' checksum differs")
    parts = []
    for size in h["sections"]:
        parts.append(zlib.decompress(data[at : at + size]))
        at += size
    symbols, freq, known, doc_ids, sizes, directory, states = (np.frombuffer(p, t) for p, t in zip(parts, ("<u4", "<u4", "u1", "<i8", "<u4", "<u4", "<u8"), strict=True))
    directory, states = directory.reshape(-1, 3), states.reshape(-1, h["lanes"])
    offset = at + 4 * np.concatenate([[0], np.cumsum(directory[:, 1].astype(np.int64))])
    which = blocks if blocks is not None else range(len(directory))
    words = []
    for b in which:
        body = data[offset[b] : offset[b + 1]]
        if zlib.crc32(body) != directory[b, 2]:
            raise ValueError(f"block {b}: its checksum differs")
        words.append(np.frombuffer(body, "<u4"))
    grid = decode_blocks(states[list(which)], words, freq, h["block"]) if len(which) else np.zeros((0, h["block"]), np.int32)
    keep = np.arange(h["block"])[None, :] < directory[list(which), 0][:, None]
    return symbols[grid[keep]], [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], sizes.astype(np.int64)
