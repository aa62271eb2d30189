"""Word hashes of whole text columns with numpy: no Python loop over characters or words.

Words are hashed by a polynomial over a table of random 64-bit letters, modulo 2**64, from one
running sum per block of bytes. A block ends at white space or at the end of a document, so memory
follows the block and not the longest document, unless one word is longer than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_R = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(20240521).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block(b: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block; firsts: where documents begin in it."""
    b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    before = np.empty(len(b), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[firsts] = True
    after = np.empty(len(b), bool)
    after[-1] = True
    after[:-1] = space[1:]
    lasts = firsts[firsts > 0] - 1
    after[lasts] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after)
    up, down = _powers(len(b))
    total = np.cumsum(_LETTERS[b] * up[: len(b)], dtype=np.uint64)
    below = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends] - below) * down[starts] ^ (ends - starts + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """(from, to) of blocks that end at white space or between documents."""
    s, n = 0, len(data)
    while s < n:
        e = min(n, s + BLOCK)
        if e < n:
            at = offsets[np.searchsorted(offsets, e, "right") - 1]
            piece = data[s:e]
            gaps = np.flatnonzero((piece[-4096:] == 32) | ((piece[-4096:] >= 9) & (piece[-4096:] <= 13)))
            if at > s:
                e = int(at)
            elif len(gaps):
                e = e - min(4096, len(piece)) + int(gaps[-1]) + 1
            else:
                nxt = int(offsets[np.searchsorted(offsets, e, "left")])
                while e < nxt and not (data[e] == 32 or 9 <= data[e] <= 13):
                    piece = data[e : min(nxt, e + 65536)]
                    gaps = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
                    e = e + int(gaps[0]) if len(gaps) else e + len(piece)
        yield s, e
        s = e


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words in order, and the offsets of each text among them."""
    data, offsets = buffers(texts)
    hashes, starts = [], []
    for s, e in _blocks(data, offsets):
        firsts = offsets[np.searchsorted(offsets, s, "left") : np.searchsorted(offsets, e, "left")] - s
        h, at = _block(data[s:e], firsts)
        hashes.append(h)
        starts.append(at + s)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h, at = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(at, offsets, "left")


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch whose texts hold about limit bytes each; one longer text is a part of its own."""
    sizes = np.diff(buffers(batch.column(batch.schema.get_field_index(column)))[1])
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, "right")))
        yield batch.slice(at, n)
        at += n
