"""Words of whole Arrow string arrays as 64-bit hashes, and rolling hashes over them, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from quernel.llm.common import per_process

#: Bytes that are hashed at once; longer texts go in pieces cut at white space where there is any.
PIECE = 1 << 19
#: Words of more bytes get a cryptographic digest.
LONG = 128

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(977)
_BYTE = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64)
_WORD_BASE = 0x9E6C63D0876A9A47


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2^64."""
    tables = per_process()
    have = tables.get(("powers", base))
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = tables["powers", base] = tuple(both)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length) of each word of `data`; no word crosses a position of `breaks`."""
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _powers(_WORD_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    for k in np.flatnonzero(end - start > LONG).tolist():  # polynomials modulo 2^64 have colliding strings of 2^10 bytes
        h[k] = int.from_bytes(blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h, start, end - start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text where its words start (one entry more at the end).

    data: the texts' bytes end to end. offsets: where each text starts, and the end.
    """
    return hashes_and_lengths(data, offsets)[:2]


def hashes_and_lengths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), and the length of each word in bytes.

    data: the texts' bytes end to end. offsets: where each text starts, and the end.
    """
    hashes, starts, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):
            space = np.flatnonzero(_SPACE[data[at:to]])
            cuts = offsets[(offsets > at) & (offsets <= to)]
            to = max(at + int(space[-1]) + 1 if len(space) else 0, int(cuts[-1]) if len(cuts) else 0)
            if to == 0:  # a word longer than a piece: up to its end
                nxt = np.flatnonzero(_SPACE[data[at:]])
                ends = offsets[offsets > at]
                to = min(at + int(nxt[0]) + 1 if len(nxt) else len(data), int(ends[0]) if len(ends) else len(data))
        h, s, n = _piece(data[at:to], offsets - at)
        hashes.append(h)
        sizes.append(n)
        starts.append(s + at)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets), np.concatenate(sizes)


def slices(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with about `most` bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every run of `width` entries of h; base: odd."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` entries, by doubling."""
    if len(h) < width:
        return h[:0]
    low, have = h, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(h) - width + 1], low[rest : rest + len(h) - width + 1])
