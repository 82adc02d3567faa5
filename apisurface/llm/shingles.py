"""Word shingles of texts as arrays of 64-bit hashes, for all words at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from apisurface.llm.hashing import U64, mix

#: Separators are the blank and the bytes 9 to 13; A-Z count as a-z.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A") : ord("Z") + 1] += 32
#: Bytes whose words are found at a time; a piece ends at a separator if it can.
PIECE = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64
#: The lowest bytes of a word of eight.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)
SEED = U64(0xD6E8FEB86659FD93)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    start = 0
    while len(raw) - start > PIECE:
        end = start + PIECE
        cuts = np.flatnonzero(SEPARATOR[raw[start:end]])
        # A word longer than a piece makes its piece grow to its end.
        while not len(cuts) and end < len(raw):
            end = min(end + PIECE, len(raw))
            cuts = np.flatnonzero(SEPARATOR[raw[start:end]])
        if not len(cuts):
            break
        yield raw[start : start + int(cuts[-1]) + 1]
        start += int(cuts[-1]) + 1
    yield raw[start:]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word of bytes already folded: eight bytes at a time, each stirred in before the next comes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SEPARATOR[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.arange(8)
    out = mix(size.astype(U64) + SEED)
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        told = np.ascontiguousarray(padded[start[live, None] + at + eight]).view("<u8").ravel() & LOW_BYTES[left]
        out[live] = mix(mix(out[live]) + told)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        word = raw[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of all stretches of ``words`` words; of the whole sequence if it is shorter; none without words."""
    raw = FOLDED[np.frombuffer(data, np.uint8)]
    tokens = np.concatenate([word_hashes(piece) for piece in _pieces(raw)])
    if not len(tokens):
        return np.zeros(0, U64)
    n = min(words, len(tokens))
    rows = len(tokens) - n + 1
    out = np.full(rows, n, U64)
    for i in range(n):
        out = mix(out + tokens[i : i + rows])
    return np.unique(out)
