"""Vectorised word and shingle hashing over Arrow string columns.

Texts are read as the bytes of the Arrow buffer, a quarter of a MB at a time (working arrays take some
50 bytes a byte of text); a word is a run of bytes that
the class table does not mark as a separator. Hashes are 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
LONG_RUN = 1 << 10
_BASE = U64(0x9E3779B97F4A7C55)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, dtype=U64), dtype=U64)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)  #: the lowest k bytes of a word of eight
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)


def byte_classes(separators: bytes | None = None, letters_only: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(folded byte, is separator) for each byte value. letters_only: all but ASCII letters and bytes of multi-byte characters separate."""
    folded = np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
    sep = np.zeros(256, dtype=bool)
    if letters_only:
        sep[:128] = True
        sep[65:91] = sep[97:123] = False
    else:
        sep[list(separators or b" \t\n\x0b\x0c\r")] = True
    return folded, sep


WHITESPACE_FOLDED = byte_classes()
WHITESPACE_RAW = byte_classes(fold=False)
LETTERS_FOLDED = byte_classes(letters_only=True)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes: eight bytes at a time, each block mixed into what came before, so that no two runs share a hash by their structure. Runs over LONG_RUN bytes one by one."""
    eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(lens.astype(U64) + U64(seed) * _BASE + _BASE)
    for i in np.flatnonzero(lens > LONG_RUN):
        h[i] = U64(int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lens[i]].tobytes(), digest_size=8, person=str(seed).encode()).digest(), "little"))
    at, k = np.flatnonzero((lens > 0) & (lens <= LONG_RUN)), 0
    while len(at):
        left = np.minimum(lens[at] - k, 8)
        h[at] = mix(h[at] * _STEP[1] + (eight[starts[at] + k] & _LOW[left]))
        k += 8
        at = at[lens[at] > k]
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE, dtype=U64), dtype=U64)
    return _POWERS


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_chunks(texts: pa.Array, classes: tuple[np.ndarray, np.ndarray] = WHITESPACE_FOLDED, chunk_bytes: int = CHUNK_BYTES, folded: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first doc, end doc, word hashes, offsets into them by doc) for runs of whole documents of about chunk_bytes. folded: hashes by `fold`."""
    data, off = string_buffers(texts)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + chunk_bytes, side="right")) - 1)
        b = min(b, n)
        hashes, word_off = hash_words(data[off[a] : off[b]], off[a : b + 1] - off[a], classes, folded)
        yield a, b, hashes, word_off
        a = b


def hash_words(data: np.ndarray, off: np.ndarray, classes: tuple[np.ndarray, np.ndarray], by_fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    folded, sep = classes
    keep = ~sep[data]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.empty(0, U64), np.zeros(len(off), np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    edge = np.searchsorted(at, off[1:-1])  # a document's first byte begins a word
    first[edge[edge < len(at)]] = True
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(at)))
    word_off = np.searchsorted(at[starts], off)
    if by_fold:
        return fold(folded[data], at[starts], lens), word_off
    place = np.arange(len(at)) - np.repeat(starts, lens)
    term = (folded[data[at]].astype(U64) + U64(1)) * _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(term, starts) + lens.astype(U64)), word_off


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64): of width words, of all words if fewer, none without words."""
    for a, b, words, off in word_chunks(texts, folded=True):
        full = np.zeros(len(words), dtype=U64)
        m = len(words) - width + 1
        if m > 0:
            acc = np.zeros(m, dtype=U64)
            for j in range(width):
                acc += words[j : j + m] * _STEP[j % len(_STEP)] + (acc << U64(7)) * U64(j > 0)
            full[:m] = mix(acc)
        for d in range(b - a):
            s, e = off[d], off[d + 1]
            k = e - s
            if k == 0:
                yield np.empty(0, U64)
            elif k < width:
                acc = U64(k)
                with np.errstate(over="ignore"):
                    for w in words[s:e]:
                        acc = acc * _STEP[0] + w
                yield mix(np.array([acc]))
            else:
                x = np.sort(full[s : e - width + 1])
                yield x[np.append(True, x[1:] != x[:-1])]
