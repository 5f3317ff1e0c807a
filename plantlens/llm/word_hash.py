"""64-bit hashes of all words of a text in a few passes of numpy, without an object per word.

Words are read eight bytes at a time, all words at once; the chain of mixing
steps starts from the length, so no two words that differ in a letter or in
length meet but by chance (1 in 2^64). Words over LONG bytes are hashed by
xxhash one by one. ``unlike`` compares the bytes themselves in the same way.
"""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SEED = 0x6C62272E07BB0142
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bits of the first 0 to 8 bytes of a little-endian number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes from every place on as a number; bytes behind the end are 0."""
    return np.ndarray(len(raw) + 1, dtype="<u8", buffer=raw + b"\0" * 8, strides=(1,))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word."""
    edge = np.diff(np.concatenate([[True], SPACE[np.frombuffer(raw, dtype=np.uint8)], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes, lanes = ends - starts, eights(raw)
    hashes = mixed(sizes.astype(np.uint64) * MULTIPLIER + np.uint64(SEED))
    live, k = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - k
        hashes[live] = mixed(hashes[live] ^ (lanes[starts[live] + k] & MASKS[np.minimum(left, 8)])) + MULTIPLIER
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed=SEED)
    return hashes, starts, ends


def unlike(a: bytes, at: np.ndarray, b: bytes, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the words of these sizes differ between their places in ``a`` and in ``b``."""
    out = np.zeros(len(sizes), dtype=bool)
    x, y = eights(a), eights(b)
    live, k = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - k
        apart = ((x[at[live] + k] ^ y[place[live] + k]) & MASKS[np.minimum(left, 8)]) != 0
        out[live[apart]] = True
        live, k = live[(left > 8) & ~apart], k + 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = a[at[i] : at[i] + sizes[i]] != b[place[i] : place[i] + sizes[i]]
    return out


def words_of_each(starts: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Number of words in each of the texts of these sizes, joined by one sign."""
    begins = np.cumsum([0, *(n + 1 for n in sizes[:-1])])
    return np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
