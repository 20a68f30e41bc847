"""Vectorised words and word hashing over whole batches of texts (numpy; no loop per short word).

Hashes find candidates and choose where rows meet; what counts as equal is decided on the words themselves, by
``same_windows`` and ``shingle_overlap``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER.tobytes()

#: Seeds of the hash lanes.
SEEDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: The bytes of a word that count in its first and second eight bytes.
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    t = x >> np.uint64(30)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint64(_MIX[0]), out=x)
    np.right_shift(x, np.uint64(27), out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint64(_MIX[1]), out=x)
    np.right_shift(x, np.uint64(31), out=t)
    np.bitwise_xor(x, t, out=x)
    return x


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, the n + 1 offsets of the texts' words among them, and the bytes read
    (A-Z lowered if asked for)."""
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    first = solid[1:] & ~solid[:-1]  # of n + 1 places
    last = solid[:-1] & ~solid[1:]  # a word ends before this place
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):  # words don't go on over the end of a text
        touch = inner[solid[inner + 1] & solid[inner]]
        first[touch] = True
        last[touch] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, off), data


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: of its bytes as numbers up to 16 of them, of longer ones by xxh3."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = eight[starts] & _PART[np.minimum(size, 8)]
    h ^= np.uint64(SEEDS[lane])
    mix(h)
    more = np.flatnonzero(size > 8)
    if len(more):
        h[more] ^= (eight[starts[more] + 8] & _PART[np.minimum(size[more] - 8, 8)]) * np.uint64(_STEP[lane])
    h += size.astype(np.uint64)
    mix(h)
    long = np.flatnonzero(size > 16)
    if len(long):
        raw, seed = memoryview(padded), SEEDS[lane]
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A mixed hash of every k words in a row (n - k + 1 of them), over text borders too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_STEP[lane])
        out += h[j : j + n]
    return mix(out)


def whole(h: np.ndarray, lane: int = 0) -> np.uint64:
    """The hash of a sequence shorter than a window."""
    out = np.array([0x5BD1E995 + len(h)], dtype=np.uint64)
    for x in h:
        out *= np.uint64(_STEP[lane])
        out += x
    return mix(out)[0]


def inside(word_off: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each window place, if it lies within one text."""
    ok = np.ones(max(0, total - k + 1), dtype=bool)
    for b in range(1, k):
        at = word_off[1:-1] - b
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All the places of some ranges, one range after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, equal just where the words' bytes are equal."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    raw = np.ascontiguousarray(data[ranges(starts, size)])
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(raw)])
    return column.dictionary_encode().indices.to_numpy()


def same_windows(key: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``k`` words from places ``at`` of ``ids`` on, grouped by their words: an order of them, and where in it
    a new group begins.  ``key`` is a hash of each that makes the sort cheap; it decides nothing."""
    order = np.argsort(key, kind="stable")
    new = _unlike(at[order], ids, k)
    if (new[1:] & (key[order][1:] == key[order][:-1])).any():  # unlike windows of one key: sort by the words
        order = np.lexsort([ids[at + j] for j in reversed(range(k))])
        new = _unlike(at[order], ids, k)
    return order, new


def _unlike(at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    for j in range(k):
        part = ids[at + j]
        new[1:] |= part[1:] != part[:-1]
    return new


def shingle_overlap(a: list[bytes], b: list[bytes], k: int) -> tuple[int, int, int]:
    """Sizes of two texts' shingle sets and of their intersection, from their words, compared as words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in (*a, *b)], dtype=np.int64)
    if len(a) < k or len(b) < k:  # a sequence shorter than a window is a shingle of its own and like no window
        same = int(bool(a) and a == b)
        return _count(ids[: len(a)], k), _count(ids[len(a) :], k), same
    key = _packed(ids, k, len(known))
    mine, other = np.unique(key[: len(a) - k + 1]), np.unique(key[len(a) :])
    return len(mine), len(other), len(np.intersect1d(mine, other, assume_unique=True))


def shingle_count(words_: list[bytes], k: int) -> int:
    """The size of a text's shingle set."""
    known: dict[bytes, int] = {}
    return _count(np.array([known.setdefault(w, len(known)) for w in words_], dtype=np.int64), k)


def _count(ids: np.ndarray, k: int) -> int:
    return len(np.unique(_packed(ids, k, int(ids.max()) + 1))) if len(ids) >= k else min(len(ids), 1)


def _packed(ids: np.ndarray, k: int, known: int) -> np.ndarray:
    """One number for every window of k ids, equal just where the ids are equal."""
    n, size = len(ids) - k + 1, known
    key = ids[:n]
    for j in range(1, k):
        if size * known >= 1 << 62:  # too large for a product: numbers by rank, of which there are n at most
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * known + ids[j : j + n]
        size *= known
    return key
