"""Hashed word shingles of whole texts, vectorised over batches.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, a shingle is five of them in a row. A text
with fewer words has its whole word sequence as one shingle; one without words has none.

The distinct words of a batch are hashed one by one to 128 bits (XXH3, seeded); a shingle has two
hashes of 64 bits made of these. Shingles are compared by the first: two different shingles of a
pair of texts are taken for equal with a chance of about 10**-13 for texts of a thousand words. Sets
are named by both, see ``named_sets``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
SEGMENT = 1 << 21
SEED = 20240501

_rng = np.random.default_rng(SEED)
_odd = lambda *n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _odd(2, WIDTH, 2)  # hash of the shingle, place of the word, half of the word's hash
_SHORT = _odd(2, WIDTH + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _segments(space: np.ndarray):
    """Cuts at white space, about SEGMENT bytes apart; a longer word stays whole."""
    n, start = len(space), 0
    while start < n:
        end = min(n, start + SEGMENT)
        if end < n and not space[end - 1]:
            back = np.flatnonzero(space[start:end])
            if len(back):
                end = start + int(back[-1]) + 1
            else:
                ahead = end
                while ahead < n and not space[ahead]:
                    hit = np.flatnonzero(space[ahead : ahead + SEGMENT])
                    ahead = ahead + int(hit[0]) if len(hit) else min(n, ahead + SEGMENT)
                    if len(hit):
                        break
                end = ahead
        yield start, end
        start = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words x 2 halves of a 128-bit hash, byte offset) of every word of UTF-8 ``data``."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    space = _SPACE[raw]
    hashes, starts = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)]
    digest = xxhash.xxh3_128_digest
    for s, e in _segments(space):
        inside = ~space[s:e]
        first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if not len(first):
            continue
        kept = raw[s:e][inside]
        offsets = np.append((np.cumsum(inside) - 1)[first], len(kept))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        known = np.frombuffer(b"".join([digest(w, SEED) for w in words.dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
        hashes.append(known[words.indices.to_numpy()])
        starts.append(first + s)
    return np.concatenate(hashes), np.concatenate(starts)


def _run_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    runs = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        part = words[k : k + len(runs)]
        runs += part[:, 0] * places[k, 0] + part[:, 1] * places[k, 1]
    return mix(runs)


def _hashes(texts: list, kinds: int) -> list[tuple[np.ndarray, ...]]:
    """For each text the first ``kinds`` hashes of its shingles in text order, repeats included."""
    parts, ends, size = [], [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        parts.append(data)
        size += len(data) + 1
        ends.append(size)
    words, at = word_hashes(b" ".join(parts) + b" ")
    upto = np.searchsorted(at, ends).tolist()
    runs = [_run_hashes(words, _PLACE[k]) for k in range(kinds)]
    none = (np.empty(0, np.uint64),) * kinds
    out, start = [], 0
    for end in upto:
        count = end - start
        if count >= WIDTH:
            out.append(tuple(r[start : end - WIDTH + 1] for r in runs))
        elif count:
            here = words[start:end]
            out.append(tuple(mix((here * _PLACE[k, :count]).sum(dtype=np.uint64, keepdims=True)[0] + _SHORT[k, count : count + 1]) for k in range(kinds)))
        else:
            out.append(none)
        start = end
    return out


def shingle_hashes(texts: list) -> list[np.ndarray]:
    """For each text the hashes of its shingles in text order, repeats included; null is empty."""
    return [x[0] for x in _hashes(texts, 1)]


def shingle_sets(texts: list) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    return [np.unique(x) for x in shingle_hashes(texts)]


def named_sets(texts: list) -> list[tuple[np.ndarray, int | None, int | None]]:
    """For each text its distinct shingle hashes, ascending, and two signed 64-bit names of the set.

    The second name is made of the shingles' second hashes, so different sets share both names with a
    chance of 2**-128. Empty sets have no names.
    """
    out = []
    for one, two in _hashes(texts, 2):
        if not len(one):
            out.append((one, None, None))
            continue
        order = np.argsort(one)
        one, two = one[order], two[order]
        fresh = np.ones(len(one), bool)
        fresh[1:] = one[1:] != one[:-1]
        one, two = one[fresh], two[fresh]
        names = [int(mix(mix(x + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))).view(np.int64)[0]) for x in (one, two)]
        out.append((one, *names))
    return out
