"""Tokens of whole Arrow string columns as 64-bit hashes, without a Python object per token.

A token's hash is a polynomial in its bytes, taken from one prefix sum over the column's
buffer.  It depends on the token alone, so hashes agree between batches, tasks and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.core.runtime import process_cache

_P = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes hashed in one go, but for longer single strings.
_STRIDE = 1 << 21

#: Byte classes: 0 separates tokens, any other value stands for the byte.
WORDS = np.zeros(256, np.uint8)
WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
SPACED = np.arange(256).astype(np.uint8)
SPACED[[9, 10, 11, 12, 13, 32]] = 0
SPACED[48:58] = 35


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = process_cache().get("powers")
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        a, b = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
        a[0] = b[0] = 1
        have = process_cache()["powers"] = (np.cumprod(a), np.cumprod(b))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array without nulls."""
    n = len(strings)
    off = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8).copy() if n else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def token_hashes(strings: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, owner)`` of all tokens in order; ``owner`` is the index of the string."""
    raw, off = buffers(strings)
    if len(raw) > _STRIDE and len(strings) > 1:
        half = len(strings) // 2
        (h1, o1), (h2, o2) = token_hashes(strings.slice(0, half), classes), token_hashes(strings.slice(half), classes)
        return np.concatenate([h1, h2]), np.concatenate([o1, o2 + half])
    m = classes[raw]
    n = len(m)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = m != 0
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1] | first[1:n]
    end[:-1] &= ~w[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    up, down = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(m * up[:n], out=total[1:])
    h = mix((total[e + 1] - total[s]) * down[s])
    owner = np.searchsorted(off, s, side="right") - 1
    return h, owner


def hash_of(token: str, classes: np.ndarray) -> int:
    h, _ = token_hashes(pa.array([token], pa.large_string()), classes)
    return int(h[0]) if len(h) else 0


def lower_words(strings: pa.Array) -> pa.Array:
    """Lower case; in strings beyond ASCII all but letters and digits becomes a space.

    Afterwards the byte classes ``WORDS`` split every script alike.
    """
    t = pc.utf8_lower(strings)
    plain = pc.string_is_ascii(t)
    if pc.all(plain).as_py() in (True, None):
        return t
    odd = pc.invert(plain)
    return pc.replace_with_mask(t, odd, pc.replace_substring_regex(t.filter(odd), r"[^\p{L}\p{N}]+", " "))


def shingle_sets(strings: pa.Array, page: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles per page as 32-bit hashes: ``(page, hash)`` sorted by both.

    ``strings`` are pieces of pages in order, ``page`` (ascending, below 2**31) says whose;
    shingles run on over the pieces of one page.  Pages with fewer words have none.
    """
    h, owner = token_hashes(lower_words(strings), WORDS)
    p = page[owner] if len(owner) else np.zeros(0, np.int64)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    g = h[:n].copy()
    for i in range(1, width):
        g = g * np.uint64(_P) + h[i : n + i]
    g = mix(g)
    ok = p[:n] == p[width - 1 :]
    key = (p[:n][ok].astype(np.uint64) << np.uint64(32)) | (g[ok] >> np.uint64(32))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
