"""Content-defined anchors: which 100-byte strings can repeat at all.

Every window of ``MATCH`` bytes owns one anchor, the k-gram of least hash inside
it (the rightmost of equals).  Equal windows own anchors of equal hash at equal
offsets, so two windows can only be equal inside one anchor group.  Neighbouring
windows that own the same anchor form a *run*; runs of equal content are equal
window by window.
"""

from __future__ import annotations

import numpy as np

MATCH = 100
GRAM = 24
_WIN = MATCH - GRAM + 1
_POS_BITS = 20
#: Windows handled at once; positions inside a block fit ``_POS_BITS``.
BLOCK = 1 << 17
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow = {"n": 0, "up": None, "down": None}


def _powers(n: int):
    if _pow["n"] < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        for name, b in (("up", _BASE), ("down", _BINV)):
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            _pow[name] = np.multiply.accumulate(out)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """P with (P[j] - P[i]) * base**-i... comparable for equal substrings."""
    n = len(b)
    up, _ = _powers(n + 1)
    p = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * up[:n], out=p[1:])
    return p


def span_hash(p: np.ndarray, start, stop) -> np.ndarray:
    """Mixed 64-bit hash of the bytes [start, stop) for arrays of spans."""
    _, down = _powers(len(p))
    return mix((p[stop] - p[start]) * down[start])


def runs(b: np.ndarray, ends: np.ndarray):
    """Runs of texts laid end to end: (first window, number of windows, distance from
    first window to anchor, anchor hash, content hash), positions in the joined array.

    ends: the exclusive end of each text.  No window crosses one.
    """
    n = len(b)
    if n < MATCH:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    p = prefix_sums(b)
    _, down = _powers(n + 1)
    g = n - GRAM + 1
    h = mix((p[GRAM:] - p[:g]) * down[:g])
    mask = np.uint64((1 << _POS_BITS) - 1)
    v = (h & ~mask) | (mask - np.arange(g, dtype=np.uint64))
    m, span = v, 1
    while span * 2 <= _WIN:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    rest = _WIN - span
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    begins = np.concatenate(([0], ends[:-1]))
    # a text's windows end MATCH bytes before its end; cuts mark where a run must stop
    stop = np.zeros(n + 1, np.int32)
    long = ends - begins >= MATCH
    np.add.at(stop, begins[long], 1)
    np.add.at(stop, ends[long] - MATCH + 1, -1)
    inside = np.cumsum(stop[: len(m)]) > 0
    new = np.concatenate(([True], m[1:] != m[:-1]))
    new[begins[begins < len(m)]] = True
    gap = np.flatnonzero(~inside)
    new[gap] = True
    after = gap + 1
    new[after[after < len(m)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(m)])))
    keep = inside[first]
    first, size = first[keep], size[keep]
    own = m[first]
    lead = (mask - (own & mask)).astype(np.int64) - first
    content = span_hash(p, first, first + size + MATCH - 1)
    content = mix(content + lead.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + size.astype(np.uint64))
    return first, size, lead, own >> np.uint64(_POS_BITS), content


def blocks(n: int):
    """(offset, length) of the blocks whose windows partition those of n bytes."""
    at = 0
    while n - at >= MATCH:
        size = min(n - at, BLOCK + MATCH - 1)
        yield at, size
        at += size - MATCH + 1
