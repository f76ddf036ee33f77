"""Words, and 64-bit hashes of words and of windows, for whole buffers of text at once."""

from __future__ import annotations

import numpy as np

#: The bytes between words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240917))
#: A random 64-bit value for each byte, and odd multipliers.
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE, BASE2, ODD = (np.uint64(int(x) | 1) for x in _rng.integers(1, 2**64, 3, dtype=np.uint64))

#: Powers that are kept.
LONG = 1 << 20
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        if n <= LONG:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in data, and the number of the first word of each document."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first, last = off[:-1][off[1:] > off[:-1]], off[1:][off[1:] > off[:-1]] - 1
    begin[first] = solid[first]
    end[last] = solid[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


#: Lanes of eight bytes that are hashed at once.
LANES = 1 << 18


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each data[s:e], none of them empty: the mixed sum of its mixed lanes of eight bytes.

    A lane is mixed with its place before it is added, so no arrangement of bytes cancels out (a
    polynomial modulo 2 ** 64 vanishes on Thue-Morse sequences). Memory follows LANES, not the spans.
    """
    length = (e - s).astype(np.int64)
    lanes = length + 7 >> 3
    upto = np.cumsum(lanes)
    out = np.zeros(len(s), np.uint64)
    i = 0
    while i < len(s):
        before = int(upto[i] - lanes[i])
        j = max(i + 1, int(np.searchsorted(upto, before + LANES, "right")))
        for first in range(0, int(lanes[i]) if j == i + 1 else 1, LANES):  # only a span alone has several parts
            out[i:j] += _lane_sums(data, s[i:j] + 8 * first, length[i:j] - 8 * first, first)
        i = j
    return mix(out + length.astype(np.uint64) * ODD)


def place_keys(first: int, last: int) -> np.ndarray:
    """What the lanes first .. last - 1 of a span are mixed with."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * ODD)


#: Those of short spans.
KEYS = place_keys(0, 1 << 10)


def _lane_sums(data: np.ndarray, s: np.ndarray, length: np.ndarray, first: int) -> np.ndarray:
    """Sums of the mixed lanes of data[s : s + length], LANES of a span at most; first: the place of the first."""
    lanes = np.minimum(length + 7 >> 3, LANES)
    lo, hi = int(s.min()), int((s + np.minimum(length, 8 * LANES)).max())
    raw = np.zeros(hi - lo + 8, np.uint8)
    raw[: hi - lo] = data[lo:hi]
    start = np.zeros(len(s), np.int64)
    np.cumsum(lanes[:-1], out=start[1:])
    place = np.arange(int(lanes.sum()), dtype=np.int64)
    place -= np.repeat(start, lanes)
    value = np.ndarray(hi - lo + 1, "<u8", raw, strides=(1,))[np.repeat(s - lo, lanes) + 8 * place]
    last = start + lanes - 1
    beyond = (8 * np.maximum(8 * lanes - length, 0)).astype(np.uint64)  # bits of the last lane after the span
    value[last] = value[last] << beyond >> beyond
    top = int(lanes.max())
    value ^= KEYS[place + first] if first + top <= len(KEYS) else place_keys(first, first + top)[place]
    return np.add.reduceat(mix(value), start)


def window_hashes(h: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each run of size values of h; not mixed. Empty if h is shorter."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, done, step, part, width = None, 0, base, h, 1
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = len(h) - done - width + 1
                out, done = part[:n] + out[width : width + n] * step, done + width
        if done == size:
            return out[: len(h) - size + 1]
        part = part[: len(part) - width] + part[width:] * step
        step, width = np.uint64(int(step) ** 2 % 2**64), width * 2


def prefix_hashes(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gives the hash of any run of h."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each run [a, b), alike for like runs anywhere."""
    return (prefix[b] - prefix[a]) * powers(len(prefix), INVERSE)[a]


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys."""
    if len(key) < width:
        return key[:0]
    part, size = key, 1
    while size * 2 <= width:
        part = np.minimum(part[: len(part) - size], part[size:])
        size *= 2
    return np.minimum(part[: len(key) - width + 1], part[width - size : width - size + len(key) - width + 1])


#: Bits of a place within a segment: reigns() takes fewer than 2 ** PLACE units.
PLACE = 28


def reigns(h: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Runs of window starts that share their least gram, by the window's own content alone.

    h: a value for each unit (byte or word) of some documents one after another, off: where each
    begins. Gives, for every reign, its first and last window start, where its least gram is and
    that gram's hash. Equal windows have their least gram at the same place in them, so two
    documents share a window only if they have reigns with the same gram.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, np.uint64)
    grams = mix(window_hashes(h, gram))
    # a fixed number of bits holds the place, so that ties don't depend on what stands around a window
    bits = np.uint64(PLACE)
    if len(grams) >= 1 << PLACE:
        raise ValueError("cut the units into segments")
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = (window_minima(key, window - gram + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    n = len(h) - window + 1
    valid = np.ones(n, bool)
    for a in off[1:-1]:
        valid[max(0, a - window + 1) : a] = False
    begin, end = valid.copy(), valid.copy()
    same = least[1:] == least[:-1]
    begin[1:] &= ~(valid[:-1] & same)
    end[:-1] &= ~(valid[1:] & same)
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    at = least[s]
    return s, e, at, grams[at]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that some [start, end) cover; runs that touch are one."""
    s, e = np.sort(starts), np.sort(ends)
    if not len(s):
        return s, e
    apart = e[:-1] < s[1:]
    return s[np.concatenate([[True], apart])], e[np.concatenate([apart, [True]])]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in some [start, end)."""
    s, e = union(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
    borders = np.concatenate([[0], np.stack([s, e], 1).ravel(), [n]]).astype(np.int64)
    return np.repeat(np.arange(len(borders) - 1) % 2 == 1, np.diff(borders))


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of first..last (inclusive) of each run, and the run of each."""
    size = last - first + 1
    run = np.repeat(np.arange(len(first)), size)
    start = np.zeros(len(first), np.int64)
    if len(first):
        np.cumsum(size[:-1], out=start[1:])
    return np.arange(int(size.sum())) - start[run] + first[run], run
