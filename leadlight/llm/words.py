"""Words of many texts at once, by their hashes.

Words are what stands between ASCII white space, A-Z lower case. Their hashes have 64 bits: of a billion different words
two share one with a probability of 3 %.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Bytes of text hashed at a time; words of half a window or more are hashed by themselves.
WINDOW = 1 << 18
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.default_rng(7_393_913)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_white = re.compile(rb"[\t-\r ]")
#: A random number for each byte, the same for both cases of a letter, none for white space; words are polynomials of them.
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_LETTER = np.where(_SPACE, np.uint64(0), _LETTER[np.frombuffer(LOWER, np.uint8)])
#: What a byte says of its word: 1 a digit, 2 no ASCII, 4 another sign.
_SAYS = np.zeros(256, np.uint8)
_SAYS[33:128], _SAYS[128:], _SAYS[48:58] = 4, 2, 1
_SAYS[[*range(65, 91), *range(97, 123)]] = 0
_BASE = 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    of = np.full(WINDOW, base, np.uint64)
    of[0] = 1
    return np.multiply.accumulate(of)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and its hash; ``blob`` ends with white space."""
    raw = np.frombuffer(blob, np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0

    def alone(start: int, end: int) -> np.uint64:
        return np.uint64(xxhash.xxh3_64_intdigest(blob[start:end].translate(LOWER)))

    while at < len(raw):
        part = raw[at : at + WINDOW]
        space = _SPACE[part]
        gap = space[::-1].argmax()
        end = len(part) - int(gap) if space[len(part) - 1 - gap] else 0
        before = np.concatenate([[True], space[: end - 1]]) if end else np.zeros(0, bool)
        space = space[:end]
        first, last = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
        total = np.zeros(end + 1, np.uint64)
        np.cumsum(_LETTER[part[:end]] * _POWER[:end], out=total[1:])
        found = mix((total[last] - total[first]) * _INVERSE[first])
        for i in np.flatnonzero(last - first >= WINDOW // 2):
            found[i] = alone(at + int(first[i]), at + int(last[i]))
        starts.append(first + at)
        hashes.append(found)
        at += end
        if end <= WINDOW // 2 and at < len(raw):  # a word of half a window or more follows
            stop = _white.search(blob, at).start()
            if stop > at:
                starts.append(np.array([at]))
                hashes.append(np.array([alone(at, stop)], np.uint64) if stop - at >= WINDOW // 2 else word_hashes(blob[at : stop + 1])[1])
            at = stop + 1
    return np.concatenate(starts), np.concatenate(hashes)


SHAPES = 4


def word_shapes(blob: bytes, starts: np.ndarray) -> np.ndarray:
    """The shape of each word: 0 ASCII letters only, 1 with a digit, else 2 with a letter beyond ASCII, else 3 with other signs."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    said = np.bitwise_or.reduceat(_SAYS[np.frombuffer(blob, np.uint8)], starts)
    return np.array([0, 1, 2, 1, 3, 1, 2, 1], np.uint8)[said]
