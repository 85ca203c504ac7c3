"""Words and windows of many texts at once, as NumPy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

ODD = (0x9E6D62D06F6A9A9B, 0xD6E8FEB86659FD93)
STEP = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
#: ASCII white space, which alone parts words of the class [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns everything outside [0-9a-z\x80-] into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Powers of a base that a worker keeps; more are made when needed.
MOST_POWERS = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        got = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= MOST_POWERS:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashed(buffer: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a buffer that begins and ends with white space."""
    word = ~SPACE[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = powers(ODD[lane], len(buffer))
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def words(texts: list[bytes], lane: int = 0, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (len(texts) + 1 places).

    A text longer than piece is hashed in pieces cut at white space, so that memory stays bounded by its words.
    """
    if len(texts) == 1 and len(texts[0]) > piece:
        text, parts, at = texts[0], [], 0
        while at < len(text):
            end = min(len(text), at + piece)
            while end < len(text) and not SPACE[text[end]]:
                end += 1
            parts.append(_hashed(np.frombuffer(b" " + text[at:end] + b" ", np.uint8), lane)[0])
            at = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    hashes, starts = _hashed(np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8), lane)
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, first)


def windows(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every k consecutive words; those that cross texts are there too (see inside)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(STEP[lane], len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n window starts lie with all their k words in one text."""
    ok = np.ones(n, bool)
    for t in range(1, k):
        at = bounds[1:-1] - t
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def covered(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a window [start, start + k)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:-1]) > 0
