"""Words and word shingles as 64-bit hashes, many texts at a time, in numpy.

A word's hash is a polynomial of its UTF-8 bytes (each byte mapped to a random odd-free 64-bit value first), read off
prefix sums, so that it costs a few array operations a byte; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed together; a longer text is cut between words.
CHUNK = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str], lower: bool = True) -> list[np.ndarray]:
    """Of each text, its words' hashes in order; ``lower`` maps A-Z to a-z first."""
    out: list[np.ndarray | None] = [None] * len(texts)
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            hashes, starts = _hash_words(b" ".join(x for _, x in group))
            ends = np.cumsum([len(x) + 1 for _, x in group])
            for (k, _), part in zip(group, np.split(hashes, np.searchsorted(starts, ends)[:-1]), strict=True):
                out[k] = part
            group.clear()
            size = 0

    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if lower:
            data = data.translate(_LOWER)
        if len(data) > CHUNK:
            out[k] = _long(data)
            continue
        if size + len(data) > CHUNK:
            flush()
        group.append((k, data))
        size += len(data) + 1
    flush()
    return [x if x is not None else np.empty(0, np.uint64) for x in out]


def _long(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hash_words(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; of fewer words, the whole sequence as one; of none, none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - k + 1] * _PLACE[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _PLACE[i]
    return mix(total + np.uint64(k))


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(w, k)) for w in word_hashes(texts)]
