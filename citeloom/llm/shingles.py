"""Distinct word shingles of texts as sorted 64-bit hashes, computed without a loop over words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
_BYTE = np.frombuffer(b"".join(blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8").copy()
#: Words that are hashed together; longer texts are taken in runs of so many, with an overlap.
RUN = 50_000
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers["up"]) < n:
        have = len(_powers["up"])
        for name, base in (("up", _BASE), ("down", _UNDO)):
            _powers[name] = np.concatenate([_powers[name], _powers[name] * np.uint64(pow(base, have, 1 << 64))])
    return _powers["up"][:n], _powers["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A polynomial hash over random byte values of each run of `width` words, by differences of prefix sums."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    up, down = _powers_to(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=sums[1:])
    ends = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return _mix((sums[ends[width - 1 :]] - sums[starts[:n]]) * down[starts[:n]])


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: A-Z in lower case, words parted by ASCII white space.

    A text of fewer words than `width` has one shingle, all its words; a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    parts = [_run_hashes(words[i : i + RUN + width - 1], width) for i in range(0, len(words) - width + 1, RUN)]
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))
