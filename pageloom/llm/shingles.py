"""Five-word shingles of texts in numpy, for whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_U64 = np.uint64
_BYTE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_WORD = _U64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BYTE**i and its inverse for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BYTE), ("down", pow(_BYTE, -1, 1 << 64))):
            out = np.ones(size, _U64)
            filled = 1
            while filled < size:  # by doubling
                out[filled : 2 * filled] = out[:filled] * _U64(pow(base, filled, 1 << 64))
                filled *= 2
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the whitespace-separated words of all texts, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
    inner = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inner[:-1]
    cut = offsets[1:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inner & ~before)
    last = np.zeros(n, bool)
    last[:-1] = ~inner[1:]
    last[-1] = True
    ends_of_text = offsets[1:] - 1
    last[ends_of_text[ends_of_text >= 0]] = True
    ends = np.flatnonzero(inner & last)
    up, down = _powers(n)
    sums = np.cumsum(_BYTE_VALUES[data] * up)
    first = np.where(starts > 0, sums[starts - 1], _U64(0))
    hashes = mix((sums[ends] - first) * down[starts] + (ends - starts + 1).astype(_U64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of every shingle; a text of one to four words is one shingle."""
    n_words = np.diff(offsets)
    of_word = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(offsets[1:], n_words) - np.arange(len(words))
    whole = np.flatnonzero(left >= WORDS)
    hashes = np.zeros(len(whole), _U64)
    for k in range(WORDS):
        hashes = hashes * _WORD + words[whole + k]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    at = offsets[short]
    little = np.zeros(len(short), _U64)
    for k in range(WORDS - 1):
        held = n_words[short] > k
        little = np.where(held, little * _WORD + words[np.minimum(at + k, max(len(words) - 1, 0))], little) if len(words) else little
    text = np.concatenate((of_word[whole], short))
    first = np.concatenate((whole, at))
    return text, first, mix(np.concatenate((hashes, little)))
