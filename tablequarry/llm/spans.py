"""Words and their hashes over many texts at once, with numpy."""

import numpy as np

from .bpe import span_hashes
from .common import mixed

#: Separators of the plain word rule: space and the bytes 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def fold() -> np.ndarray:
    """A byte table that makes A-Z lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = fold()


def words(texts: list[bytes], blank: np.ndarray = BLANK, lower: bool = True):
    """Word hashes of all texts in a row, the number of the first word of each text (and the end), raw bytes, word starts and ends."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        raw = LOWER[raw]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = ~blank[raw]
    edge = np.diff(inside, append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(raw, starts, ends), np.searchsorted(starts, begins), raw, starts, ends


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes, by its first word; the last n - 1 places are not runs of n."""
    m = max(len(h) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(h[k : k + m] + np.uint64(k + 1))
    return mixed(out)
