"""Hashes of words and word shingles of many texts at once, as vectors."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_WORDS = bytes((b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32) for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240607))
_LETTER = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


class Shingled:
    """Words and shingles of a list of texts; `doc` and `hash` hold a row for each shingle, in order, repeats included.

    Words are runs of letters, digits and anything beyond ASCII, in lower case. A text of one to four words
    has one shingle, of all its words.
    """

    def __init__(self, texts: list) -> None:
        parts = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS) for t in texts]
        n = len(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
        raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8) if n else np.zeros(0, np.uint8)
        up, down = powers(len(raw) + 1)
        inside = raw != 32
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * up[: len(raw)])])
        word = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        owner = np.searchsorted(ends, first, "right")
        self.words = np.bincount(owner, minlength=n)
        begin = np.cumsum(self.words) - self.words
        local = np.arange(len(word)) - begin[owner]
        # Two hashes of the word sequence.
        self.sequence = []
        for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
            x = mix(word + salt) * powers(len(word) + 1)[0][local]
            sums = np.zeros(n, np.uint64)
            some = np.flatnonzero(self.words)
            if len(some):
                sums[some] = np.add.reduceat(x, begin[some])
            self.sequence.append(mix(sums + self.words.astype(np.uint64)).astype(np.int64))
        m = len(word) - SHINGLE + 1
        if m > 0:
            h = word[:m] * _PLACE[0]
            for k in range(1, SHINGLE):
                h = h + word[k : k + m] * _PLACE[k]
            whole = owner[:m] == owner[SHINGLE - 1 :]
            doc, value = owner[:m][whole], h[whole]
        else:
            doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = np.flatnonzero((self.words > 0) & (self.words < SHINGLE))
        if len(short):
            doc = np.concatenate([doc, short])
            value = np.concatenate([value, self.sequence[0][short].astype(np.uint64)])
            order = np.argsort(doc, kind="stable")
            doc, value = doc[order], value[order]
        self.doc, self.hash = doc, mix(value)

    def sets(self) -> list[np.ndarray]:
        """The sorted distinct shingles of each text."""
        cuts = np.searchsorted(self.doc, np.arange(len(self.words) + 1))
        return [np.unique(self.hash[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
