"""Word shingles as sorted sets of 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from leadlens.llm.common import mix64, word_hashes, words_of

WIDTH = 5
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; of a shorter text,
    the hash of all its words; of a text without words, nothing."""
    data, starts, ends, first = words_of([(t or "").encode() for t in texts])
    h = word_hashes(data, starts, ends)
    n = len(h) - width + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        runs = runs * _STEP + h[j:j + n]
    runs = mix64(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(runs[a:b - width + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in h[a:b]:
                whole = whole * _STEP + x
            yield mix64(whole + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    total = int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(s) * 0x2545F4914F6CDD1D
    return int(mix64(np.array([total % (1 << 64)], np.uint64)).view(np.int64)[0])
