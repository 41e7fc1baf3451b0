"""Words of many texts as 64-bit hashes, worked out with numpy on whole byte
buffers instead of word by word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 4096)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64)
                      for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _segments(texts: Sequence[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of pieces of about SEGMENT bytes, each with the text it starts in;
    a long text is cut at white space."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        while size + len(t) > SEGMENT and len(t) > SEGMENT // 4:
            cut = max(SEGMENT - size, 1)
            while cut < len(t) and not _SPACE[t[cut]]:
                cut += 1
            if cut >= len(t):
                break
            yield first, [*group, t[:cut]]
            first, group, size, t = i, [], 0, t[cut:]
        if not group:
            first = i
        group.append(t)
        size += len(t) + 1
        if size >= SEGMENT:
            yield first, group
            group, size = [], 0
    if group:
        yield first, group


def utf8(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def word_hashes(raw: Sequence[bytes]) -> list[np.ndarray]:
    """For each UTF-8 text the hashes of its words in order; words are runs
    without blanks, tabs and line breaks. Memory beyond the result is a few
    times SEGMENT, or the longest word."""
    parts: list[list[np.ndarray]] = [[] for _ in raw]
    for first, group in _segments(raw):
        data = np.frombuffer(b" ".join([b"", *group, b""]), np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        h = mix((total[ends] - total[starts]) * inverse[starts])
        bounds = np.cumsum([len(g) + 1 for g in group])
        at = np.searchsorted(starts, bounds, side="right")
        for k, piece in enumerate(np.split(h, at[:-1])):
            parts[first + k].append(piece)
    none = np.empty(0, np.uint64)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in parts]


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; fewer words make one run, none none."""
    if len(hashes) == 0:
        return hashes
    m = min(n, len(hashes))
    out = np.full(len(hashes) - m + 1, m, np.uint64)
    for j in range(m):
        out += hashes[j: len(hashes) - m + 1 + j] * _MULTIPLIERS[j]
    return mix(out)
