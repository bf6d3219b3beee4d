"""xxh32 (seed 0) of very many words at a time: the same values as the library's, which takes one word a call."""

from __future__ import annotations

import re

import numpy as np

U = np.uint32
P1, P2, P3, P4, P5 = (U(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
LANES = (606290984, 2246822519, 0, 1640531535)
NEVER = "\n"


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return x << U(k) | x >> U(32 - k)


def xxh32(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each ``begin`` to its ``end``; three more bytes follow the last one in ``raw``."""
    four = np.ndarray(max(0, len(raw) - 3), "<u4", raw, strides=(1,))
    at, size = begin.copy(), end - begin
    out = size.astype(U) + P5
    long = np.flatnonzero(size >= 16)
    if len(long):
        lanes = [np.full(len(long), x, U) for x in LANES]
        own, place, stop = np.arange(len(long)), begin[long], end[long]
        while len(own):
            for lane in lanes:
                lane[own] = _rotated(lane[own] + four[place[own]] * P2, 13) * P1
                place[own] += 4
            own = own[stop[own] - place[own] >= 16]
        out[long] = sum((_rotated(lane, k) for lane, k in zip(lanes, (1, 7, 12, 18), strict=True)), size[long].astype(U))
        at[long] = place
    own = np.flatnonzero(end - at >= 4)
    while len(own):
        out[own] = _rotated(out[own] + four[at[own]] * P3, 17) * P4
        at[own] += 4
        own = own[end[own] - at[own] >= 4]
    own = np.flatnonzero(end > at)
    while len(own):
        out[own] = _rotated(out[own] + raw[at[own]] * P5, 11) * P1
        at[own] += 1
        own = own[end[own] > at[own]]
    out = (out ^ out >> U(15)) * P2
    out = (out ^ out >> U(13)) * P3
    return out ^ out >> U(16)


def signs_of(word: re.Pattern) -> np.ndarray:
    """Whether each code point belongs to words, which ``word`` takes as runs of one class of signs."""
    out = np.zeros(0x110000, bool)
    for m in word.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def hashes_of(texts: list[str], signs: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's words (runs of ``signs``, as UTF-8); a line end belongs to no word."""
    joined = NEVER + NEVER.join(texts) + NEVER * 4
    points = np.frombuffer(joined.encode("utf-32-le"), U)
    own = signs.take(points)
    edges = np.flatnonzero(own[1:] != own[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    cuts = np.searchsorted(begin, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    raw = np.frombuffer(joined.encode(), np.uint8)
    if len(raw) != len(points):
        place = np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)
        begin, end = place[begin - 1], place[end - 1]
    return np.split(xxh32(raw, begin, end), cuts[1:-1])
