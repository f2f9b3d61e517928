"""Words of Arrow text columns as 64-bit hashes, computed over whole buffers.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. Every byte has a random 64-bit
code for each place that it can have in a word; a word's hash is the sum of its codes, read off a
running sum, so equal words hash alike wherever they stand. As no two codes hang together, texts
cannot be built so that many of their words collide, as they can for polynomials modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Places whose codes are looked up; those of further places are computed.
PLACES = 64
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(0, (1 << 64) - 1, PLACES * 256, np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of some texts: where each starts and ends in data, its text's number and its hash."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and of the end."""
        return np.searchsorted(self.text, np.arange(len(self.bounds)))

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``length`` bytes of the words longer than that, and which those are."""
        which = np.flatnonzero(self.end - self.start > length)
        return _hash(self.sums, self.start[which], self.start[which] + length), which


def _sums(data: np.ndarray, start: np.ndarray, lower: bool) -> np.ndarray:
    """Running sums of the bytes' codes; places count from the last start before."""
    since = np.zeros(len(data), np.int32)
    since[start] = start
    np.maximum.accumulate(since, out=since)
    place = np.arange(len(data), dtype=np.int32) - since
    shown = _LOWER[data] if lower else data
    far = np.flatnonzero(place >= PLACES)
    codes = _TABLE[(np.minimum(place, PLACES - 1, out=since) << 8) | shown]
    if len(far):
        codes[far] = mix(((place[far].astype(np.uint64) << _U(8)) | shown[far].astype(np.uint64)) * _ODD)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    return sums


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * _ODD)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of parts of data that follow one another without overlap; empty ones all hash alike."""
    return _hash(_sums(data, start[start < len(data)], False), start, end)


def split(data: np.ndarray, bounds: np.ndarray, lower: bool, breaks: np.ndarray = _WS) -> Words:
    """breaks: which of the 256 bytes stand between words."""
    n = len(data)
    ws = breaks[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:n] = ws[: n - 1] if n else False
    after[: max(n - 1, 0)] = ws[1:]
    before[bounds[:-1]] = True
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    start = np.flatnonzero(~ws & before[:n])
    end = np.flatnonzero(~ws & after[:n]) + 1
    sums = _sums(data, start, lower)
    return Words(data, bounds, start, end, np.searchsorted(bounds, start, "right") - 1, _hash(sums, start, end), sums)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a text column; null texts are empty."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes (a longer text alone): from, to, bytes, bounds."""
    data, bounds = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
