"""Word and shingle hashes of whole Arrow string columns by numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from paywarden.llm.shared import travels

travels(__name__)

U = np.uint64
PIECE = 1 << 18
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashes(raw: np.ndarray, cuts: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in ``raw``; no word crosses a place in ``cuts``."""
    if "up" not in _cache:
        _cache["up"], _cache["down"] = _powers(BASE, PIECE + 1), _powers(BASE_INVERSE, PIECE + 1)
    word = ~separator[raw]
    if not word.any():
        return np.empty(0, U), np.empty(0, np.int64)
    new = word.copy()
    new[1:] &= ~word[:-1]
    cuts = cuts[cuts < len(raw)]
    new[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:] | new[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(BYTE[LOWER[raw]] * _cache["up"][:len(raw)], out=total[1:], dtype=U)
    value = (total[end] - total[start]) * _cache["down"][start]
    return mix(value + (end - start).astype(U)), start


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row limits of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), limits


def word_groups(column: pa.Array, separator: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of rows as (first row, word hashes, limits of each row in these).

    A group has about 256 KB of text; a longer row is hashed in pieces cut at separators, so the memory beside the
    text is a few bytes for each of its words.
    """
    data, limits = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        begin = limits[row]
        upto = max(row + 1, int(np.searchsorted(limits, begin + PIECE, "right")) - 1)
        if limits[upto] - begin <= PIECE:
            raw = data[begin:limits[upto]]
            found, start = _hashes(raw, limits[row:upto] - begin, separator)
            yield row, found, np.append(np.searchsorted(start, limits[row:upto] - begin), len(found))
        else:
            found = np.concatenate(list(_long_row(data[begin:limits[upto]], separator)))
            yield row, found, np.array([0, len(found)])
        row = upto


def _long_row(raw: np.ndarray, separator: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        part = raw[at:at + PIECE]
        if at + len(part) < len(raw):
            gaps = np.flatnonzero(separator[part])
            if len(gaps):
                part = part[:gaps[-1] + 1]
            else:  # one word longer than a piece: its pieces are hashed as one
                rest = np.flatnonzero(separator[raw[at:]])
                stop = at + int(rest[0]) if len(rest) else len(raw)
                value = U(0)
                for k in range(at, stop, PIECE):
                    value = mix(_hashes(raw[k:min(k + PIECE, stop)], np.zeros(1, np.int64), separator)[0] + value)[0]
                yield np.array([value], U)
                at = stop
                continue
        yield _hashes(part, np.zeros(1, np.int64), separator)[0]
        at += len(part)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words of one text; a shorter text is one shingle, no words none."""
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, PLACE[:1] * U(size), U)
    for k in range(size):
        total += words[k:len(words) - size + 1 + k] * PLACE[k + 1]
    return mix(total)
