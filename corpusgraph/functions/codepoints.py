"""Vectorised scanning of many texts at once: code points, character classes and hashes of spans.

Helpers for Arrow functions. A batch of texts becomes one array of code points, texts being separated by a line feed that
belongs to none of them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Code points that are handled at once; only a longer single text takes more.
BLOCK_CHARS = 400_000


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: white space (the White_Space property), letters (L), numbers (N), other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
        elif major == "Z" or 9 <= cp <= 13 or cp == 0x85:
            table[cp] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of about ``limit`` characters, each with the index of its first text."""
    first, block, size = 0, [], 0
    for text in texts:
        if block and size + len(text) > limit:
            yield first, block
            first, block, size = first + len(block), [], 0
        block.append(text)
        size += len(text) + 1
    if block:
        yield first, block


@functools.cache
def _spread() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + _STEP)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _STEP, np.uint64)
    up[0] = 1
    down = np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: equal spans agree wherever they stand."""
    n = 1 << max(19, int(len(points)).bit_length())
    up, down = _powers(n)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_spread()[points] * up[: len(points)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
