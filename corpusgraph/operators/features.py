"""Hashed text features for the vectoriser, a whole batch of texts at once.

A text's features are its words, their parts (runs of letters or of digits), the letter trigrams of each word with its ends, and the pairs
of neighbouring words and parts. They are spans of one array of code points, hashed and counted by array operations.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

from corpusgraph.functions import text
from corpusgraph.functions.codepoints import blocks, code_points, mix, span_hashes

DIMENSIONS = 384
#: Trigrams are made of words of so many letters and digits.
LEAST_CORE, MOST_CORE = 5, 80
_WORD, _PART, _PAIR, _GRAM = (np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in (1, 2, 3, 4))
_EDGE = np.uint64(0x5DEECE66D)


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 no part of a word, 1 a sign within words, 2 a letter, 3 a digit."""
    sign, letter = (re.compile(p) for p in (text.TOKEN.removesuffix("{2,}"), text.PART.split("+|")[0]))
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x2000):
        x = chr(c)
        table[c] = 0 if not sign.fullmatch(x) else 3 if x.isdigit() else 2 if letter.fullmatch(x) else 1
    return table


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashed_features(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every feature of a block of texts, and the number of its text."""
    normal = [unicodedata.normalize("NFKC", t) for t in block]
    # only letters of words count in lower case, and lower-casing must not make new ones
    points = code_points("\n".join(re.sub(text.TOKEN, lambda m: m[0].lower(), t) for t in normal) + "\n")
    text_ends = np.cumsum([len(t) + 1 for t in normal]) - 1
    kind = _kinds()[points]
    starts, ends = _runs(kind > 0)
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long]
    inside = np.zeros(len(points) + 1, np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside)[:-1] > 0

    parts = [_runs(inside & (kind == k)) for k in (2, 3)]
    part_starts, part_ends = (np.concatenate(x) for x in zip(*parts))
    long = part_ends - part_starts > 1
    part_starts, part_ends = part_starts[long], part_ends[long]
    hashes = np.concatenate([mix(span_hashes(points, starts, ends) ^ _WORD), mix(span_hashes(points, part_starts, part_ends) ^ _PART)])
    order = np.lexsort((np.repeat([0, 1], [len(starts), len(part_starts)]), np.concatenate([starts, part_starts])))
    hashes, of = hashes[order], np.searchsorted(text_ends, np.concatenate([starts, part_starts])[order])
    same = of[1:] == of[:-1]
    pairs = mix(hashes[:-1] + (mix(hashes[1:]) ^ _PAIR))[same]

    core = np.flatnonzero(inside & (kind >= 2))
    word = np.searchsorted(starts, core, "right") - 1
    size = np.bincount(word, minlength=len(starts)) if len(starts) else np.zeros(0, int)
    fit = ((size >= LEAST_CORE) & (size <= MOST_CORE))[word] if len(core) else np.zeros(0, bool)
    core, word = core[fit], word[fit]
    letter = mix(points[core].astype(np.uint64) ^ _GRAM)
    left = np.concatenate([[_EDGE], letter[:-1]]) if len(core) else letter
    right = np.concatenate([letter[1:], [_EDGE]]) if len(core) else letter
    if len(core):
        new = np.concatenate([[True], word[1:] != word[:-1]])
        left[new] = _EDGE
        right[np.concatenate([new[1:], [True]])] = _EDGE
    grams = mix(mix(left + _GRAM) + mix(letter + _PAIR) * np.uint64(3) + right)
    return np.concatenate([hashes, pairs, grams]), np.concatenate([of, of[1:][same], np.searchsorted(text_ends, core)])


def raw_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Of each text the damped, signed frequencies by place, before inverse document frequencies."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for first, block in blocks(texts):
        hashes, of = hashed_features(block)
        place = of * dimensions + (hashes % np.uint64(dimensions)).astype(np.int64)
        count = np.bincount(place, minlength=len(block) * dimensions)
        sign = np.bincount(place, np.where(hashes >> np.uint64(63), -1.0, 1.0), len(block) * dimensions)
        damped = np.where(count > 0, (1 + np.log(np.maximum(count, 1))) * np.where(sign >= 0, 1, -1), 0)
        out[first : first + len(block)] = damped.reshape(len(block), dimensions)
    return out
