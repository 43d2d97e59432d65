"""Word shingles of texts as sorted sets of hashes."""

from __future__ import annotations

import numpy as np

from corpusgraph.functions.codepoints import LETTER, NUMBER, blocks, classes, code_points, mix, span_hashes

#: Bits of a shingle's hash; the rest of the 64 holds the text's number while sets are sorted.
HASH_BITS = 52
_TEXTS = 1 << (64 - HASH_BITS)


def word_hashes(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the first word's index of each text (with an end mark).

    Words are the longest runs of Unicode letters and numbers of the lower-cased text.
    """
    lowered = [t.lower() for t in block]
    points = code_points("\n".join(lowered))
    kind = classes()[points]
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = (kind == LETTER) | (kind == NUMBER)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return span_hashes(points, starts, ends), first


def shingle_sets(texts: list[str], size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each text, and the first one's index of each text (with an end mark).

    Texts of fewer than ``least_words`` words, and those shorter than a shingle, have none.
    """
    sets, counts = [], np.zeros(len(texts), np.int64)
    for first_text, block in blocks(texts):
        for at in range(0, len(block), _TEXTS):
            part = block[at : at + _TEXTS]
            words, first = word_hashes(part)
            if len(words) < size:
                continue
            h = np.zeros(len(words) - size + 1, np.uint64)
            for i in range(size):
                h = mix(h + words[i : len(words) - size + 1 + i])
            text = np.repeat(np.arange(len(part)), np.diff(first))
            n_words = np.diff(first)
            own = text[: len(h)]
            whole = (own == text[size - 1 :]) & (n_words[own] >= least_words)
            keyed = np.unique((own[whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (h[whole] >> np.uint64(64 - HASH_BITS)))
            counts[first_text + at : first_text + at + len(part)] = np.bincount((keyed >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(part))
            sets.append(keyed & np.uint64((1 << HASH_BITS) - 1))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
