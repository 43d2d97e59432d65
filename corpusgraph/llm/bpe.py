"""Byte-level BPE in batches: vectorised pre-tokenisation, and encoding of distinct pieces only.

The pre-tokeniser follows the public pattern of byte-level BPE vocabularies: contractions; letters, numbers or other
characters with one leading space; white space, the last of which goes with a following word.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import tiktoken

from corpusgraph.functions.codepoints import LETTER, OTHER, SPACE, blocks, classes, code_points, span_hashes

#: The pre-tokeniser's pattern, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The contractions that the pattern lists.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Distinct pieces that a worker keeps encoded.
CACHE = 400_000


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of all texts start. ``ends`` are the places of the separators after each text.

    Each separator is reported as a start, too, so that differences of neighbours are lengths of pieces.
    """
    kind = classes()[points]
    kind[ends] = 9
    n = len(points)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change.copy()
    # the last white space before a word: a plain space leads the word, anything else stands alone
    word = change & (kind <= 3) & (kind != SPACE)
    after = np.flatnonzero(word)
    after = after[after > 0]
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    led = after[points[after - 1] == 32]
    start[led] = False
    # contractions: an apostrophe that begins a piece alone, with letters behind it
    quote = np.flatnonzero((points == 39) & start & change)
    quote = quote[quote + 1 < n]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        letters = np.zeros(n + 2, np.uint32)
        letters[:n] = points
        done = np.zeros(len(quote), bool)
        for tail in CONTRACTIONS:
            hit = ~done
            for i, letter in enumerate(tail):
                hit &= letters[quote + 1 + i] == ord(letter)
            at = quote[hit]
            start[at + 1] = False
            rest = at + 1 + len(tail)
            rest = rest[rest < n]
            start[rest] = True
            done |= hit
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts with one vocabulary. Pieces that were met before cost one look-up in a sorted array of hashes."""

    def __init__(self, ranks: bytes) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._first = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.int32)
        self._letters = np.zeros(0, np.uint32)  # the pieces themselves, to compare with on a hit
        self._spot = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self._hashes) + len(hashes) > CACHE and len(self._hashes):
            raise OverflowError
        encoded = [self._own.encode_ordinary(t) for t in texts]
        sizes = np.array([len(e) for e in encoded], np.int64)
        first = len(self._pool) + np.cumsum(sizes) - sizes
        self._pool = np.concatenate([self._pool, np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))])
        length = np.array([len(t) for t in texts], np.int64)
        spot = len(self._letters) + np.cumsum(length) - length
        self._letters = np.concatenate([self._letters, code_points("".join(texts))])
        old = (self._hashes, self._first, self._sizes, self._spot, self._length)
        joined = [np.concatenate(x) for x in zip(old, (hashes, first, sizes, spot, length))]
        order = np.argsort(joined[0])
        self._hashes, self._first, self._sizes, self._spot, self._length = (x[order] for x in joined)

    def _look_up(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece."""
        hashes = span_hashes(points, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._hashes, distinct)
        new = np.ones(len(distinct), bool)
        if len(self._hashes):
            new = self._hashes[np.minimum(at, len(self._hashes) - 1)] != distinct
        if new.any():
            spots = where[new]
            texts = [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts[spots], ends[spots])]
            try:
                self._learn(distinct[new], texts)
            except OverflowError:
                self._clear()
                return self._look_up(points, starts, ends)
            at = np.searchsorted(self._hashes, distinct)
        entry = at[inverse]
        self._compare(points, starts, ends, entry)
        return entry

    def _compare(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> None:
        """Every piece must be the one that is known by its hash, letter by letter; two pieces of one hash are an error, not wrong ids."""
        sizes = ends - starts
        same = np.array_equal(sizes, self._length[entry])
        if same:
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            same = np.array_equal(points[np.repeat(starts, sizes) + within], self._letters[np.repeat(self._spot[entry], sizes) + within])
        if not same:
            raise ValueError("two pieces share a hash")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [ids for _, block in blocks(texts) for ids, _ in self._encode_block(block)]

    def encode_with_starts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and for each id the place in the text where its piece starts."""
        return [x for _, block in blocks(texts) for x in self._encode_block(block, starts_too=True)]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        return np.array([n for _, block in blocks(texts) for n in self._encode_block(block, count_only=True)], np.int64)

    def _encode_block(self, block: list[str], starts_too: bool = False, count_only: bool = False):
        points = code_points("\n".join(block) + "\n")
        ends = np.cumsum([len(t) + 1 for t in block]) - 1
        starts = piece_starts(points, ends)
        stops = np.append(starts[1:], len(points))
        real = np.ones(len(points), bool)
        real[ends] = False
        keep = real[starts]
        starts, stops = starts[keep], stops[keep]
        entry = self._look_up(points, starts, stops) if len(starts) else np.zeros(0, np.int64)
        sizes = self._sizes[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        text_piece = np.searchsorted(starts, ends)  # pieces before the end of each text
        bounds = np.concatenate([[0], total[text_piece]])
        if count_only:
            return np.diff(bounds).tolist()
        gather = np.repeat(self._first[entry] - total[:-1], sizes) + np.arange(total[-1])
        ids = self._pool[gather]
        if not starts_too:
            return [(ids[a:b], None) for a, b in zip(bounds[:-1], bounds[1:])]
        of = np.repeat(starts, sizes)
        begin = np.concatenate([[0], ends[:-1] + 1])
        return [(ids[a:b], of[a:b] - s) for a, b, s in zip(bounds[:-1], bounds[1:], begin)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: their raw bytes one after the other."""
        return self._own.decode_bytes(list(ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(ranks)
