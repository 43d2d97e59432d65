"""Subject areas of documents (problem 8).

Texts are read twice: for the lines of each source's page frame, and to write every sentence's words, hashed into a fixed
term space. What follows reads those numbers only, over all documents.

(1) Terms. A term's sketch sums random signs of the documents it stands in, so that terms of the same documents point the
same way; terms whose sketches agree form clusters: the vocabulary of one subject in one language, or of none. Which
subject a cluster is about is learnt from readers' marks on a bounded sample, by an expectation maximisation in which
clusters compete for the marks of a document, and from the words of the subjects' descriptions. Clusters that the
marks contradict, such as function words, are put aside. The sentences that the named clusters explain then give each term's weights.
(2) Features of a document: sentences about each subject, their shares, its source, kind and structure.
(3) A chain of logistic classifiers, one a subject, each seeing the features and the subjects decided before it, so that
subjects that occur together support each other. It is calibrated by cross-fitting, and a beam search over the chain decodes the
likeliest combination. No threshold on counts or shares decides: the classifiers learn from the marks where the limits are.

Frame lines are those of many documents of a source and are left out there, as are headings and code.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.codepoints import LETTER, NUMBER, SPACE, blocks, classes, code_points, mix, span_hashes
from corpusgraph.plans.joins import join_checked
from corpusgraph.plans.lineage import cut
from corpusgraph.sources.tables import table

#: Bounds of the model: marked documents to fit on, bits of the term space, dimensions of a sketch, combinations that a beam keeps.
MAX_LABELLED, TERM_BITS, SKETCH, BEAM = 20_000, 18, 128, 8
PLACES = 1 << TERM_BITS
#: Terms are clustered if so many sentences have them; sketches within a cluster agree to this cosine.
LEAST_CLUSTERED, AGREE = 5, 0.7
#: A cluster is named if a subject has this share of the marks it explains, so many in all, and odds so many times the subject's own; it is put aside if it has less.
SHARE_NAMED, LEAST_EXPLAINED, ODDS_NAMED, ODDS_ASIDE = 0.55, 0.5, 4.5, 3.5
#: Weight of a description's word against a mark, and share of wrong marks that the clusters needn't explain.
DESCRIBED, WRONG_MARKS = 0.7, 0.1
#: A term keeps its weights if so many sentences have it and with its subject beyond chance by so many nats.
LEAST_SEEN, LEAST_GAIN = 8, 4.0
#: A term's odds for its subject must exceed the subject's own so many times, in all and among what is about any subject.
LEAST_ODDS = 3.5
#: A term stands for a subject only if so great a share of its sentences are about it.
LEAST_PURITY = 0.3
#: Passes in which sentences teach terms, and folds of the calibration.
ROUNDS, FOLDS = 2, 3
#: A line of at least this share of a source's documents belongs to the page frame.
FRAME_PERCENT, FRAME_LEAST = 4, 5
_SOURCES, _KINDS = 16, 8
_PERIOD, _STRUCTURE = [ord(c) for c in ".!?…"], 5


@functools.cache
def _letter_case() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each code point, where it is one code point, and whether it is upper case."""
    lower = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, bool)
    for cp in np.flatnonzero(classes() == LETTER):
        c = chr(cp)
        if c.isupper() or c.istitle():
            upper[cp] = True
            if len(c.lower()) == 1:
                lower[cp] = ord(c.lower())
    return lower, upper


@functools.cache
def _frame_form() -> np.ndarray:
    form = _letter_case()[0].copy()
    form[49:58] = 48
    form[classes() == SPACE] = 32
    return form


def _as_frame(points: np.ndarray) -> np.ndarray:
    """What the variants of a frame line agree in: lower case, digits as 0, white space as spaces."""
    return _frame_form()[points]


def _lines(points: np.ndarray, kind: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line whether it has visible characters, where they begin and end, and the number of its text."""
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    visible = np.append(np.flatnonzero(kind != SPACE), len(points) - 1)
    first = visible[np.minimum(np.searchsorted(visible, starts), len(visible) - 1)]
    last = visible[np.maximum(np.searchsorted(visible, ends) - 1, 0)] + 1
    return first < ends, first, last, np.searchsorted(text_ends, starts)


@dataclass
class Scan:
    """Plain words of the sentences of a block of texts."""

    words: np.ndarray  # hash of each word, in order
    sentence: np.ndarray  # number of the word's sentence
    text: np.ndarray  # number of each sentence's text
    structure: np.ndarray  # of each text: sentences, headings, fences, list items, table rows


def scan(block: list[str], frames: np.ndarray) -> Scan:
    """Sentences end at a full stop, question or exclamation mark before white space, at a line end or a table's bar.

    Headings, fenced code and frame lines don't count; list items and table cells do. Identifiers (joined words, inner
    capitals, digits) and words under three letters are no words. The last fence of an odd number opens nothing.
    """
    points = code_points("\n".join(block) + "\n")
    kind = classes()[points]
    text_ends = np.cumsum([len(t) + 1 for t in block]) - 1
    line_ends = np.flatnonzero(points == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    full, first, last, text_of_line = _lines(points, kind, text_ends)
    lead = np.where(full, points[first], 0)
    padded = np.append(points, np.zeros(3, np.uint32))
    fence = (lead == 96) & (padded[first + 1] == 96) & (padded[first + 2] == 96)
    run = np.cumsum(fence)
    total = np.bincount(text_of_line, fence, len(block)).astype(np.int64)
    before = np.cumsum(total) - total
    rank = run - before[text_of_line]
    inside = (rank % 2 == 1) & ((rank < total[text_of_line]) | (total[text_of_line] % 2 == 0))
    code = inside | fence
    heading = (lead == 35) & ~code
    keep = full & ~code & ~heading
    if len(frames):
        asked = np.flatnonzero(keep)
        hashes = span_hashes(_as_frame(points), first[asked], last[asked])
        keep[asked[np.isin(hashes, frames)]] = False

    lower, upper = _letter_case()
    letter = np.zeros(len(points) + 2, np.int8)
    letter[1:-1] = (kind == LETTER) & np.repeat(keep, line_ends + 1 - line_starts)
    edge = np.diff(letter)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    capitals = np.concatenate([[0], np.cumsum(upper[points])])
    inner = capitals[ends] - capitals[starts + 1]
    was, then = points[np.maximum(starts - 1, 0)], padded[ends]
    was_kind, then_kind = np.where(starts > 0, kind[np.maximum(starts - 1, 0)], SPACE), classes()[then]
    joined = np.isin(was, [95, 46, 58]) & (starts > 0) | (was_kind == NUMBER) | np.isin(then, [95, 58]) | (then_kind == NUMBER)
    plain = (ends - starts >= 3) & ~joined & ((inner == 0) | (capitals[ends] - capitals[starts] == ends - starts))
    starts, ends = starts[plain], ends[plain]
    words = span_hashes(lower[points], starts, ends)

    stop = np.isin(points, _PERIOD)
    stop[:-1] &= kind[1:] == SPACE
    number = np.cumsum(stop | (points == 10) | (points == 124))[starts]
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    sentence = np.cumsum(new) - 1
    text = np.searchsorted(text_ends, starts[new])
    counted = [np.ones(len(text)), heading, fence, np.isin(lead, [45, 42, 49]) & keep, (lead == 124) & keep]
    of = [text] + [text_of_line] * 4
    structure = np.stack([np.bincount(o, c, len(block)) for o, c in zip(of, counted)], axis=1)
    return Scan(words, sentence, text, structure)


@dataclass
class Terms:
    """Log lifts of terms for subjects: of each place of the term space a row of weights, or -1 if its terms tell nothing."""

    row: np.ndarray  # of each place, the number of its row of weights
    weights: np.ndarray

    @staticmethod
    def of(places: np.ndarray, weights: np.ndarray) -> Terms:
        row = np.full(PLACES, -1, np.int32)
        row[places] = np.arange(len(places))
        return Terms(row, weights)

    def subjects(self, words: np.ndarray, sentence: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Of each sentence the number of its subject, or -1; ``sentence`` is each word's sentence, ``text`` each sentence's text.

        What a first pass finds in a text is the prior of a second, which settles words of several subjects.
        """
        n = self.weights.shape[1]
        best = np.full(len(text), -1)
        at = self.row[words]
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return best
        of = sentence[known]
        new = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
        scores = np.add.reduceat(self.weights[at[known]], new, axis=0)
        sentences = of[new]
        own = text[sentences]
        guess = scores.argmax(axis=1)
        counts = np.bincount(own * n + guess, minlength=texts * n).reshape(texts, n) + 0.5
        prior = np.log(counts / counts.sum(axis=1, keepdims=True))
        best[sentences] = (scores + prior[own]).argmax(axis=1)
        return best


def associate(counts: np.ndarray, seen: np.ndarray, totals: np.ndarray, total: float, least_seen: int = LEAST_SEEN) -> tuple[np.ndarray, np.ndarray]:
    """Which terms tell subjects apart, and their weights, from the counts of sentences by subject and in all."""
    if not len(seen):
        return np.zeros(0, int), np.zeros((0, len(totals)))
    base = np.maximum(totals, 0.5) / max(total, 1.0)
    lift = (counts + 2 * base) / (seen[:, None] + 2) / base
    best = (lift * (counts > 0)).argmax(axis=1)
    row = np.arange(len(seen))
    c, expected = counts[row, best], seen * base[best]
    gain = np.where(c > expected, c * np.log(np.maximum(c, 1e-9) / np.maximum(expected, 1e-9)) - (c - expected), 0)

    def odds(among: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (c + share) / np.maximum(among - c + 1 - share, 1e-9) * (1 - share) / np.maximum(share, 1e-9)

    apart = (odds(seen, np.minimum(base, 1)[best]) >= LEAST_ODDS) & (odds(counts.sum(axis=1), (totals / max(totals.sum(), 1.0))[best]) >= LEAST_ODDS)
    good = np.flatnonzero((seen >= least_seen) & (gain >= LEAST_GAIN) & apart & (c >= LEAST_PURITY * seen))
    return good, np.clip(np.log(np.maximum(lift[good], 1e-3)), -2.5, 4.0)


# tokens: the words of all sentences, written once


def _distinct_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each line of a text once, with its source and document."""
    for batch in batches:
        for first, block in blocks(batch["text"].tolist()):
            points = code_points("\n".join(block) + "\n")
            line, begin, end, text = _lines(points, classes()[points], np.cumsum([len(t) + 1 for t in block]) - 1)
            long = np.flatnonzero(line & (end - begin > 5))
            pairs = np.unique(np.stack([text[long].astype(np.uint64), span_hashes(_as_frame(points), begin[long], end[long])], axis=1), axis=0)
            at = first + pairs[:, 0].astype(np.int64)
            yield pd.DataFrame({"frame_of": batch["frame_of"].to_numpy()[at], "document": batch["document"].to_numpy()[at], "line": pairs[:, 1].view(np.int64)})


def frame_lines(rows: DataFrame) -> DataFrame:
    """Of each source the sorted hashes of the lines that stand in at least ``FRAME_PERCENT`` percent of its documents: at most
    25 times the lines of an average document. Repeated deliveries of a document count once. A written table."""
    totals = rows.groupBy("frame_of").agg(F.countDistinct("document").alias("documents"))
    lines = rows.select("frame_of", "document", "text").mapInPandas(_distinct_lines, "frame_of bigint, document bigint, line bigint")
    often = lines.groupBy("frame_of", "line").agg(F.countDistinct("document").alias("n")).where(F.col("n") >= FRAME_LEAST)
    found = often.join(totals, "frame_of").where(F.col("n") * 100 >= F.col("documents") * FRAME_PERCENT)
    return cut(found.groupBy("frame_of").agg(F.array_sort(F.collect_list("line")).alias("frames")), "frame-lines")


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the distinct words of each sentence, one array a text, and how many words each sentence has."""
    for batch in batches:
        for _, group in batch.groupby("frame_of", sort=False):
            frames = next((np.array(f, np.int64).view(np.uint64) for f in group["frames"] if f is not None), np.zeros(0, np.uint64))
            for first, block in blocks(group["text"].tolist()):
                found = scan(block, np.sort(frames))
                place = (found.words >> np.uint64(64 - TERM_BITS)).astype(np.int64)
                pair = np.unique(found.sentence.astype(np.int64) << TERM_BITS | place) if len(place) else np.zeros(0, np.int64)
                sentence, words = pair >> TERM_BITS, (pair & (PLACES - 1)).astype(np.int32)
                sizes = np.bincount(sentence, minlength=len(found.text)).astype(np.int32)
                ends = np.searchsorted(found.text, np.arange(1, len(block)))
                part = group.iloc[first : first + len(block)]
                yield pd.DataFrame(
                    {
                        "record": part["record"], "document": part["document"], "source": part["source"], "kind": part["kind"],
                        "words": np.split(words, np.searchsorted(sentence, ends)), "sizes": np.split(sizes, ends), "structure": list(found.structure.astype(np.int32)),
                    }
                )


def _tokens(documents: DataFrame, key: str, text: str, source: str, kind: str, corpus: str, document: str) -> DataFrame:
    known = lambda c: F.xxhash64(F.col(c).cast("string"))
    place = lambda c, n: F.pmod(known(c), F.lit(n)).cast("int")
    rows = documents.select(
        F.col(key).alias("record"), known(document).alias("document"), known(corpus).alias("frame_of"), place(source, _SOURCES).alias("source"), place(kind, _KINDS).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    with_frames = join_checked(rows, frame_lines(rows), ["frame_of"], "left")
    record = rows.schema["record"].dataType.simpleString()
    return cut(with_frames.mapInPandas(_tokenise, f"record {record}, document bigint, source int, kind int, words array<int>, sizes array<int>, structure array<int>"), "tokens")


@dataclass
class Block:
    """The rows of a batch of tokens as flat arrays."""

    words: np.ndarray
    sentence: np.ndarray  # of each word
    text: np.ndarray  # of each sentence
    rows: int

    @staticmethod
    def of(batch: pd.DataFrame) -> Block:
        sizes = np.concatenate([*batch["sizes"], np.zeros(0, np.int32)]).astype(np.int64)
        text = np.repeat(np.arange(len(batch)), [len(s) for s in batch["sizes"]])
        return Block(np.concatenate([*batch["words"], np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), text, len(batch))


#: Words that are handled at once; only a longer single text takes more.
_WORDS_AT_ONCE = 300_000


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Block]]:
    """The rows of the batches in runs of about so many words, however long the texts."""
    for batch in batches:
        total = np.cumsum([len(w) for w in batch["words"]])
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _WORDS_AT_ONCE, "right")))
            part = batch.iloc[first:last]
            yield part, Block.of(part)
            first = last


# terms: clusters and their subjects


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each term of a partition the number of its sentences, and the sum of its documents' random signs, weighted by log frequency."""
    seen, row = np.zeros(PLACES), np.full(PLACES, -1)
    sums = np.zeros((1024, SKETCH), np.float32)  # of the terms met so far
    known = 0
    bit = np.arange(64, dtype=np.uint64)
    for part, b in _parts(batches):
        document = part["document"].to_numpy(np.int64).view(np.uint64)
        drawn = [(mix(document + np.uint64(i))[:, None] >> bit) & np.uint64(1) for i in range(SKETCH // 64)]
        signs = np.hstack(drawn).astype(np.float32) * 2 - 1
        seen += np.bincount(b.words, minlength=PLACES)
        pair, n = np.unique(b.words * b.rows + b.text[b.sentence], return_counts=True)
        weight = np.log1p(n).astype(np.float32)
        for at in range(0, len(pair), 1 << 16):
            term, text = pair[at : at + (1 << 16)] // b.rows, pair[at : at + (1 << 16)] % b.rows
            new = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1])
            fresh = term[new][row[term[new]] < 0]
            row[fresh] = known + np.arange(len(fresh))
            known += len(fresh)
            if known > len(sums):
                sums = np.vstack([sums, np.zeros((max(known - len(sums), len(sums)), SKETCH), np.float32)])
            sums[row[term[new]]] += np.add.reduceat(weight[at : at + (1 << 16), None] * signs[text], new, axis=0)
    used = np.flatnonzero(seen)
    for at in range(0, len(used), 8192):
        own = used[at : at + 8192]
        yield pd.DataFrame({"term": own, "n": list(np.hstack([seen[own][:, None], sums[row[own]]]).astype(np.float32))})


def _summed(parts: DataFrame, width: int, least: int = 1) -> pd.DataFrame:
    """Sums by term over all partitions, of which at most one row a place of the term space reaches the driver."""
    sums = parts.groupBy("term").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(width)])
    return sums.where(F.col(f"n{0}") >= least).orderBy("term").toPandas()


def cluster(sketches: np.ndarray, seen: np.ndarray, agree: float = AGREE, passes: int = 5) -> np.ndarray:
    """Of each term the number of its cluster, or -1: the first pass opens a cluster for every term that no open one agrees with,
    frequent terms first; the others move terms to the nearest centre."""
    unit = sketches / np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
    order = np.argsort(-seen, kind="stable")
    centres = np.zeros((256, unit.shape[1]))
    norms = np.ones(256)
    used = 0
    for i in order:
        near = centres[:used] @ unit[i] / norms[:used] if used else np.zeros(0)
        at = int(near.argmax()) if used else -1
        if at < 0 or near[at] < agree:
            if used == len(centres):
                centres, norms = np.vstack([centres, np.zeros_like(centres)]), np.concatenate([norms, np.ones_like(norms)])
            at, used = used, used + 1
        centres[at] += unit[i]
        norms[at] = np.linalg.norm(centres[at])
    label = np.full(len(unit), -1)
    centres = centres[:used]
    for _ in range(passes):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        for first in range(0, len(unit), 4096):
            near = unit[first : first + 4096] @ centres.T
            label[first : first + 4096] = np.where(near.max(axis=1) >= agree, near.argmax(axis=1), -1) if len(centres) else -1
        held = np.flatnonzero(label >= 0)
        moved = np.zeros_like(centres)
        np.add.at(moved, label[held], unit[held])
        kept = np.flatnonzero(np.bincount(label[held], minlength=len(centres)))
        number = np.full(len(centres) + 1, -1)
        number[kept] = np.arange(len(kept))
        label, centres = number[label], moved[kept]
    return label


def _cluster_counts(cluster_of: np.ndarray, clusters: int):
    """Of each text its clusters and their numbers of sentences and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in _parts(batches):
            own = cluster_of[b.words]
            known = own >= 0
            pair, n = np.unique(b.text[b.sentence[known]] * clusters + own[known], return_counts=True)
            ends = np.searchsorted(pair, np.arange(1, b.rows) * clusters)
            yield pd.DataFrame({"record": part["record"], "clusters": np.split((pair % clusters).astype(np.int32), ends), "n": np.split(n.astype(np.int32), ends)})

    return run


def name_clusters(document: np.ndarray, cluster_of: np.ndarray, count: np.ndarray, spread: np.ndarray, marks: np.ndarray, described: np.ndarray) -> np.ndarray:
    """Of each cluster the number of its subject, or -1.

    ``count`` is the number of words that a marked document has of a cluster, ``spread`` the share of all documents that a cluster
    stands in, ``marks`` the documents' subjects, ``described`` the words of each subject's description by cluster. Each mark is
    shared among the clusters of its document by weight and by what they have explained elsewhere, or is taken as wrong.
    """
    clusters, subjects = described.shape
    documents = len(marks)
    base = (marks.sum(axis=0) + 0.5) / (documents + 0.5 * subjects)
    seed = np.minimum(described, 2) * DESCRIBED
    prior = 0.3 * base / base.sum() + seed
    weight = count * np.log(1 / np.maximum(spread, 1e-9))[cluster_of] ** 2
    aside = np.zeros(clusters, bool)
    row = np.arange(clusters)
    of_subject = [np.flatnonzero(marks[document, s] > 0) for s in range(subjects)]
    for _ in range(8):
        share = weight * ~aside[cluster_of]
        share = share / np.maximum(np.bincount(document, share, documents), 1e-9)[document]
        explains = prior / prior.sum(axis=1, keepdims=True)
        for _ in range(40):
            taken = np.zeros((clusters, subjects))
            for s, at in enumerate(of_subject):
                r = share[at] * explains[cluster_of[at], s]
                whole = np.bincount(document[at], r, documents) + WRONG_MARKS * base[s]
                taken[:, s] = np.bincount(cluster_of[at], r / whole[document[at]], clusters)
            before = explains
            explains = (taken + prior) / (taken + prior).sum(axis=1, keepdims=True)
            if np.abs(explains - before).max(initial=0) < 1e-4:
                break
        best = explains.argmax(axis=1)
        agreeing = np.bincount(cluster_of, share * marks[document, best[cluster_of]], clusters) + seed[row, best]
        strength = np.bincount(cluster_of, share, clusters) + seed.sum(axis=1)
        own = base[best]
        odds = (agreeing + own) / (strength - agreeing + 1 - own) * (1 - own) / own
        now = aside | ((strength >= 1) & (odds < ODDS_ASIDE))
        if (now == aside).all():
            break
        aside = now
    named = ~aside & (explains[row, best] >= SHARE_NAMED) & ((taken + seed)[row, best] >= LEAST_EXPLAINED) & (odds >= ODDS_NAMED)
    return np.where(named, best, -1)


def _sentence_terms(terms: Terms, subjects: int):
    """Of each term of a partition the sentences that have it, in all and about each subject; place ``PLACES`` has the totals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((subjects + 1, PLACES + 1))
        for _, b in _parts(batches):
            best = terms.subjects(b.words, b.sentence, b.text, b.rows)
            sums[0, :PLACES] += np.bincount(b.words, minlength=PLACES)
            sums[0, PLACES] += len(best)
            about = best[b.sentence]
            for s in range(subjects):
                sums[s + 1, :PLACES] += np.bincount(b.words[about == s], minlength=PLACES)
                sums[s + 1, PLACES] += (best == s).sum()
        used = np.flatnonzero(sums[0])
        if len(used):
            yield pd.DataFrame({"term": used, "n": list(sums[:, used].T)})

    return run


_SUMS, _SKETCHED = "term bigint, n array<double>", "term bigint, n array<float>"


def _description_places(text: str) -> np.ndarray:
    """Places of the words of a description."""
    words = set(re.findall(r"[^\W\d_]{3,}", text.lower()))
    return np.unique([int(scan([w], np.zeros(0, np.uint64)).words[0] >> np.uint64(64 - TERM_BITS)) for w in words]).astype(int)


def _learn_terms(tokens: DataFrame, sample: DataFrame, marks: pd.DataFrame, subjects: int, descriptions: list[str]) -> Terms:
    """Terms and their weights: clusters, their names, and what the sentences they explain tell of every term."""
    rows = _summed(tokens.select("document", "words", "sizes").mapInPandas(_sketches, _SKETCHED), SKETCH + 1, LEAST_CLUSTERED)
    values = rows.drop(columns="term").to_numpy(float)
    place = rows["term"].to_numpy(int)
    label = cluster(values[:, 1:], values[:, 0])
    clusters = int(label.max(initial=-1)) + 1
    if not clusters:
        return Terms.of(np.zeros(0, int), np.zeros((0, subjects)))
    cluster_of = np.full(PLACES, -1, np.int32)
    cluster_of[place] = label
    counted = _cluster_counts(cluster_of, clusters)
    shape = f"record {tokens.schema['record'].dataType.simpleString()}, clusters array<int>, n array<int>"
    columns = ["record", "words", "sizes"]
    met = tokens.select(*columns).mapInPandas(counted, shape).select(F.explode("clusters").alias("c")).groupBy("c").agg(F.count("*").alias("n")).toPandas()
    spread = np.zeros(clusters)
    spread[met["c"].to_numpy(int)] = met["n"].to_numpy() / max(tokens.count(), 1)
    own = sample.select(*columns).mapInPandas(counted, shape).toPandas()
    own = marks.merge(own, on="record", how="inner")
    labels = np.zeros((len(own), subjects))
    for i, m in enumerate(own["marks"]):
        labels[i, list(m)] = 1
    document = np.repeat(np.arange(len(own)), [len(c) for c in own["clusters"]])
    of_word, count = (np.concatenate([*own[c], np.zeros(0, np.int32)]).astype(np.int64) for c in ("clusters", "n"))
    described = np.zeros((clusters, subjects))
    said = np.zeros((subjects, PLACES), bool)
    for s, text in enumerate(descriptions):
        said[s, _description_places(text)] = True
    for s in range(subjects):  # a word of several descriptions tells nothing
        of = cluster_of[np.flatnonzero(said[s] & (said.sum(axis=0) == 1))]
        np.add.at(described[:, s], of[of >= 0], 1)
    name = name_clusters(document, of_word, count, spread, labels, described)
    named = np.flatnonzero((cluster_of >= 0) & (name[cluster_of] >= 0))
    terms = Terms.of(named, 3.0 * np.eye(subjects)[name[cluster_of[named]]])
    for _ in range(ROUNDS):
        rows = _summed(tokens.select("words", "sizes").mapInPandas(_sentence_terms(terms, subjects), _SUMS), subjects + 1, LEAST_SEEN)
        values = rows.drop(columns="term").to_numpy(float)
        place = rows["term"].to_numpy(int)
        total = values[place == PLACES].sum(axis=0)
        values, place = values[place < PLACES], place[place < PLACES]
        good, weights = associate(values[:, 1:], values[:, 0], total[1:], total[0])
        terms = Terms.of(place[good], weights)
    return terms


# features, classifiers, decoding


def _features(batch: pd.DataFrame, b: Block, terms: Terms) -> np.ndarray:
    """Of each row: sentences and share by subject; source and kind; structure; a constant."""
    n, s = len(batch), terms.weights.shape[1]
    best = terms.subjects(b.words, b.sentence, b.text, n)
    about = best >= 0
    counts = np.bincount(b.text[about] * s + best[about], minlength=n * s).reshape(n, s).astype(float)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    place = np.zeros((n, _SOURCES + _KINDS))
    place[np.arange(n), batch["source"].to_numpy()] = 1
    place[np.arange(n), _SOURCES + batch["kind"].to_numpy()] = 1
    return np.hstack([np.log1p(counts), share, place, np.log1p(np.stack(batch["structure"].to_list())), np.ones((n, 1))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method, on top of given log odds."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Steps in which the classifiers see a subject's sentences and their share; which of them matter is learnt.
_COUNT_STEPS, _SHARE_STEPS = np.array([1, 2, 3, 4, 6, 9, 14]), np.arange(1, 20) * 0.05


def _own_features(x: np.ndarray, subjects: int) -> np.ndarray:
    """Of each row and subject what any subject is told by: its sentences and share in steps, and how the document divides."""
    count, share = x[:, :subjects], x[:, subjects : 2 * subjects]
    number = np.round(np.expm1(count))
    flat = np.ones_like(share)
    total = np.log1p(number.sum(axis=1, keepdims=True)) * flat
    rivals = (share > 0).sum(axis=1, keepdims=True) * flat
    greatest = share.max(axis=1, keepdims=True) * flat if subjects else share
    by_count = number[:, :, None] >= _COUNT_STEPS
    by_share = share[:, :, None] >= _SHARE_STEPS - 1e-9
    return np.concatenate([np.stack([flat, count, share, total, rivals, greatest, share == greatest], axis=2), by_count, by_share], axis=2)


@dataclass
class Chain:
    """Classifiers in the order of the chain. Log odds are those of the subject's own features, the same for all subjects, and
    the link's: weights of all features and of the subjects decided before it."""

    order: list[int]
    own: np.ndarray
    weights: list[np.ndarray]
    scale: tuple[float, float]

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, order: list[int], ridge: float) -> Chain:
        n = y.shape[1]
        features = _own_features(x, n)
        told = x[:, :n] > 0  # without a sentence a subject is never assigned
        own = _logistic(features[told], y[told], 0.1)
        base = features @ own
        weights = []
        for i, s in enumerate(order):
            seen = told[:, s]
            full = np.hstack([x, y[:, order[:i]]])
            weights.append(_logistic(full[seen], y[seen, s], ridge, base[seen, s]))
        return Chain(order, own, weights, (1.0, 0.0))

    def _log_odds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each row and subject, given the true subjects before it."""
        n, m = y.shape[1], x.shape[1]
        z = _own_features(x, n) @ self.own
        for i, s in enumerate(self.order):
            z[:, s] += x @ self.weights[i][:m] + y[:, self.order[:i]] @ self.weights[i][m:]
        return z

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 20.0, folds: int = FOLDS) -> Chain:
        """Trains on all rows; slope and offset of the log odds are fitted to the rows that each fold leaves out."""
        n = y.shape[1]
        order = np.argsort(-y.sum(axis=0), kind="stable").tolist()
        fold = np.arange(len(x)) % folds
        held = np.zeros(y.shape)
        for f in range(folds):
            if (fold != f).any() and (fold == f).any():
                held[fold == f] = Chain._train(x[fold != f], y[fold != f], order, ridge)._log_odds(x[fold == f], y[fold == f])
        told = x[:, :n] > 0
        z = np.clip(held[told], -30, 30)
        slope, offset = _logistic(np.stack([z, np.ones(len(z))], axis=1), y[told], 1.0, z) + [1.0, 0.0]
        chain = Chain._train(x, y, order, ridge)
        chain.scale = (float(max(slope, 0.05)), float(offset))
        return chain

    def decode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The likeliest combination of subjects of each row, as far as the beam sees."""
        n, m = x.shape
        labels, scores = np.zeros((n, 1, len(self.order))), np.zeros((n, 1))
        base = _own_features(x, len(self.order)) @ self.own
        a, b = self.scale
        for i, w in enumerate(self.weights):
            z = (base[:, self.order[i]] + x @ w[:m])[:, None] + labels[:, :, self.order[:i]] @ w[m:]
            z = np.clip(a * z + b, -30, 30)
            yes, no = scores - np.log1p(np.exp(-z)), scores - np.log1p(np.exp(z))
            both = np.concatenate([no, yes], axis=1)
            with_it = labels.copy()
            with_it[:, :, self.order[i]] = 1
            labels = np.concatenate([labels, with_it], axis=1)
            if both.shape[1] > beam:
                top = np.argsort(-both, axis=1, kind="stable")[:, :beam]
                both = np.take_along_axis(both, top, 1)
                labels = np.take_along_axis(labels, top[:, :, None], 1)
            scores = both
        return labels[np.arange(n), scores.argmax(axis=1)].astype(bool)


@dataclass
class SubjectModel:
    names: list[str]
    tokens: DataFrame
    terms: Terms
    chain: Chain | None


def fit_subjects(
    documents: DataFrame, subjects: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", kind: str = "kind", corpus: str = "corpus", document: str = "logical_id", max_labelled: int = MAX_LABELLED
) -> SubjectModel:
    """Learns terms and the classifier chain, and writes the tokens of ``documents``.

    ``subjects`` has the subjects' names in ``subject`` and, if it has the column, what they are about in ``description``; ``marks``
    has rows ``(key, subject)``. Null marks, marks of unknown subjects and of unknown documents teach nothing; repeated ones
    count once. At most ``max_labelled`` marked documents are used, chosen by the hash of their key; frames, terms and
    sentences are counted over all documents. Without any usable mark no document gets a subject.
    """
    described = subjects if "description" in subjects.columns else subjects.withColumn("description", F.lit(None).cast("string"))
    known = described.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.concat_ws(" ", F.collect_set("description")).alias("description")).orderBy("subject").collect()
    names = [r["subject"] for r in known]
    n = len(names)
    number = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("subject")).cast("int") - 1 if names else F.lit(-1)
    marked = marks.where(F.col("subject").isin(names) & F.col(key).isNotNull()).select(F.col(key).alias("record"), number.alias("mark"))
    marked = marked.groupBy("record").agg(F.collect_set("mark").alias("marks"))
    marked = marked.join(documents.select(F.col(key).alias("record")).distinct(), "record", "left_semi").orderBy(F.xxhash64("record"), "record").limit(max_labelled)
    own = marked.toPandas()
    tokens = _tokens(documents, key, text, source, kind, corpus, document)
    if not n or not len(own):
        return SubjectModel(names, tokens, Terms.of(np.zeros(0, int), np.zeros((0, n))), None)
    record = tokens.schema["record"].dataType.simpleString()
    wanted = documents.sparkSession.createDataFrame([(r,) for r in own["record"].tolist()], f"record {record}")
    sample = cut(tokens.join(F.broadcast(wanted), "record", "left_semi"), "marked")  # at most max_labelled keys
    terms = _learn_terms(tokens, sample, own, n, [r["description"] or "" for r in known])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in _parts(batches):
            yield pd.DataFrame({"record": part["record"], "x": list(_features(part, b, terms))})

    fitted = sample.mapInPandas(features, f"record {record}, x array<double>").toPandas().merge(own, on="record").sort_values("record", kind="stable")
    y = np.zeros((len(fitted), n))
    for i, m in enumerate(fitted["marks"]):
        y[i, list(m)] = 1
    return SubjectModel(names, tokens, terms, Chain.fit(np.vstack(fitted["x"]), y))


def assign_subjects(model: SubjectModel) -> DataFrame:
    """Rows ``(record, subject)`` of the documents that the model was fitted on: none, one or several for each.

    Null, empty and blank texts have no subject. Null sources and kinds are values like others. Repeated rows are assigned each.
    Extra columns are ignored.
    """
    names = np.array(model.names, object)
    terms, chain = model.terms, model.chain

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, b in _parts(batches):
            if chain is None:
                continue
            x = _features(part, b, terms)
            at, subject = np.nonzero(chain.decode(x) & (x[:, : len(names)] > 0))
            yield pd.DataFrame({"record": part["record"].to_numpy()[at], "subject": names[subject]})

    return model.tokens.mapInPandas(run, f"record {model.tokens.schema['record'].dataType.simpleString()}, subject string")


def subject_shares(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """The share of each subject in the corpus."""
    total = documents.agg(F.count("*").alias("total"))
    return assigned.groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(total).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    documents, subjects, marks = (table(spark, folder, t) for t in ("documents", "subjects", "subject_labels"))
    return assign_subjects(fit_subjects(documents, subjects, marks))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select(F.col("record").alias("doc_id"), "subject")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus's composition by subject."""
    return subject_shares(_assigned(spark, folder), table(spark, folder, "documents"))


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
