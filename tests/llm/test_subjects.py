from __future__ import annotations

import random

import numpy as np
import pytest

from corpusgraph.llm import subjects as sub
from corpusgraph.functions.codepoints import code_points, span_hashes

NONE = np.zeros(0, np.uint64)
VOCABULARY = {s: [f"{s}{c}" for c in "abcdefghijkl"] for s in ("lawx", "sportx", "websx")}
PLAIN = "the keep apart from every change repeated unless between about shows enough explain why depend".split()


def words_of(text, frames=NONE):
    return sub.scan([text], frames)


def h(word):
    p = code_points(word)
    return span_hashes(p, np.array([0]), np.array([len(p)]))[0]


def test_scan_leaves_out_titles_code_and_identifiers():
    text = "# Heading words\nFirst one here. Second: KnapTrill and snake_case ab x9y!\n```\ncode words\n# more\n```\n- item words\n| cell one | cell two |\nÜBER alles"
    found = words_of(text)
    want = [["first", "one", "here"], ["second", "and"], ["item", "words"], ["cell", "one"], ["cell", "two"], ["über", "alles"]]
    got = [[w for w, s in zip(found.words.tolist(), found.sentence) if s == i] for i in range(len(found.text))]
    # "Second:" is followed by a colon and so part of a name
    assert got == [[h(w) for w in s if w != "second"] for s in want]
    assert found.structure.tolist() == [[6, 1, 2, 1, 1]]


def test_an_unclosed_fence_hides_nothing():
    assert len(words_of("```\nsome code\n```\nplain words here\n```\nstill words here").text) == 2


def test_frames_and_empty_texts():
    line = "Was this page Helpful 12"
    p = sub._as_frame(code_points(line))
    frame = span_hashes(p, np.array([0]), np.array([len(p)]))
    assert len(words_of("  was this\tpage helpful 99 \nother words", np.sort(frame)).text) == 1
    for text in ("", "\n", "   ", "#", "```"):
        assert len(words_of(text).words) == 0


def corpus(n, seed, marked=1.0, wrong=0.0):
    rng = random.Random(seed)
    docs, marks, truth = [], [], set()
    for i in range(n):
        own = rng.sample(list(VOCABULARY), rng.choice([1, 1, 2]))
        lines = ["# " + rng.choice(VOCABULARY["lawx"])]
        for s in own:
            lines += [" ".join(["Keep", *rng.sample(VOCABULARY[s], 2), *rng.sample(PLAIN, 3)]) + "." for _ in range(rng.randrange(3, 6))]
        lines += [" ".join(rng.sample(PLAIN, 5)) + "." for _ in range(4)]
        docs.append((i, f"l{i}", "c", rng.choice("ab"), "k", "\n".join(lines)))
        truth |= {(i, s) for s in own}
        if rng.random() < marked:
            marks += [(i, rng.choice(list(VOCABULARY)) if rng.random() < wrong else s) for s in own]
    return docs, marks, truth


SCHEMA = "doc_id long, logical_id string, corpus string, source string, kind string, text string"


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([(s,) for s in VOCABULARY] + [(None,)], "subject string")


def test_held_out_accuracy(spark, subjects):
    docs, marks, truth = corpus(700, 1, marked=0.3, wrong=0.05)
    df = spark.createDataFrame(docs, SCHEMA)
    table = spark.createDataFrame(marks + marks[:9] + [(3, None), (None, "lawx"), (99999, "lawx"), (4, "unknown")], "doc_id long, subject string")
    model = sub.fit_subjects(df, subjects, table)
    got = {(r.record, r.subject) for r in sub.assign_subjects(model).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    shares = {r.subject: r.share for r in sub.subject_shares(sub.assign_subjects(model), df).collect()}
    assert set(shares) == set(VOCABULARY) and all(0.3 < x < 0.6 for x in shares.values())


def test_odd_documents(spark, subjects):
    docs, marks, _ = corpus(150, 2)
    docs += [(900, None, None, None, None, None), (901, "x", "c", "a", "k", ""), (902, "y", "c", "a", "k", " \n "), docs[0]]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS record", "'z' AS subject", "2 AS marks")
    model = sub.fit_subjects(df, subjects, spark.createDataFrame(marks, "doc_id long, subject string"))
    got = [(r.record, r.subject) for r in sub.assign_subjects(model).collect()]
    assert not {d for d, _ in got} & {900, 901, 902}
    assert len([x for x in got if x[0] == 0]) == 2 * len({x for x in got if x[0] == 0})


def test_no_marks_no_subjects(spark, subjects):
    docs, _, _ = corpus(10, 3)
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([(1, None)], "doc_id long, subject string")
    assert sub.assign_subjects(sub.fit_subjects(df, subjects, none)).collect() == []
    assert sub.assign_subjects(sub.fit_subjects(df, subjects.limit(0), none)).collect() == []
    assert sub.assign_subjects(sub.fit_subjects(df.limit(0), subjects, none)).collect() == []


def test_frames_count_in_their_own_source_only(spark):
    docs = [(i, f"l{i}", "one", "a", "k", f"Shared footer line of site\nOther {chr(97 + i) * 4} words follow.") for i in range(20)]
    docs += [(100 + i, f"m{i}", "two", "a", "k", "Shared footer line of site" if i == 0 else f"Text {chr(97 + i % 26) * (3 + i // 26)} differs.") for i in range(40)]
    rows = spark.createDataFrame(docs, SCHEMA)
    tokens = {r.record: r for r in sub._tokens(rows, "doc_id", "text", "source", "kind", "corpus", "logical_id").collect()}
    assert len(tokens[100].sizes) == 1 and all(len(tokens[i].sizes) == 1 and tokens[i].sizes[0] == 4 for i in range(20))


def test_a_subject_without_marks_is_named_by_its_description(spark):
    docs, marks, truth = corpus(300, 4, marked=0.4)
    df = spark.createDataFrame(docs, SCHEMA)
    told = spark.createDataFrame([("lawx", "lawxa, lawxb and more"), ("sportx", "sportxa or sportxb"), ("websx", "websxa and websxc")], "subject string, description string")
    known = spark.createDataFrame([m for m in marks if m[1] != "websx"], "doc_id long, subject string")
    got = {(r.record, r.subject) for r in sub.assign_subjects(sub.fit_subjects(df, told, known)).collect()}
    webs = {(i, s) for i, s in truth if s == "websx" and len([t for t in truth if t[0] == i]) == 1}
    assert len(got & webs) >= 2 / 3 * len(webs)  # the marks teach doubt: documents about it are marked with other subjects or none


def test_clusters_part_vocabularies():
    rng = np.random.default_rng(3)
    centres = rng.choice([-1.0, 1.0], (4, sub.SKETCH))
    sketches = np.vstack([c + rng.normal(0, 0.3, (20, sub.SKETCH)) for c in centres])
    label = sub.cluster(sketches, np.arange(80, 0, -1.0))
    assert len(set(label)) == 4 and all(len(set(label[i : i + 20])) == 1 for i in range(0, 80, 20))
    assert sub.cluster(np.zeros((0, sub.SKETCH)), np.zeros(0)).tolist() == []


def test_clusters_compete_for_marks():
    """Function words stand in every document and are put aside; a wrong mark doesn't rename a cluster."""
    counts = np.array([[30, 9, 0]] * 6 + [[30, 0, 9]] * 6, float)
    marks = np.array([[1, 0]] * 5 + [[0, 1]] * 7, float)
    def named(counts, *rest):
        document, of = np.nonzero(counts)
        return sub.name_clusters(document, of, counts[document, of], *rest).tolist()

    name = named(counts, np.array([1.0, 0.5, 0.5]), marks, np.zeros((3, 2)))
    assert name == [-1, 0, 1]
    name = named(counts * [1, 1, 0], np.array([1.0, 0.5, 0.5]), marks[:, :1] @ np.array([[1.0, 0.0]]), np.array([[0, 0], [0, 0], [0, 2.0]]))
    assert name == [-1, 0, 1]


def features(counts):
    counts = np.asarray(counts, float)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.log1p(counts), share, np.zeros((len(counts), 29)), np.ones((len(counts), 1))])


def test_beam_finds_the_best_combination():
    rng = np.random.default_rng(1)
    x = np.hstack([np.zeros((6, 9)), rng.normal(size=(6, 4))])
    width = sub._own_features(x, 3).shape[2]
    chain = sub.Chain([2, 0, 1], np.zeros(width), [rng.normal(size=13), rng.normal(size=14), rng.normal(size=15)], (1.0, 0.0))

    def log_odds(row, labels):
        total, before = 0.0, []
        for i, s in enumerate(chain.order):
            z = row @ chain.weights[i][:13] + np.dot(before, chain.weights[i][13:])
            total += -np.log1p(np.exp(-z)) if labels[s] else -np.log1p(np.exp(z))
            before.append(labels[s])
        return total

    every = [[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    best = [max(every, key=lambda y: log_odds(row, y)) for row in x]
    assert chain.decode(x, beam=8).astype(int).tolist() == best


def test_chain_and_beam_change_the_result_for_the_better():
    """Documents are about one of two subjects, their sentences hardly tell which: only a chain knows that one excludes the other."""
    rng = np.random.default_rng(5)

    def draw(n):
        first = rng.random(n) < 0.45
        y = np.stack([first, ~first, np.ones(n)], axis=1).astype(float)
        return features(np.stack([rng.integers(2, 6, n), rng.integers(2, 6, n), np.full(n, 5)], axis=1)), y

    (x, y), (test, truth) = draw(2000), draw(2000)
    chain = sub.Chain.fit(x, y)
    apart = sub.Chain(chain.order, chain.own, [np.concatenate([w[: x.shape[1]], 0 * w[x.shape[1] :]]) for w in chain.weights], chain.scale)
    exact = lambda c, beam: (c.decode(test, beam) == truth).all(axis=1).mean()
    assert exact(chain, 8) >= exact(chain, 1) and exact(chain, 8) >= exact(apart, 8) + 0.05
    one = chain.decode(test)[:, :2].sum(axis=1)
    assert (one == 1).mean() >= 0.99
    greedy_first = sub.Chain([0, 1, 2], np.zeros(sub._own_features(test, 3).shape[2]), [np.zeros(36), np.r_[np.zeros(36), 6.0], np.r_[np.zeros(36), 0.0, -9.0]], (1.0, 0.0))
    greedy_first.weights[0][35] = -0.2  # undecided on its own
    greedy_first.weights[1][35], greedy_first.weights[2][35] = -0.1, 1.0
    assert greedy_first.decode(test[:1], 8)[0, 0] and not greedy_first.decode(test[:1], 1)[0, 0]


def test_classifiers_learn_the_limits():
    """No limit is given: that two sentences and a quarter are needed is learnt, wrong marks notwithstanding."""
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 9, (4000, 4)) * (rng.random((4000, 4)) < 0.6)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    truth = (counts >= 2) & (share >= 0.25)
    marks = truth.copy()
    flip = rng.random(len(marks)) < 0.04
    marks[flip] = rng.permutation(marks[flip], axis=1)
    x = features(counts)
    got = sub.Chain.fit(x, marks.astype(float)).decode(x) & (counts > 0)
    assert (got & truth).sum() >= 0.985 * truth.sum() and (got & ~truth).sum() <= 0.015 * got.sum()
