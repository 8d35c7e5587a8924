import random
import time
import zlib

import numpy as np
import pytest

from fluxweave.llm import toxicity
from fluxweave.llm.toxicity import Model

from .conftest import prose


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best one, then both sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[2] + 1e-9):  # first and shortest of equals
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i]) + [best] + [(a + j, b + j, v) for a, b, v in brute_segments(scores[j:])]


@pytest.mark.parametrize("seed", range(30))
def test_linear_scan_finds_all_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-0.37, rng.uniform(0.1, 3)]) for _ in range(rng.randint(1, 25))]
    m = Model(background=-0.37)
    at = np.array([i for i, s in enumerate(scores) if s > 0], np.int64)
    got = m.passages(at, np.array([scores[i] for i in at]))
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        w = prose(rng, rng.randint(20, 120)).split(" ")
        for _ in range(rng.randint(3, 8) if toxic else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["nastyword", "vilething", "rudezza" + rng.choice("abc"), "uglyone,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def fit(docs, labels, max_train=20_000):
    return toxicity.fit(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", max_train))


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in held) / len(held) > 0.97
    assert all(r.n_passages >= 1 for r in held if r.score >= 0.9)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.5}


def test_bounded_training_still_learns(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, fit(docs, labels, 200)).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.9


def test_odd_inputs(spark, labelled, clashing, empty):
    docs, labels = labelled
    model = fit(docs, labels)
    assert toxicity.score(empty, model).count() == 0
    got = toxicity.score(clashing, model)
    assert got.count() == clashing.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.drop_toxic(clashing, model).columns == clashing.columns
    none = labels.where("doc_id < 0")
    assert {r.score for r in toxicity.score(docs, fit(docs, none)).collect()} == {0.0}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, fit(docs, odd)).count() == docs.count()


@pytest.mark.parametrize("seed", range(5))
def test_long_texts_with_many_hits(seed):
    """Every spaced hit of a very long text in linear time, and the same passages as a plain quadratic scan finds."""
    rng, n = np.random.default_rng(seed), 100_000
    at = np.flatnonzero(rng.random(4 * n) < 0.25)[:n]
    scores, m = rng.uniform(0.1, [1.0, 2.0, 1.3, 5.0, 0.4][seed], len(at)), Model(background=[-0.3, -0.35, -0.2, -2.0, -0.05][seed])
    began = time.perf_counter()
    got = m.passages(at, scores)
    assert time.perf_counter() - began < 5

    def plain(k):
        found, total, before = [], 0.0, 0
        for p, s in zip(at[:k].tolist(), scores[:k].tolist(), strict=True):
            total += m.background * (p - before)
            left, total, before = total, total + s, p + 1
            new = [left, total, p, p + 1]
            while True:
                j = max((i for i, x in enumerate(found) if x[0] < new[0]), default=-1)
                if j < 0 or found[j][1] >= new[1]:
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
            found.append(new)
        return [(a, b) for *_, a, b in found]

    assert [(a, b) for a, b, _ in m.passages(at[:600], scores[:600])] == plain(600)
    assert len(got) == len({a for a, *_ in got})
