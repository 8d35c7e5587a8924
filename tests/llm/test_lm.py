import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.llm import class_lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall((t or "").encode())] + [b"\0end"]


@pytest.mark.parametrize("head_share", [1e-6, 0.01, 1.0])
def test_base_score_is_exact_and_the_model_normalises(docs, corpus, head_share):
    got = {r.doc_id: r for r in class_lm.score(docs, classes=8, head_share=head_share).collect()}
    count = Counter(w for i, t, *_ in corpus if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t, *_ in corpus:
        r, w = got[i], tokens(t)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert len(got) == len(corpus)


def test_head_and_tail_paths_agree(docs):
    a = {r.doc_id: r.score for r in class_lm.score(docs, classes=8, head_share=1e-9).collect()}
    b = {r.doc_id: r.score for r in class_lm.score(docs, classes=8, head_share=5e-4).collect()}
    assert a == pytest.approx(b)


def test_probabilities_sum_to_one(docs):
    train = docs.select(F.col("text").alias("_text"))
    vocab = class_lm.vocabulary(train)
    m = class_lm.fit(train, vocab, classes=8)
    first = m.size - class_lm.SUFFIXES
    words = np.zeros(m.size)
    words[:first] = 1  # own types are one word each; others hold their words and one unknown
    for r in vocab.collect():
        at = np.searchsorted(m.keys, r.key)
        own = r.key == int(class_lm.END) or (at < len(m.keys) and m.keys[at] == r.key and m.types[at] >= 0)
        if not own:
            s = first + (r.key & (class_lm.SUFFIXES - 1))
            words[s] += (r.n + 1) * 10 ** m.within[s]
    words[first:] += 10 ** m.within[first:]
    used = np.arange(m.size) != (first - 1 if m.end != first - 1 else -1)
    assert words[first:] == pytest.approx(np.ones(class_lm.SUFFIXES))
    given = np.array([(10 ** m.step[c, m.cls] * 10**m.emit * words)[used].sum() for c in range(len(m.step))])
    assert given == pytest.approx(np.ones(len(given)), rel=1e-2)


def test_exchange_finds_blocks():
    rng = np.random.default_rng(0)
    b = np.zeros((20, 20))
    for i in range(20):
        for j in range(20):
            b[i, j] = rng.poisson(40 if (i < 10) != (j < 10) else 1)
    cls = class_lm.exchange(b, 2)
    assert len(set(cls[:10])) == 1
    assert len(set(cls[10:])) == 1
    assert cls[0] != cls[10]


def likelihood(b, cls):
    """The class-bigram log likelihood of counts, by definition and without the part that classes do not touch."""
    cc, out, into = Counter(), Counter(), Counter()
    for i, j in zip(*np.nonzero(b), strict=True):
        cc[cls[i], cls[j]] += b[i, j]
        out[cls[i]] += b[i, j]
        into[cls[j]] += b[i, j]
    f = lambda c: sum(x * math.log(x) for x in c.values())
    return f(cc) - f(out) - f(into)


@pytest.mark.parametrize("seed", range(4))
def test_exchange_equals_brute_force(seed):
    """Each move goes to the best class by the likelihood of the whole, computed anew; at the end no single move helps."""
    rng = np.random.default_rng(seed)
    b = rng.poisson(rng.gamma(0.4, 6.0, (14, 14))).astype(float)
    k, weight = 4, b.sum(0) + b.sum(1)
    ranked = np.argsort(-weight, kind="stable")
    cls = np.empty(14, int)
    cls[ranked] = np.arange(14) % k
    for _ in range(12):
        before = cls.copy()
        for w in ranked:
            values = []
            for c in range(k):
                now = cls.copy()
                now[w] = c
                values.append(likelihood(b, now))
            if max(values) > values[cls[w]] + 1e-9:
                cls[w] = int(np.argmax(values))
        if (before == cls).all():
            break
    got = class_lm.exchange(b, k)
    assert likelihood(b, got) == pytest.approx(likelihood(b, cls))
    assert got.tolist() == cls.tolist()


def test_learns_order(spark):
    rows = [(i, "ein haus und ein baum " * 20 if i % 2 else "the house and the tree " * 20) for i in range(40)]
    got = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), classes=4).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_odd_inputs(spark, clashing, empty):
    assert class_lm.score(empty).count() == 0
    assert class_lm.score(clashing).count() == clashing.count()
    alone = spark.createDataFrame([(None, None)], "doc_id long, text string")
    r = class_lm.score(alone).first()
    assert (r.n_tokens, r.held_out) == (1, False)


def test_every_counted_word_gets_a_class_by_its_contexts(spark):
    """Rare words of two kinds, whose endings say nothing, go to their kinds' classes; only unseen words are endings."""
    rows = [(i, f"the n{i % 400}x barks the dog barks the cat barks we v{i % 400}x it we see it we like it") for i in range(1200)]
    train = spark.createDataFrame(rows, "doc_id long, _text string").select("_text")
    m = class_lm.fit(train, class_lm.vocabulary(train), classes=8, type_share=0.01)
    kind = {}
    for b in "nv":
        w = next(class_lm.K.words(class_lm.pa.array([" ".join(f"{b}{k}x" for k in range(400))]), class_lm.K.SPACE))
        keys = class_lm.word_keys(w)
        at = np.searchsorted(m.keys, keys)
        assert (m.keys[at] == keys).all()
        assert (m.types[at] >= 0).all()
        kind[b] = set(m.cls[m.types[at]].tolist())
    assert len(kind["n"]) == len(kind["v"]) == 1
    assert kind["n"] != kind["v"]
