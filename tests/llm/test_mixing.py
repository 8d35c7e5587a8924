import random

import numpy as np
import pytest

from fluxweave.llm import mixing
from fluxweave.llm.common import materialize

WORDS = {"en": [f"en{k}" for k in range(50)], "de": [f"de{k}" for k in range(50)], "fr": [f"fr{k}" for k in range(50)]}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        d = rng.choices(list(WORDS), [6, 3, 1])[0]
        other = rng.choice(list(WORDS))
        n = rng.randint(1, 60)
        rows.append((i, " ".join(rng.choice(WORDS[d] if rng.random() < 0.8 else WORDS[other]) for _ in range(n)), d))
    labels = [(i,) for i in range(0, 300, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long")


def fitted(docs, labels, **options):
    model = mixing.fit_classifier(docs, labels)
    return mixing.fit_rates(materialize(mixing.memberships(docs, model, "text")), model, **options)


def totals(rows, rate):
    p, n = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows])
    return (p * (n * rate)[:, None]).sum(0)


def test_expected_totals_meet_the_targets(tables):
    docs, labels = tables
    model = fitted(docs, labels, targets={"en": 1, "de": 1, "fr": 1}, total=9000.0)
    rows = mixing.mix(docs, model).collect()
    got = totals(rows, np.array([r.rate for r in rows]))
    assert got == pytest.approx(np.full(3, got.mean()), rel=1e-4)
    assert min(r.rate for r in rows) >= 0


def test_default_rates_drop_nothing(tables):
    docs, labels = tables
    rows = mixing.mix(docs, fitted(docs, labels)).collect()
    assert min(r.rate for r in rows) >= 1
    assert np.mean([r.copies for r in rows]) == pytest.approx(np.mean([r.rate for r in rows]), rel=0.1)


def test_projection_reaches_the_best_nonnegative_rates(tables):
    """Where a target can't be met, the distance to it is as small as a long plain projected descent makes it."""
    docs, labels = tables
    model = fitted(docs, labels, targets={"en": 0.0, "de": 0.0, "fr": 1.0}, total=500.0)
    rows = mixing.mix(docs, model).collect()
    p, n = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows], float)
    goal, a = np.array([{"en": 0, "de": 0, "fr": 500.0}[d] for d in model.domains]), p * n[:, None]
    r = np.ones(len(rows))
    step = 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(30_000):
        r = np.maximum(0, r - step * a @ (a.T @ r - goal))
    best = np.linalg.norm(a.T @ r - goal)
    got = np.linalg.norm(totals(rows, np.array([x.rate for x in rows])) - goal)
    assert got <= best + 0.05 * 500


def test_classifier_accuracy(tables):
    docs, labels = tables
    model = mixing.fit_classifier(docs, labels)
    rows = mixing.mix(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1 and n_tokens > 20").collect()
    assert np.mean([model.domains[int(np.argmax(r.posteriors))] == r.lang for r in rows]) > 0.95


def test_resampling_follows_the_copies(tables):
    docs, labels = tables
    model = fitted(docs, labels)
    want = {r.doc_id: r.copies for r in mixing.mix(docs, model).collect()}
    got = {r.doc_id: r["count"] for r in mixing.resample(docs, model).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_odd_inputs(tables, clashing, empty):
    _, labels = tables
    model = fitted(clashing, labels)
    assert mixing.mix(clashing, model).count() == clashing.count()
    out = mixing.resample(clashing, model)
    assert out.columns == clashing.columns
    assert mixing.mix(empty, fitted(empty, labels)).count() == 0
    alone = fitted(clashing, labels.where("doc_id < 0"))
    assert {r.rate for r in mixing.mix(clashing, alone).collect()} == {1.0}


def test_rare_domains_are_kept_whatever_the_sample(spark):
    """The domains are those of all rows, not of the sample; each is learned from its own words."""
    rows = [(i, f"en{i % 7} en{i % 5} common", "en") for i in range(4000)] + [(4000 + i, f"xx{i % 3} xx{i % 2} xx common", "xx") for i in range(8)]
    rows += [(5000 + i, f"zz{i % 3} zz zz common", "zz") for i in range(8)]  # none of them is labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = mixing.fit_classifier(docs, docs.where("lang <> 'zz'").select("doc_id"), max_train=40)
    assert model.domains == ["en", "xx", "zz"]
    assert np.exp(model.log_prior) == pytest.approx(np.array([4000, 8, 8]) / 4016)
    near = {r.doc_id: r.posteriors for r in mixing.mix(docs.where("doc_id >= 3990"), model).collect()}
    # the rarity of a domain stays in its prior, its words speak for it
    lift = {i: np.log(p) - model.log_prior for i, p in near.items()}
    assert {model.domains[int(np.argmax(lift[i]))] for i in range(3990, 4000)} == {"en"}
    assert {model.domains[int(np.argmax(lift[i]))] for i in range(4000, 4008)} == {"xx"}
    assert {model.domains[int(np.argmax(lift[i]))] for i in range(5000, 5008)} == {"zz"}


def test_targets_need_a_domain(tables):
    with pytest.raises(ValueError, match="xx"):
        fitted(*tables, targets={"en": 1.0, "xx": 1.0}, total=100.0)


def test_rates_under_one_keep_the_corpus_total(tables):
    """Without keep_all rarer domains grow and frequent ones shrink, to flattened shares of the same total."""
    docs, labels = tables
    model = fitted(docs, labels, keep_all=False)
    rows = mixing.mix(docs, model).collect()
    rate = np.array([r.rate for r in rows])
    before, after = totals(rows, np.ones(len(rows))), totals(rows, rate)
    assert model.converged
    assert after.sum() == pytest.approx(before.sum(), rel=1e-3)
    want = (before / before.sum()) ** 0.7
    assert after / after.sum() == pytest.approx(want / want.sum(), rel=1e-2)
    assert 0 <= rate.min() < 1 < rate.max()


def test_targets_out_of_reach_end_at_the_bound(tables):
    docs, labels = tables
    model = fitted(docs, labels, targets={"fr": 1.0}, total=500.0, max_steps=400)
    rows = mixing.mix(docs, model).collect()
    p, n = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows], float)
    r, goal = np.array([x.rate for x in rows]), np.array([500.0 * (d == "fr") for d in model.domains])
    slope = p @ (totals(rows, r) - goal)  # at the best rates no row with tokens could move: none up, and none down but from 0
    free = (n > 0) & ((slope < 0) | (r > 0))
    assert np.abs(slope[free] * n[free]).max() < 0.02 * 500 * n.max()
    assert model.residual > 0


def best_rates(p, n, goal, weight, steps=200_000):
    """A long plain projected descent of the weighted least squares, in the metric of the tokens."""
    r, length = np.ones(len(n)), np.linalg.eigvalsh((p * n[:, None]).T @ p * np.sqrt(np.outer(weight, weight))).max()
    for _ in range(steps):
        new = np.maximum(0, r - p @ (weight * ((r * n) @ p - goal)) / length)
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


def test_uniform_targets_take_projected_steps(tables):
    docs, labels = tables
    model = fitted(docs, labels, keep_all=False, flatten=0.0, relative=True)
    rows = mixing.mix(docs, model).collect()
    got = totals(rows, np.array([r.rate for r in rows]))
    assert got == pytest.approx(np.full(3, sum(r.n_tokens for r in rows) / 3), rel=1e-3)
    assert len(model.steps) > 1
    assert model.converged
    assert model.optimality < 1e-3


def test_some_rates_end_at_zero(tables):
    """A target of nothing for a domain puts its documents at 0; a long plain descent comes no nearer."""
    docs, labels = tables
    model = fitted(docs, labels, targets={"en": 0.0, "de": 1.0, "fr": 1.0}, keep_all=False, relative=True)
    rows = [r for r in mixing.mix(docs, model).collect() if r.n_tokens]
    p, n, rate = np.array([r.posteriors for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    start = n @ p
    goal = np.array([0.5 * n.sum() * (d != "en") for d in model.domains])
    want = best_rates(p, n, goal, 1 / start)
    distance = lambda r: np.linalg.norm(((r * n) @ p - goal) / np.sqrt(start))
    assert distance(rate) <= distance(want) + 1e-2 * distance(np.ones(len(n)))
    assert (rate == 0).sum() > len(rows) / 4
    assert model.optimality < 1e-3
