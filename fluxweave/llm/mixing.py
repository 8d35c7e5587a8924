"""Soft-membership mixing of sources to target weights.

The domains and their priors are those of all rows.  A multinomial classifier over hashed words, learned from rows of the
labelled table (about ``max_train`` of them, chosen by a hash of the id, and at least about ``min_train`` of each domain
that has them; a domain without labelled rows is learned from rows of its own), predicts each document's domain posteriors; evidence is tempered to ``evidence`` words,
so long texts keep soft memberships.  Document rates r >= 0 then solve a least-squares fit of the expected domain
totals sum(r * tokens * posterior) to the targets by accelerated projected gradient steps from rates of 1 (in the metric of
the tokens, with the largest eigenvalue of the posteriors' Gram matrix as their Lipschitz constant, restarted where the
distance grows), until the targets are met or rates move by less than ``still`` (root mean square by tokens).  With
``relative`` a domain's distance counts relative to the root of its tokens, so that rare domains are met in as few steps
as frequent ones.  ``converged`` and ``residual`` say how it ended, and ``optimality`` is how far (root mean square by
tokens) one more plain projected step would move the rates: 0 at the best ones.
Each step is one distributed sum of a few numbers.  A document's rate follows from its own posteriors and the list of
steps, so no state is kept per document.

Default targets flatten the domains' expected shares (to the power ``flatten``).  With ``keep_all`` their total is the one
at which the most over-represented domain keeps its tokens, and rates are at least 1: they repeat the rarer domains and
drop nothing.  Without it the total stays that of the corpus, and rates are at least 0.

Defined results: null and empty texts have no tokens, the prior as posteriors and a rate that touches no total; null
domains are not learned from; without labelled rows there is one domain and all rates are 1; repeated rows count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_arrow, materialize

BUCKETS = 1 << 14


@dataclass
class Model:
    domains: list[str]
    log_prior: np.ndarray
    log_word: np.ndarray  # [bucket, domain]
    evidence: float
    floor: float = 0.0  # the least rate
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)  # what posteriors are multiplied with, and the momentum
    converged: bool = True
    residual: float = 0.0  # the largest distance to a target, of the total
    optimality: float = 0.0  # how far a projected step still moves the rates
    slope: np.ndarray | None = None  # that step: what posteriors are multiplied with

    def posteriors(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of each row."""
        rows = w.row1 - w.row0
        bucket = (w.hash() >> np.uint64(50)).astype(np.int64)
        total = np.stack([np.bincount(K.row_of(w.off), weights=self.log_word[bucket, k], minlength=rows) for k in range(len(self.domains))], 1)
        logit = total * np.minimum(1.0, self.evidence / np.maximum(w.counts, 1))[:, None] + self.log_prior
        p = np.exp(logit - logit.max(1, keepdims=True))
        return w.counts, p / p.sum(1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.last_rates(p)[0]

    def last_rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates, and those of one step before."""
        before = r = np.ones(len(p))
        for s, momentum in self.steps:
            r, before = np.maximum(self.floor, r + momentum * (r - before) - p @ s), r
        return r, before


def _domains(docs: DataFrame, domain_col: str) -> DataFrame:
    return docs.where(F.col(domain_col).isNotNull()).withColumn("_domain", F.col(domain_col).cast("string"))


def fit_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_train: int = 20_000,
                   min_train: int = 200, max_domains: int = 256, evidence: float = 32.0) -> Model:
    """The domains and their priors come from all rows; only the words of each domain are learned from a sample."""
    sizes = {r._domain: r.n for r in _domains(docs, domain_col).groupBy("_domain").agg(F.count("*").alias("n")).limit(max_domains + 1).collect()}
    if len(sizes) > max_domains:
        raise ValueError(f"over {max_domains} domains")
    ids = labels.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    own = _domains(docs, domain_col).select(id_col, "_domain").distinct()
    labelled = materialize(own.join(ids, id_col))
    seen = {r._domain: r.n for r in labelled.groupBy("_domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    if not seen:
        return Model(["all"], np.zeros(1), np.zeros((BUCKETS, 1)), evidence)
    domains = sorted(sizes)
    # about max_train labelled rows and min_train of each domain; a domain without labelled rows lends min_train of its own
    share = max_train / sum(seen.values())
    part = {d: max(share, min_train / seen[d]) if d in seen else min_train / sizes[d] for d in domains}
    cuts = docs.sparkSession.createDataFrame([(d, math.ceil(min(1.0, x) * 1_000_000), d in seen) for d, x in part.items()], "_domain string, _cut long, _seen boolean")
    under = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.col("_cut")
    chosen = labelled.join(F.broadcast(cuts), "_domain").where(under).select(id_col, "_domain")
    if len(seen) < len(domains):
        chosen = chosen.unionByName(own.where(F.col(id_col).isNotNull()).join(F.broadcast(cuts.where("not _seen")), "_domain").where(under).select(id_col, "_domain"))
    texts = _domains(docs.select(id_col, F.col(text_col).alias("_text"), domain_col), domain_col)
    train = materialize(texts.join(F.broadcast(chosen), [id_col, "_domain"]).select("_text", "_domain"))  # small enough to broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), BUCKETS), np.int64)
        for batch in batches:
            of = np.array([domains.index(d) for d in batch.column("_domain").to_pylist()], np.int64)
            for w in K.words(batch.column("_text"), K.SPACE):
                np.add.at(total, (of[w.row0 + K.row_of(w.off)], (w.hash() >> np.uint64(50)).astype(np.int64)), 1)
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[d, b])], ["domain", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(domains)))
    got = train.transform(map_arrow, count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most domains * BUCKETS rows
    counts[got["bucket"].to_numpy(), got["domain"].to_numpy()] = got["n"].to_numpy()
    back = counts.sum(1, keepdims=True) + 0.5
    smooth = counts + 200.0 * back / back.sum()
    prior = np.array([sizes[d] for d in domains], float)  # of all rows
    return Model(domains, np.log(prior / prior.sum()), np.log(smooth / smooth.sum(0)), evidence)


def memberships(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(n, p) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in K.words(batch.column("_text"), K.SPACE):
                n, p = model.posteriors(w)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], ["n", "p"])

    return docs.select(F.col(text_col).alias("_text")).transform(map_arrow, run, "n long, p array<double>")


def fit_rates(members: DataFrame, model: Model, *, targets: dict[str, float] | None = None, total: float | None = None, flatten: float = 0.7, keep_all: bool = True,
              relative: bool = False, max_steps: int = 60, tolerance: float = 1e-6, still: float = 1e-4) -> Model:
    """The model with the steps that bring the expected domain totals to the targets (shares by domain, times total).

    A given total sets rates of at least 0, as ``keep_all=False`` does.  A target without a domain is an error.
    """
    absent = sorted(d for d, x in (targets or {}).items() if x > 0 and d not in model.domains)
    if absent:
        raise ValueError(f"targets without a domain: {', '.join(absent)}")
    k = len(model.domains)
    model.floor = 1.0 if keep_all and total is None else 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, gram, moved, left = np.zeros(k), np.zeros((k, k)), 0.0, 0.0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            p = batch.column("p").flatten().to_numpy().reshape(len(n), k)
            r, before = model.last_rates(p)
            reached += (r * n) @ p
            gram += (p * n[:, None]).T @ p
            moved += float(n @ (r - before) ** 2)
            if model.slope is not None:
                left += float(n @ (r - np.maximum(model.floor, r - p @ model.slope)) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array([[*reached, *gram.ravel(), moved, left]], pa.list_(pa.float64()))], ["v"])

    def gathered() -> tuple[np.ndarray, np.ndarray, float, float]:
        each = F.posexplode("v").alias("i", "x")
        v = np.zeros(k + k * k + 2)
        for r in members.transform(map_arrow, sums, "v array<double>").select(each).groupBy("i").agg(F.sum("x").alias("x")).collect():
            v[r.i] = r.x
        return v[:k], v[k:-2].reshape(k, k), v[-2], v[-1]

    model.steps, model.slope = [], None
    reached, gram, _, _ = gathered()
    if reached.sum() <= 0:
        return model
    tokens = reached.sum()
    if targets is None:
        share = (reached / tokens) ** flatten * (reached > 0)
    else:
        share = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    share = share / share.sum()
    if total is None:
        total = max(reached[i] / share[i] for i in range(k) if share[i] > 0) if keep_all else tokens
    goal = share * total
    weight = 1 / np.maximum(reached, 1e-9 * tokens) if relative else np.ones(k)
    lipschitz = np.linalg.eigvalsh(gram * np.sqrt(np.outer(weight, weight)))[-1]
    before, pace, best, moved = reached, 1.0, np.inf, np.inf
    for step in range(max_steps + 1):
        distance = np.linalg.norm((reached - goal) * np.sqrt(weight))
        model.residual = float(np.abs(reached - goal).max() / total)
        # the targets are met, or the rates are as near as their bound lets them come
        model.converged = model.residual <= tolerance or moved <= still**2 * tokens
        if model.converged or step == max_steps:
            break
        if distance > best:
            pace, before = 1.0, reached
        faster = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        momentum = (pace - 1) / faster
        best, pace = distance, faster
        ahead = reached + momentum * (reached - before)
        model.steps.append((weight * (ahead - goal) / lipschitz, momentum))
        before = reached
        reached, _, moved, _ = gathered()
    model.slope = weight * (reached - goal) / lipschitz
    model.optimality = math.sqrt(gathered()[3] / tokens)
    return model


def mix(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, posteriors (by ``model.domains``), rate and copies."""
    head = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in K.words(batch.column("_text"), K.SPACE):
                n, p = model.posteriors(w)
                r, size = model.rates(p), w.row1 - w.row0
                copies = _copies(r, batch.column("__draw").slice(w.row0, size).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(w.row0, size), pa.array(n.astype(np.int64)), pa.array(list(np.round(p, 9)), pa.list_(pa.float64())), pa.array(np.round(r, 9)), pa.array(copies)], ["_id", "n_tokens", "posteriors", "rate", "copies"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _draw(id_col, text_col))
    return rows.transform(map_arrow, run, f"_id {head}, n_tokens long, posteriors array<double>, rate double, copies long").withColumnRenamed("_id", id_col)


def _draw(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("__draw")


def _copies(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """floor(rate), and one more with the probability of the rest, drawn from the row's hash."""
    return (np.floor(rate) + (u.astype(np.uint64) / 2.0**64 < rate - np.floor(rate))).astype(np.int64)


def resample(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as many times as its rate asks for, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.concatenate([_copies(model.rates(model.posteriors(w)[1]), batch.column("__draw").slice(w.row0, w.row1 - w.row0).to_numpy()) for w in K.words(batch.column(text_col), K.SPACE)] or [np.zeros(0, np.int64)])
            out = batch.select(batch.schema.names[:-1])
            for i in range(0, len(times), 500):  # a row at most max(times) times, in small batches
                yield out.take(pa.array(np.repeat(np.arange(i, min(i + 500, len(times))), times[i : i + 500])))

    return docs.select("*", _draw(id_col, text_col)).transform(map_arrow, run, docs.schema)
