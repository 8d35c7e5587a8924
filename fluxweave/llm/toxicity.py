"""Toxicity by maximal scoring segments over token log-odds.

Learning (labelled rows that are not held out; at most about ``max_train`` of them, chosen by a hash of the id):
words and their 4 to 6 byte prefixes get Dirichlet-smoothed log-odds of occurring in toxic documents; those of at
least ``min_z`` standard errors form the lexicon.  Each training token then belongs to its most significant entry or
to the background, and the Dirichlet-smoothed token shares of toxic and clean documents give every entry, and the
background, a log-likelihood ratio.  Words of the background that training saw have ratios of their own, under a
Dirichlet prior of the pooled shares with ``weight`` times the tokens there are; those under the background's count as they are, the
others as the background.  Since scores are log ratios, the extreme-value parameter lambda is 1, and K has a closed-form
estimate from clean documents.

Scoring: a linear scan finds every maximal segment of positive score (passages); each has the E-value K n exp(-S), and
the best r segments of a document are aggregated by their sum statistic.  A logistic curve over -ln P, fitted on the
training rows, gives the score.

Everything is one vectorised scan of the texts; the model holds at most the words of the training rows.

Defined results: null and empty texts have no tokens and get the score of a text without a passage; labels that are
null are not learned from; several labels of one id count as the largest; without both classes the score is the share
of the class seen (0 without any label).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import crc_mod, map_arrow, materialize

PREFIXES = (4, 5, 6)
KINDS = (0, *PREFIXES)


def features(w: K.Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each kind the key of every word and whether the word has one; 0: the word, k: its first k bytes."""
    lens = w.ends - w.starts
    out = {0: (w.hash(), np.ones(len(lens), bool))}
    packed = np.zeros(len(lens), np.uint64)
    padded = np.concatenate([w.data, np.zeros(max(PREFIXES), np.uint8)])
    for k in range(max(PREFIXES)):
        packed |= padded[w.starts + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            out[k + 1] = (packed.copy(), lens >= k + 1)
    return out


@dataclass
class Model:
    keys: dict[int, np.ndarray] = field(default_factory=dict)  # sorted keys of each kind
    entry: dict[int, np.ndarray] = field(default_factory=dict)  # their lexicon entries
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    background: float = -0.01
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted keys of words under the background
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))  # their scores
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def match(self, w: K.Words) -> np.ndarray:
        """The lexicon entry of each word, -1: background."""
        best = np.full(len(w.starts), -1, np.int64)
        best_z = np.full(len(w.starts), -np.inf)
        for kind, (keys, valid) in features(w).items():
            known = self.keys.get(kind)
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero((known[at] == keys) & valid)
            e = self.entry[kind][at[hit]]
            better = self.z[e] > best_z[hit]
            best[hit[better]], best_z[hit[better]] = e[better], self.z[e[better]]
        return best

    def passages(self, positions: np.ndarray, scores: np.ndarray, between: np.ndarray | None = None) -> list[tuple[int, int, float]]:
        """All maximal segments [start, end) in one linear scan; ``between``: what the tokens before each position and after
        the last one score together (the background for each if not given).

        Each segment knows the nearest earlier one that begins lower, so no search passes the same segment twice.
        """
        if between is None:
            between = self.background * (np.diff(positions, prepend=-1) - 1)
        found: list[tuple[float, float, int, int, int]] = []  # sums before and after, start, end, the last one that begins lower
        total = 0.0
        for p, s, gap in zip(positions.tolist(), scores.tolist(), between.tolist(), strict=True):
            total += gap
            if s <= 0:
                total += s
                continue
            left, right, start, j = total, total + s, p, len(found) - 1
            total = right
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            while j >= 0 and found[j][1] < right:
                left, _, start, _, lower = found[j]
                del found[j:]
                j = lower
            found.append((left, right, start, p + 1, j))
        return [(a, b, r - lo) for lo, r, a, b, _ in found]

    def statistic(self, sums: list[float], n: int) -> float:
        """-ln P of the best sum statistic."""
        best, t = 0.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            t += s - math.log(max(self.k * n, 1e-12))
            if t <= 0:
                break
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) if t > r else 0.0)
        return best

    def of(self, w: K.Words) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """(row, words, passages) of each row."""
        entry = self.match(w)
        at = np.flatnonzero(entry >= 0)
        scores, bounds, n = self.score[entry[at]], np.searchsorted(at, w.off), w.counts
        each = np.full(len(entry), self.background)
        if len(self.words):
            key = w.hash()
            k = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
            each = np.where(self.words[k] == key, self.below[k], each)
        each[at] = 0.0
        run = np.concatenate([[0.0], np.cumsum(each)])
        before = run[at]  # the scores of all tokens before it but those of the lexicon
        for r in range(w.row1 - w.row0):
            a, b = bounds[r], bounds[r + 1]
            yield w.row0 + r, int(n[r]), self.passages(at[a:b] - w.off[r], scores[a:b], np.diff(before[a:b], prepend=run[w.off[r]])) if a < b else []

    def probability(self, x: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.shift))))


def held_out(id_col: Column) -> Column:
    return crc_mod(id_col, 5) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    total = known.count()
    share = min(1.0, max_train / max(total, 1))
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))  # about max_train rows: small enough to broadcast
    return materialize(docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(known), id_col).select("_text", "_y"))


def fit(train: DataFrame, *, min_z: float = 4.0, prior: float = 10.0, weight: float = 4.0, max_lexicon: int = 20_000) -> Model:
    spark = train.sparkSession
    sizes = {r._y: r.n for r in train.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1 = sum(v for y, v in sizes.items() if y == 1)
    n0 = sum(sizes.values()) - n1
    if not n1 or not n0:
        return Model(constant=float(n1 > 0))
    pi = n1 / (n0 + n1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_y").to_numpy()
            for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                row = K.row_of(w.off)
                for kind, (keys, valid) in features(w).items():
                    pair = np.unique(np.stack([row[valid].astype(np.uint64), keys[valid]], 1), axis=0) if valid.any() else np.zeros((0, 2), np.uint64)
                    got, where = np.unique(pair[:, 1], return_inverse=True)
                    toxic = np.bincount(where, weights=y[w.row0 + pair[:, 0].astype(np.int64)] == 1, minlength=len(got))
                    docs_ = np.bincount(where, minlength=len(got))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), kind, np.int32)), pa.array(got.astype(np.int64)), pa.array(docs_.astype(np.int64)), pa.array(toxic.astype(np.int64))], ["kind", "key", "n", "n1"])

    counts = train.transform(map_arrow, count, "kind int, key long, n long, n1 long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    a1, a0 = prior * pi, prior * (1 - pi)
    y1, y0 = F.col("n1") + F.lit(a1), F.col("n") - F.col("n1") + F.lit(a0)
    counts = counts.withColumn("z", (F.log(y1 / y0) - math.log(pi / (1 - pi))) / F.sqrt(1 / y1 + 1 / y0))
    lexicon = counts.where(F.col("z") >= min_z).orderBy(F.desc("z"), "kind", "key").limit(max_lexicon).collect()
    model = Model(z=np.array([r.z for r in lexicon]))
    for kind in KINDS:
        own = sorted((r.key % 2**64, i) for i, r in enumerate(lexicon) if r.kind == kind)
        model.keys[kind] = np.array([k for k, _ in own], np.uint64)
        model.entry[kind] = np.array([i for _, i in own], np.int64)
    m = len(lexicon)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m + 1), np.int64)
        for batch in batches:
            y = (batch.column("_y").to_numpy() == 1).astype(np.int64)
            for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                entry = model.match(w)
                np.add.at(total, (y[w.row0 + K.row_of(w.off)], np.where(entry < 0, m, entry)), 1)
        c, e = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(total[c, e])], ["y", "entry", "n"])

    got = np.zeros((2, m + 1))
    for r in train.transform(map_arrow, tokens, "y int, entry int, n long").groupBy("y", "entry").agg(F.sum("n").alias("n")).collect():
        got[r.y, r.entry] = r.n
    share = got.sum(0) / max(got.sum(), 1)
    smooth = (got + prior * share) / (got.sum(1, keepdims=True) + prior)
    llr = np.log(np.maximum(smooth[1], 1e-300)) - np.log(np.maximum(smooth[0], 1e-300))
    model.score, model.background = llr[:m], min(float(llr[m]), -1e-6)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of the background by word."""
        for batch in batches:
            y = (batch.column("_y").to_numpy() == 1).astype(np.int64)
            for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                free = model.match(w) < 0
                key, where = np.unique(w.hash()[free], return_inverse=True)
                toxic = np.bincount(where, weights=y[w.row0 + K.row_of(w.off)[free]], minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.bincount(where, minlength=len(key))), pa.array(toxic.astype(np.int64))], ["key", "n", "n1"])

    per_word = train.transform(map_arrow, others, "key long, n long, n1 long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).toArrow()  # the words of the training rows
    n, n1_ = per_word["n"].to_numpy().astype(float), per_word["n1"].to_numpy().astype(float)
    size0, size1 = got.sum(1)
    size = size0 + size1
    own = np.log((n1_ + weight * n) / (size1 + weight * size)) - np.log((n - n1_ + weight * n) / (size0 + weight * size))
    low = own < model.background
    by = np.argsort(per_word["key"].to_numpy()[low].view(np.uint64))
    model.words, model.below = per_word["key"].to_numpy()[low].view(np.uint64)[by], own[low][by]
    shared = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = [], []
            for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                for _, words, found in shared.value.of(w):
                    s.append([x[2] for x in found])
                    n.append(words)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["y", "n", "s"])

    scored = materialize(train.transform(map_arrow, sums, "y int, n long, s array<double>"))
    clean = scored.where("y <> 1 and n > 0").agg(F.count("*").alias("c"), F.sum(F.col("n") * F.exp(-F.coalesce(F.array_max("s"), F.lit(0.0)))).alias("v")).first()
    model.k = clean.c / clean.v if clean.c else 1.0

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [round(min(model.statistic(s, n), 200.0), 1) for s, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    histogram = scored.transform(map_arrow, stats, "y int, x double").groupBy("x").agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("n1")).orderBy("x").collect()
    model.slope, model.shift = _logistic(np.array([r.x for r in histogram]), np.array([r.n for r in histogram], float), np.array([r.n1 for r in histogram], float))
    return model


def _logistic(x: np.ndarray, n: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Ridge-penalised logistic curve of class shares over x."""
    beta, design = np.zeros(2), np.stack([np.minimum(x, 50.0), np.ones(len(x))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n1 - n * p) - np.array([1e-2, 1e-4]) * beta
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


REPORT = "score double, n_passages long, passages array<struct<start:long,end:long,evalue:double>>"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05) -> DataFrame:
    """id, score, and the significant passages (word ranges with E-values up to ``alpha``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p, where = [], []
            for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                for _, n, found in m.of(w):
                    p.append(m.probability(m.statistic([x[2] for x in found], n)))
                    e = [(a, b, m.k * n * math.exp(-s)) for a, b, s in found]
                    where.append([{"start": a, "end": b, "evalue": v} for a, b, v in e if v <= alpha])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(p, pa.float64()), pa.array([len(x) for x in where], pa.int64()), pa.array(where, kind)], ["_id", "score", "n_passages", "passages"])

    head = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).transform(map_arrow, run, f"_id {head}, {REPORT}").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score under the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = [m.probability(m.statistic([x[2] for x in found], n)) < threshold for w in K.words(batch.column(text_col), K.NOT_ALNUM) for _, n, found in m.of(w)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(map_arrow, run, docs.schema)
