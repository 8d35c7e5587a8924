"""LM scoring by a class-based bigram model whose classes cover every counted word.

Counts come from all training documents, and every word of them is a type with a class of its own.  Exchange
clustering finds the classes from the most frequent words (those of at least ``type_share`` of all tokens, at most
1/type_share of them, with one of ``SUFFIXES`` endings in the place of each other word): it moves one type at a time
to the class that most raises the class-bigram likelihood.  Two sweeps over the distributed text then move words at
once, each to the class that is likeliest by its own counts of the classes before and after it: first the words of at
least ``sweep_share`` of the tokens, then, next to those words' new classes, every word but the first ones.  The class
bigrams are counted anew with the classes of all words.  Only words that no training document holds are known by
their ending alone.

P(word | history) = P(class | previous class) * P(word | class), each smoothed and summing to one over the known words
plus one unknown word for each ending.

Scale: the table of words and classes stays distributed and grows with the input.  Words of at least ``head_share`` of
the tokens (at most 1/head_share of them) are looked up from a broadcast copy; the classes and counts of all rarer
words meet their documents in one shuffle join, whose keys are rare by construction.

Defined results: null and empty texts are one end token; null ids count as not held out; repeated rows are scored (and
learned) one by one; without training rows every probability is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import crc_mod, map_arrow, materialize, with_uid

SUFFIXES = 512
END = np.int64(0x6A09E667F3BCC908)
BUFFER = 4_000_000


def held_out(id_col: Column) -> Column:
    return crc_mod(id_col, 7) == 2


def _suffix(w: K.Words) -> np.ndarray:
    """The ending of each word: its last two bytes, hashed."""
    last = w.data[w.ends - 1].astype(np.uint64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64)
    return (K.mix(last * np.uint64(256) + before) % np.uint64(SUFFIXES)).astype(np.int64)


def _summed(batches, parts: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, count), combined over up to BUFFER keys at a time."""
    held, n = [], 0
    for batch in batches:
        for keys in parts(batch):
            held.append(keys)
            n += len(keys)
            if n >= BUFFER:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def _rows(keys: np.ndarray, counts: np.ndarray, step: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), step):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(counts[i : i + step].astype(np.int64))], ["key", "n"])


def vocabulary(train: DataFrame) -> DataFrame:
    """(key, n, suffix) of every training token; the end of a text has the key END.

    The suffix rides in the low bits of the word's hash, so one key carries both.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(batch):
            for w in K.words(batch.column("_text"), K.SPACE):
                yield word_keys(w)
                yield np.full(w.row1 - w.row0, END)

        for keys, n in _summed(batches, parts):
            yield from _rows(keys, n)

    return train.transform(map_arrow, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_keys(w: K.Words) -> np.ndarray:
    h = w.hash() & ~np.uint64(SUFFIXES - 1)
    return (h | _suffix(w).astype(np.uint64)).astype(np.int64)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each type; bigrams[i, j] counts j after i."""
    left, right = np.nonzero(bigrams)
    return exchange_pairs(left, right, bigrams[left, right].astype(float), len(bigrams), classes, sweeps)


def exchange_pairs(left: np.ndarray, right: np.ndarray, counts: np.ndarray, types: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each type; counts[x] says how often right[x] comes after left[x], each pair once.

    A move costs as much as the type has neighbours and its neighbours have classes, so rare types are cheap.
    """
    k = min(classes, types)
    out_n, in_n = (np.bincount(x, weights=counts, minlength=types) for x in (left, right))
    ranked = np.argsort(-(out_n + in_n), kind="stable")
    ranked, cls = ranked[(out_n + in_n)[ranked] > 0], np.empty(types, np.int64)
    cls[np.argsort(-(out_n + in_n), kind="stable")] = np.arange(types) % k
    cc = np.bincount(cls[left] * k + cls[right], weights=counts, minlength=k * k).reshape(k, k)
    after, before = np.bincount(cls, weights=out_n, minlength=k), np.bincount(cls, weights=in_n, minlength=k)
    same, other = left == right, left != right
    own = np.bincount(left[same], weights=counts[same], minlength=types)
    near = []  # the neighbours of each type but itself: (types, counts) after it, then before it
    for this, that in ((left[other], right[other]), (right[other], left[other])):
        order = np.argsort(this, kind="stable")
        near.append((np.searchsorted(this[order], np.arange(types + 1)), that[order], counts[other][order]))
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    every = np.arange(k)
    for _ in range(sweeps):
        moved = 0
        for w in ranked:
            a = cls[w]
            to, of = (np.bincount(cls[t[i[w] : i[w + 1]]], weights=c[i[w] : i[w + 1]], minlength=k) for i, t, c in near)
            cc[a] -= to
            cc[:, a] -= of
            cc[a, a] -= own[w]
            after[a] -= out_n[w]
            before[a] -= in_n[w]
            diag, t, o = cc[every, every], np.flatnonzero(to), np.flatnonzero(of)
            was_t, was_o = cc[:, t], cc[o]
            gain = (f(was_t + to[t]) - f(was_t)).sum(1) + (f(was_o + of[o][:, None]) - f(was_o)).sum(0)
            gain -= f(diag + to) + f(diag + of) - f(diag + to + of + own[w]) - f(diag)
            gain -= f(after + out_n[w]) - f(after) + f(before + in_n[w]) - f(before)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[w] = b
            cc[b] += to
            cc[:, b] += of
            cc[b, b] += own[w]
            after[b] += out_n[w]
            before[b] += in_n[w]
            moved += b != a
        if not moved:
            break
    return cls


def _look_up(w: K.Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and types: the place in the sorted known keys; len(known) is the end of a text, then come the endings."""
    keys = word_keys(w)
    suffix = len(known) + 1 + (keys & (SUFFIXES - 1))
    if not len(known):
        return keys, suffix
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return keys, np.where(known[at] == keys, at, suffix)


def _with_ends(w: K.Words, values: np.ndarray, end) -> np.ndarray:
    """The values of all words with one more after the words of each row."""
    out = np.full(len(values) + w.row1 - w.row0, end, values.dtype)
    out[np.arange(len(values)) + K.row_of(w.off)] = values
    return out


def _before(now: np.ndarray, end) -> np.ndarray:
    """What precedes each token of whole texts, the last token of each being the end."""
    return np.concatenate([[end], now[:-1]])[: len(now)]


class Model:
    """All that a scan needs: the head words, their classes, those of the endings and the log10 probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, cls: np.ndarray, end_cls: int, ending_cls: np.ndarray, of: np.ndarray, n: int, v: int, end_count: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.n, self.v, self.end_count = keys[order], counts[order], n, v, end_count
        self.types = np.arange(len(keys))
        self.end = len(keys)
        self.size = len(keys) + 1 + SUFFIXES
        self.cls = np.concatenate([cls[order], [end_cls], ending_cls]).astype(np.int16)
        self.of = of  # by class: the counts of its words and one more for each word and ending
        self.emit = np.log10((np.concatenate([self.counts, [end_count], np.zeros(SUFFIXES)]) + 1) / of[self.cls])
        self.within = np.zeros(self.size)  # an ending stands for one unknown word

    def learn(self, sequences: DataFrame, alpha: float) -> None:
        """The transitions between classes from the ``classes`` of all training texts."""
        k, end = len(self.of), int(self.cls[self.end])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k, np.int64)
            for batch in batches:
                now = _sequence(batch.column("classes")).astype(np.int64)
                total += np.bincount(_before(now, end) * k + now, minlength=k * k)
            at = np.flatnonzero(total)
            yield from _rows(at, total[at])

        cc = np.zeros(k * k)
        for r in sequences.select("classes").transform(map_arrow, pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # k * k rows at most
            cc[r.key] = r.n
        cc = cc.reshape(k, k)
        self.step = np.log10((cc + alpha * self.of / self.of.sum()) / (cc.sum(1, keepdims=True) + alpha))


def _sequence(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16)


def _packed(classes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The classes of each row as bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * np.int32(2)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(classes.astype(np.int16).tobytes())])


def _contexts(train: DataFrame, keys: np.ndarray, of: np.ndarray, moves: np.ndarray, k: int) -> DataFrame:
    """(key, code, n): how often each word that moves follows (code below k) and precedes each class; ``of`` and
    ``moves`` go by the places in ``keys``, then the end, then the endings."""
    shared = train.sparkSession.sparkContext.broadcast((keys, of, moves))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        known, of, moves = shared.value
        end = len(known)

        def flush():
            words, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            pair, c = np.unique(at * (2 * k) + np.concatenate([x for _, x in held]), return_counts=True)
            for i in range(0, len(pair), 200_000):
                p = pair[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(words[p // (2 * k)]), pa.array((p % (2 * k)).astype(np.int32)), pa.array(c[i : i + 200_000].astype(np.int64))], ["key", "code", "n"])

        for batch in batches:
            for w in K.words(batch.column("_text"), K.SPACE):
                word, types = _look_up(w, known)
                chain, moving = of[_with_ends(w, types, end)], moves[types]
                at, word = (np.arange(len(types)) + K.row_of(w.off))[moving], word[moving]
                held += [(word, _before(chain, of[end])[at]), (word, k + chain[at + 1])]
                size_held += 2 * len(word)
                if size_held >= BUFFER // 2:
                    yield from flush()
                    held, size_held = [], 0
        if size_held:
            yield from flush()

    return train.transform(map_arrow, count, "key long, code int, n long").repartition("key").groupBy("key", "code").agg(F.sum("n").alias("n"))


def _gain(cc: np.ndarray, alpha: float) -> np.ndarray:
    """[class before, or k + class after; own class]: what a neighbour says for a class, from the class bigrams."""
    share = (cc.sum(0) + 1e-9) / (cc.sum(0) + 1e-9).sum()
    gain = np.log((cc + alpha * share) / (cc.sum(1, keepdims=True) + alpha) / share)
    return np.concatenate([gain, gain.T])


def word_classes(train: DataFrame, vocab: DataFrame, n: int, classes: int, type_share: float, sweep_share: float, alpha: float) -> tuple[DataFrame, np.ndarray]:
    """(key, n, cls) of every counted word, and the classes of the end and the endings."""
    met = vocab.where((F.col("key") != int(END)) & (F.col("n") >= min(type_share, sweep_share) * n)).toArrow()  # at most 1 / sweep_share rows
    order = np.argsort(met["key"].to_numpy())
    keys, counts = met["key"].to_numpy()[order], met["n"].to_numpy()[order]
    seed = counts >= type_share * n
    types = len(keys[seed])  # at most 1 / type_share
    end, size = types, types + 1 + SUFFIXES
    bc_keys = train.sparkSession.sparkContext.broadcast(keys[seed])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(batch):
            for w in K.words(batch.column("_text"), K.SPACE):
                now = _with_ends(w, _look_up(w, bc_keys.value)[1], end)
                yield _before(now, end) * size + now

        for key, c in _summed(batches, parts):
            yield from _rows(key, c)

    got = train.transform(map_arrow, pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")  # at most size * size rows
    pair, times = got["key"].to_numpy(), got["n"].to_numpy().astype(float)
    cls = exchange_pairs(pair // size, pair % size, times, size, classes)
    k = int(cls.max()) + 1
    gain = _gain(np.bincount(cls[pair // size] * k + cls[pair % size], weights=times, minlength=k * k).reshape(k, k), alpha)

    # a sweep of the frequent words against all classes at once, then one of all words but the seeds
    of = np.concatenate([cls[end + 1 :][keys & (SUFFIXES - 1)], cls[end:]])
    of[: len(keys)][seed] = cls[:end]
    moves = np.concatenate([~seed, np.zeros(1 + SUFFIXES, bool)])
    if moves.any():
        near = _contexts(train, keys, of, moves, k).toArrow()  # at most 2k / sweep_share rows
        count = np.zeros((len(keys), 2 * k), np.float32)
        count[np.searchsorted(keys, near["key"].to_numpy()), near["code"].to_numpy()] = near["n"].to_numpy()
        of[: len(keys)][~seed] = np.argmax(np.round(count[~seed] @ gain, 6), 1)
    moves[len(keys) + 1 :] = True
    best = train.sparkSession.sparkContext.broadcast(gain)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, rows = batch.column("near"), batch.num_rows
            at, flat = np.repeat(np.arange(rows), pc.list_value_length(near).to_numpy()), near.flatten()
            count = np.zeros((rows, 2 * k))
            count[at, flat.field("code").to_numpy()] = flat.field("n").to_numpy()
            cls = np.argmax(np.round(count @ best.value, 6), 1) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(count[:, :k].sum(1).astype(np.int64)), pa.array(cls.astype(np.int32))], ["key", "n", "cls"])

    counted = _contexts(train, keys, of, moves, k)
    rest = counted.groupBy("key").agg(F.collect_list(F.struct("code", "n")).alias("near")).transform(map_arrow, assign, "key long, n long, cls int")  # 2k codes a word at most
    own = train.sparkSession.createDataFrame(pa.table({"key": pa.array(keys[seed], pa.int64()), "n": pa.array(counts[seed], pa.int64()), "cls": pa.array(cls[:end].astype(np.int32))}))
    return materialize(rest.unionByName(own)), cls[end:]


def _fit(train: DataFrame, vocab: DataFrame, classes: int, type_share: float, sweep_share: float, head_share: float, alpha: float) -> tuple[Model, DataFrame]:
    """The model but for its transitions, and (key, n, cls) of the words that are not in its head."""
    total = vocab.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    ends = vocab.where(F.col("key") == int(END)).agg(F.sum("n")).first()[0] or 0
    known, (end_cls, *ending_cls) = word_classes(train, vocab, n, classes, type_share, sweep_share, alpha)
    of = np.bincount([end_cls, *ending_cls], minlength=classes).astype(float)
    of[end_cls] += ends
    for r in known.groupBy("cls").agg(F.sum(F.col("n") + 1).alias("n")).collect():  # a row a class
        of[r.cls] += r.n
    of = of[: np.flatnonzero(of)[-1] + 1]
    head = known.where(F.col("n") >= head_share * n).toArrow()  # at most 1 / head_share rows
    model = Model(*(head[c].to_numpy() for c in ("key", "n", "cls")), end_cls, np.array(ending_cls), np.maximum(of, 1e-300), n, v, ends)
    return model, known.where(F.col("n") < head_share * n)


def fit(train: DataFrame, vocab: DataFrame, *, classes: int = 64, type_share: float = 2e-4, sweep_share: float = 1e-5, head_share: float = 1e-6, alpha: float = 2.0) -> Model:
    model, rare = _fit(train, vocab, classes, type_share, sweep_share, head_share, alpha)
    model.learn(class_sequences(train.select(F.lit(None).cast("long").alias("_id"), "_text", F.lit(False).alias("_held")), model, rare), alpha)
    return model


def class_sequences(rows: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """_id, _held, n_tokens, known, base, emit (log10 of the words given their classes) and the classes of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    id_kind = rows.schema["_id"].dataType.simpleString()
    names = ["_uid", "key", "pos", "_id", "_held", "n_tokens", "known", "base", "emit", "classes"]
    k = len(model.of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        unit = math.log10(m.n + m.v + 1)
        for batch in batches:
            for w in K.words(batch.column("_text"), K.SPACE):
                rows = w.row1 - w.row0
                keys, types = _look_up(w, m.keys)
                row, head = K.row_of(w.off), types < m.end
                now = _with_ends(w, types, m.end)
                length = w.counts.astype(np.int64) + 1
                log_count = np.zeros(len(types))
                log_count[head] = np.log10(m.counts[types[head]] + 1.0)
                base = np.bincount(row, weights=log_count, minlength=rows) + math.log10(m.end_count + 1) - length * unit
                emit = np.bincount(np.repeat(np.arange(rows), length), weights=np.where(now <= m.end, m.emit[now], 0.0), minlength=rows)
                known = np.bincount(row, weights=head, minlength=rows).astype(np.int64) + (m.end_count > 0)
                uid = batch.column("_uid").slice(w.row0, rows)
                spread = K.mix(uid.to_numpy().astype(np.uint64)).astype(np.int64)  # a row's own sums travel under a key of their own
                yield pa.RecordBatch.from_arrays(
                    [uid, pa.array(spread), pa.array(np.full(rows, -1, np.int64)), batch.column("_id").slice(w.row0, rows), batch.column("_held").slice(w.row0, rows),
                     pa.array(length), pa.array(known), pa.array(base), pa.array(emit), _packed(m.cls[now], length)], names)
                tail = np.flatnonzero(~head)
                t = len(tail)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid.to_numpy()[row[tail]]), pa.array(keys[tail]), pa.array((tail - w.off[row[tail]]).astype(np.int64)), pa.nulls(t, batch.column("_id").type), pa.nulls(t, pa.bool_()),
                     pa.nulls(t, pa.int64()), pa.nulls(t, pa.int64()), pa.nulls(t, pa.float64()), pa.nulls(t, pa.float64()), pa.nulls(t, pa.binary())], names)

    parts = with_uid(rows).transform(map_arrow, scan, f"_uid long, key long, pos long, _id {id_kind}, _held boolean, n_tokens long, known long, base double, emit double, classes binary")
    met = parts.join(rare, "key", "left")
    here = (F.col("pos") >= 0) & F.col("n").isNotNull()
    logs, seen = F.sum(F.when(here, F.log10(F.col("n") + 1.0)).otherwise(0.0)), F.sum(F.when(here, 1).otherwise(0))
    code = F.col("pos") * 65536 + F.coalesce(F.col("cls").cast("long"), k + F.col("key").bitwiseAND(SUFFIXES - 1))
    whole = met.groupBy("_uid").agg(
        F.max("_id").alias("_id"), F.max("_held").alias("_held"), F.max("n_tokens").alias("n_tokens"), (F.max("known") + seen).alias("known"),
        (F.max("base") + logs).alias("base"), (F.max("emit") + logs).alias("emit"), F.max("classes").alias("classes"), F.collect_list(F.when(F.col("pos") >= 0, code)).alias("_tail"),
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of_code = np.concatenate([np.arange(k), m.cls[m.end + 1 :]])
        for batch in batches:
            length, tail = batch.column("n_tokens").to_numpy(), batch.column("_tail")
            row, code = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tail).to_numpy()), tail.flatten().to_numpy()
            own, classes = of_code[code & 65535], _sequence(batch.column("classes")).copy()
            classes[(np.cumsum(length) - length)[row] + (code >> 16)] = own
            emit = batch.column("emit").to_numpy() + np.bincount(row, weights=-np.log10(m.of[own]), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_held", "n_tokens", "known", "base")), pa.array(emit), _packed(classes, length)], ["_id", "_held", "n_tokens", "known", "base", "emit", "classes"])

    return whole.drop("_uid").transform(map_arrow, fill, f"_id {id_kind}, _held boolean, n_tokens long, known long, base double, emit double, classes binary")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held: Callable[[Column], Column] = held_out, classes: int = 64,
          type_share: float = 2e-4, sweep_share: float = 1e-5, head_share: float = 1e-6) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), held(F.col(id_col)).alias("_held"))
    train = rows.where(~F.col("_held")).select("_text")
    vocab = materialize(vocabulary(train))
    model, rare = _fit(train, vocab, classes, type_share, sweep_share, head_share, 2.0)
    made = materialize(class_sequences(rows, model, rare))
    model.learn(made.where(~F.col("_held")), 2.0)
    step, end, id_kind = model.step, int(model.cls[model.end]), docs.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, length = _sequence(batch.column("classes")), batch.column("n_tokens").to_numpy()
            steps = np.bincount(np.repeat(np.arange(batch.num_rows), length), weights=step[_before(now, end), now], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_held", "n_tokens", "known", "base")), pa.array(batch.column("emit").to_numpy() + steps)], ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = made.transform(map_arrow, finish, f"_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("_id", id_col)
    out = out.withColumn("train_tokens", F.lit(int(model.n)).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
