"""N-gram Jaccard join by vertical partitioning, and its connected components.

A document's set holds the hashes of its distinct word shingles (a shorter text is one shingle; a text without words
has an empty set and no links).  Equal sets are one node from the start, so copies never meet as pairs.

1. ``profile``: one scan gives each row its node (a 64-bit fingerprint of its set), set size and a parity bitmap, and
   each task a block-wise count sketch of shingles.  The summed sketch (fixed size) defines the global n-gram order:
   rarest first, ties by hash.  Any sketch error only shifts the order, never a result.
2. ``postings``: the prefixes that two sets of the wanted similarity must share, as (token, node, size, position).  A
   token that the sketch counts often is dealt by node over several salts, so that no task gets all of it.  The task that
   holds a token's nodes drops those without a partner of a fitting size, and pairs each of the others with the hub of
   its size class: linear in the postings.
3. The global order is cut into fragments of equal mass, and every set into its segments.  ``settle`` counts the partial
   overlaps of pairs fragment by fragment and sums them per pair.  Before, an exact bound from the bitmaps drops most
   pairs; of more pairs than a few a node, each node's likeliest one goes first, and pairs whose ends are connected by
   then are not counted.
4. Rounds: links are joined into components, tokens whose nodes are all connected go, and while more pairs are left
   than a few a node, each node of a token outside its largest component is held against the likeliest of another component
   (and, where the token is dealt over salts, against a hub from that component).  Then every remaining
   pair across components that shares a prefix token is tried, so no link that could join two components is lost, and
   no group of near copies is ever expanded into all its pairs.

Defined results: null text counts as empty; null ids take part in no link (their component is null unless their copies
have ids); repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, map_arrow, materialize, side

WORDS = 5
PERCENT = 75
CELLS_LOG2 = 22
BLOCK = 1 << 16
BITMAP = 256
FRAGMENTS = 8
#: Hubs of a token's size class in the linear rounds; those after the first are held only while many pairs are left.
HUBS = (1, 64, 64)
#: Pairs a node that are tried at once.
FEW = 3
#: Tokens that the sketch counts more often than its mean cell, times this power of two, are dealt over salts.
HOT_LOG2 = 12
#: Links that one task may join into components; more take distributed rounds.
ONE_TASK = 500_000
#: Distinct nodes with more rows than this are known to all tasks when rows meet their components.
HEAVY = 10_000


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for w in K.words(column, K.SPACE):
        h = w.hash()
        g, n = K.ngrams(h, size), w.counts
        for r in range(w.row1 - w.row0):
            a, b = int(w.off[r]), int(w.off[r + 1])
            if n[r] >= size:
                yield w.row0 + r, np.unique(g[a : b - size + 1])
            else:
                yield w.row0 + r, K.ngrams(h[a:b], int(n[r])) if n[r] else np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """A fingerprint of the set as a signed long."""
    return int(K.mix(np.append(K.mix(s), np.uint64(len(s)))).sum().astype(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of hash buckets, a power of two of them and at least one a shingle: sets that differ in k shingles differ
    in at most k parities."""
    size = max(BITMAP, 1 << max(len(s) - 1, 0).bit_length())
    parity = np.bincount((s >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(a: str, b: str):
    """Parities in which two bitmaps differ, the longer one folded to half; 0 where they are too unlike in length."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    x, y = F.col(a), F.col(b)
    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(half(x), y)).when(F.size(y) == 2 * F.size(x), count(x, half(y))).otherwise(F.lit(0).cast("long"))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def _hot(level: np.ndarray, hot_log2: int) -> int:
    """The level above which a token is dealt over salts."""
    return hot_log2 + int(np.ceil(np.log2(np.exp2(level.astype(float)).mean())))


def _fold(bits):
    """A bitmap folded to 256 parities."""
    at = lambda i: F.aggregate(F.filter(bits, lambda x, k: k % 4 == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    return F.struct(*[at(i).alias(f"b{i}") for i in range(4)])


def profile(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, np.ndarray]:
    """(_id, node, n, bits) of every row, and the order: for each sketch cell the log2 of its count."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {id_type}, node long, n long, bits array<long>, block int, counts binary"
    n_blocks = (1 << CELLS_LOG2) // BLOCK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, waiting, held = np.zeros(1 << CELLS_LOG2, np.uint8), [], 0
        id_kind = pa.null()

        def flush() -> None:
            nonlocal held
            if waiting:
                cells, got = np.unique(np.concatenate(waiting), return_counts=True)
                local[cells] = np.minimum(local[cells] + got, 255)
                waiting.clear()
                held = 0

        for batch in batches:
            id_kind = batch.column("_id").type
            nodes, sizes, bits = [], [], []
            for _, s in sets_of(batch.column("_text"), size):
                nodes.append(node_of(s))
                sizes.append(len(s))
                bits.append(_bitmap(s))
                waiting.append(_cells(s))
                held += len(s)
                if held > 1_000_000:
                    flush()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["_id", "node", "n", "bits", "block", "counts"],
            )
        flush()
        for b in range(n_blocks):
            part = local[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                    ["_id", "node", "n", "bits", "block", "counts"],
                )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(c, np.uint8).astype(np.int64)
        for b, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.log2(np.maximum(c, 1)).astype(np.uint8).tobytes()], pa.binary()), pa.array([int(c.sum())], pa.int64())], ["block", "level", "mass"])

    made = materialize(rows.transform(map_arrow, scan, schema))
    order = np.zeros(1 << CELLS_LOG2, np.uint8)
    for r in made.where("block is not null").select("block", "counts").repartition("block").transform(map_arrow, add_up, "block int, level binary, mass long").toLocalIterator():
        order[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.level, np.uint8)
    return made.where("block is null").select("_id", "node", "n", "bits"), order


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Size classes: sets of the wanted similarity are in one class or in neighbouring ones."""
    return n.astype(np.int32) if percent >= 100 else np.floor(np.log(n) / math.log(100 / percent)).astype(np.int32)


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the smaller set's prefix, when it meets sets of its size or larger ones."""
    return n + (-2 * percent * n) // (100 + percent) + 1


POSTING = ("token", "salt", "node", "n", "pos", "cls")
POSTINGS = "token long, salt int, node long, n int, pos int, cls int"


def postings(docs: DataFrame, text_col: str, order, size: int, percent: int, hubs: int, hot: int) -> DataFrame:
    """Prefix tokens with the nodes that have a partner of a fitting size, and (a, b) of each node and its hub."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = order.value, set()
        for batch in batches:
            out, held = [], 0
            for _, s in sets_of(batch.column("_text"), size):
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                k, lv = _prefix(len(s), percent), level[_cells(s)]
                first = np.argsort(lv, kind="stable")[:k]  # s is sorted
                salt, common = np.zeros(k, np.int32), lv[first] > hot
                if common.any():
                    salts = np.uint64(1) << (lv[first[common]] - np.uint8(hot)).astype(np.uint64)
                    salt[common] = K.mix(np.array([node], np.int64).view(np.uint64)) % salts
                out.append((s[first].astype(np.int64), salt, node, len(s), k))
                held += k
                if held >= 100_000:
                    yield pack(out)
                    out, held = [], 0
            if out:
                yield pack(out)

    def pack(out: list) -> pa.RecordBatch:
        ks = [x[4] for x in out]
        cols = [np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.repeat(np.array([x[2] for x in out], np.int64), ks),
                np.repeat(np.array([x[3] for x in out], np.int32), ks), np.concatenate([np.arange(k, dtype=np.int32) for k in ks])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], POSTING[:5])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token and salt; the last group of a batch waits for the next one."""
        level, rest = order.value, None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
            token, salt = now[:2]
            if not len(token):
                continue
            last = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1]))[-1]) + 1 if (token[0], salt[0]) != (token[-1], salt[-1]) else 0
            rest = [x[last:] for x in now]
            if last:
                yield from partners([x[:last] for x in now], level)
        if rest is not None:
            yield from partners(rest, level)

    def partners(cols: list[np.ndarray], level: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, salt = cols[:2]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]), [True]])
        dealt = level[_cells(token.view(np.uint64))] > hot  # partners may be under another salt
        several = ~(new[:-1] & new[1:]) | dealt
        token, salt, node, *_ = cols = [x[several] for x in cols]
        group = np.cumsum(new)[:-1][several]
        if not len(token):
            return
        by = np.lexsort((node, cols[3], group))
        once = np.ones(len(by), bool)
        once[1:] = (group[by][1:] != group[by][:-1]) | (node[by][1:] != node[by][:-1])
        by = by[once]
        token, salt, node, n, pos = (x[by] for x in cols)
        group, n = group[by], n.astype(np.int64)
        small, at = pos < _need(n, percent), np.arange(len(by))
        ahead = np.zeros(len(by), bool)
        ahead[:-1] = small[:-1] & (group[1:] == group[:-1]) & (100 * n[:-1] >= percent * n[1:])
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(small, at, -1))[:-1]])
        behind = (before >= 0) & (group[before] == group) & (100 * n[before] >= percent * n)
        kept = ahead | behind | dealt[several][by]
        token, salt, node, n, pos, group = (x[kept] for x in (token, salt, node, n, pos, group))
        cls, rows = _classes(n, percent), len(token)
        if not rows:
            return
        none = lambda k: [pa.nulls(k, pa.int64())] * 2
        for i in range(0, rows, 200_000):
            part = slice(i, i + 200_000)
            k = len(token[part])
            yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(salt[part]), pa.array(node[part]), pa.array(n[part].astype(np.int32)), pa.array(pos[part]), pa.array(cls[part]), *none(k)], [*POSTING, "a", "b"])
        if not hubs:
            return
        rank = K.mix(node.view(np.uint64) + (token % hubs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((rank, cls, group))
        token, node, n, pos, group, cls = (x[by] for x in (token, node, n, pos, group, cls))
        start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (cls[1:] != cls[:-1])]))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows)))
        after = np.zeros(len(start), bool)
        after[:-1] = (group[start[1:]] == group[start[:-1]]) & (cls[start[1:]] == cls[start[:-1]] + 1)
        x, y = np.arange(rows), start[run]
        up = after[run]
        x, y = np.concatenate([x, x[up]]), np.concatenate([y, start[np.minimum(run[up] + 1, len(start) - 1)]])
        swap = (n[x] > n[y]) | ((n[x] == n[y]) & (node[x] > node[y]))
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        left, need = np.minimum(n[a] - pos[a], n[b] - pos[b]), -(-percent * (n[a] + n[b]) // (100 + percent))
        fit = (a != b) & (100 * n[a] >= percent * n[b]) & (left >= need) & (pos[a] < _need(n[a], percent))
        pairs = np.unique(np.stack([node[a[fit]], node[b[fit]]], 1), axis=0)
        k = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], [*POSTING, "a", "b"])

    sent = docs.select(F.col(text_col).alias("_text")).transform(map_arrow, emit, "token long, salt int, node long, n int, pos int")
    return sent.repartition("token", "salt").sortWithinPartitions("token", "salt").transform(map_arrow, meet, f"{POSTINGS}, a long, b long")


def _fits(a: str, b: str, percent: int):
    """a: the smaller set by (n, node). Sizes, the shorter index prefix and the bound from the positions."""
    need = F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + percent))
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    index = F.col(f"{a}.n") - F.ceil(F.lit(2 * percent) * F.col(f"{a}.n") / F.lit(100 + percent)) + 1
    return (100 * F.col(f"{a}.n") >= percent * F.col(f"{b}.n")) & (left >= need) & (F.col(f"{a}.pos") < index)


def _less(x: str, y: str):
    return (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.node") < F.col(f"{y}.node")))


def _fitting(x: str, y: str, percent: int):
    return F.when(_less(x, y), _fits(x, y, percent)).otherwise(_fits(y, x, percent))


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b) of rows (x, y), the smaller set first."""
    first = _less("x", "y")
    return met.select(F.when(first, F.col("x.node")).otherwise(F.col("y.node")).alias("a"), F.when(first, F.col("y.node")).otherwise(F.col("x.node")).alias("b")).distinct()


def open_postings(shared: DataFrame, labels: DataFrame, broadcast_rows: int) -> DataFrame:
    """The postings with their components, without the tokens whose nodes are all in one component already."""
    posted = shared.join(side(labels, broadcast_rows), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_tokens = posted.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return materialize(posted.join(open_tokens, "token", "left_semi"))


def members(posted: DataFrame) -> DataFrame:
    """(token, cls, comp) with its postings and a random one of each; the size of the result is at most that of postings."""
    return posted.groupBy("token", "cls", "comp").agg(F.count("*").alias("c"), F.max("salt").alias("salt"), F.min(F.struct("rank", F.struct("node", "n", "pos", "comp").alias("y"))).alias("of"))


def hub_pairs(posted: DataFrame, percent: int, hubs: int, step: int) -> DataFrame:
    """Each token's nodes against a hub from the largest component of their size class or the next one, where the
    components differ."""
    ranked = posted.withColumn("rank", F.xxhash64("node", F.pmod("token", F.lit(hubs)), F.lit(step)))
    most = members(ranked).groupBy("token", "cls").agg(F.max(F.struct("c", "of")).alias("top"), F.max("salt").alias("salts"))
    each = F.explode(F.sequence(F.lit(0), F.col("salts")))
    hub = most.select("token", F.col("top.of.y").alias("y"), "cls", "salts").withColumn("cls", F.explode(F.array("cls", F.col("cls") - 1))).select("token", "cls", "y", each.alias("salt"))
    met = posted.select("token", "cls", "salt", F.struct("node", "n", "pos", "comp").alias("x")).join(hub, ["token", "cls", "salt"]).where((F.col("x.comp") != F.col("y.comp")) & _fitting("x", "y", percent))
    return _pairs(met)


def rest_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Every pair across components that shares a prefix token and passes the folded bitmaps.

    One side of such a pair is outside the token's largest component, so that only the rows outside are held against
    all; they are sent to each salt of a token that is dealt over several.  Two rows outside meet once, not from both sides.
    """
    row = F.struct("node", "n", "pos", "comp", "fold")
    most = posted.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("salt").alias("salt")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.max("salt").alias("salts"))
    outer = posted.drop("salt").join(most.select("token", F.col("top.comp").alias("top"), "salts"), "token").where("comp <> top")
    y = outer.select("token", "top", row.alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"))
    differ = sum((F.bit_count(F.col(f"x.fold.b{i}").bitwiseXOR(F.col(f"y.fold.b{i}"))) for i in range(4)), F.lit(0))
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("x.n").cast("long") + F.col("y.n"))
    met = posted.select("token", "salt", row.alias("x")).join(y, ["token", "salt"])
    once = (F.col("x.comp") == F.col("top")) | (F.col("x.node") < F.col("y.node"))
    return _pairs(met.where((F.col("x.comp") != F.col("y.comp")) & once & _fitting("x", "y", percent) & alike))


def near_pairs(posted: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """(a, b) of each row outside its token's largest component and the row of another component whose folded bitmap differs
    least for its size, among those that ``rest_pairs`` would take; and how many pairs those are, counted once a token.

    A token's pairs are compared in its task and never become rows: the result has at most a row for each posting.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches):
            new = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), [True]]))
            found, left = [], 0
            for lo, hi in zip(new[:-1], new[1:], strict=True):
                if hi - lo > 1:
                    pairs, more = nearest(*[x[lo:hi] for x in cols[2:]])
                    left += more
                    if len(pairs):
                        found.append(pairs)
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*pairs[:, 0], None], pa.int64()), pa.array([*pairs[:, 1], None], pa.int64()), pa.array([*[0] * len(pairs), left], pa.int64())], ["a", "b", "pairs"])

    def nearest(node, n, pos, comp, *fold) -> tuple[np.ndarray, int]:
        comps, at, many = np.unique(comp, return_inverse=True, return_counts=True)
        if len(comps) < 2:
            return np.zeros((0, 2), np.int64), 0
        outer = np.flatnonzero(at != many.argmax())
        n, pos, found, left = n.astype(np.int64), pos.astype(np.int64), [], 0
        strip = max(1, 1_000_000 // len(node))
        for i in range(0, len(outer), strip):
            x = outer[i : i + strip, None]
            nx, px = n[x], pos[x]
            whole = nx + n
            differ = sum(np.bitwise_count(b[x] ^ b).astype(np.int64) for b in fold)
            first = (nx < n) | ((nx == n) & (node[x] < node))
            small, large = np.minimum(nx, n), np.maximum(nx, n)
            fit = (comp[x] != comp) & (100 * small >= percent * large) & (np.minimum(nx - px, n - pos) >= -(-percent * whole // (100 + percent)))
            fit &= (np.where(first, px, pos) < _need(small, percent)) & ((100 + percent) * differ <= (100 - percent) * whole)
            inner = fit & (at == many.argmax())
            left += 2 * int(inner.sum()) + int((fit & ~inner).sum())  # a pair of two outer rows is seen from both
            some = np.flatnonzero(fit.any(1))
            y = np.where(fit, differ / np.maximum(whole, 1), np.inf)[some].argmin(1)
            x = x[some, 0]
            swap = ~first[some, y]
            found.append(np.stack([node[np.where(swap, y, x)], node[np.where(swap, x, y)]], 1))
        return np.concatenate(found), left // 2

    sent = posted.select("token", "salt", "node", "n", "pos", "comp", *[F.col(f"fold.b{i}").alias(f"b{i}") for i in range(4)])
    met = materialize(sent.repartition("token", "salt").sortWithinPartitions("token", "salt").transform(map_arrow, meet, "a long, b long, pairs long"))
    return met.where("a is not null").select("a", "b").distinct(), met.agg(F.sum("pairs")).first()[0] or 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups of rows that come sorted by their first two; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        token, salt = now[:2]
        if not len(token):
            continue
        last = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1]))[-1]) + 1 if (token[0], salt[0]) != (token[-1], salt[-1]) else 0
        rest = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def every_pair(shared: DataFrame, percent: int, block: int = 2000) -> DataFrame:
    """Every pair that shares a prefix token, whatever its component; a token of many nodes is dealt in blocks of them."""
    row = F.struct("node", "n", "pos")
    held = shared.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = shared.join(held, "token")
    x = dealt.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), row.alias("x"))
    y = dealt.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), row.alias("y"))
    met = x.join(y, ["token", "block"]).where((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))))
    return met.where(_fits("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def bounded(prof: DataFrame, pairs: DataFrame, percent: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that the bitmaps leave, as (a, b, na, nb, differ), and (node, _id) of their nodes."""
    needed = materialize(pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct())
    sig = materialize(prof.join(side(needed, broadcast_rows), "node", "left_semi").groupBy("node").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("bits").alias("bits")).where("_id is not null"))
    of = lambda k: sig.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    most = (100 - percent) * (F.col("na") + F.col("nb"))  # set difference at the wanted similarity, times (100 + percent)
    met = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("differ", _differ("bitsa", "bitsb"))
    left = materialize(met.where((100 + percent) * F.col("differ") <= most).select("a", "b", "na", "nb", "differ"))
    ends = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sig.select("node", "_id"), "node"))
    discard(needed, sig)
    return left, ends


def segments(docs: DataFrame, ends: DataFrame, order, id_col: str, text_col: str, size: int, fragments: int, broadcast_rows: int) -> DataFrame:
    """(node, frag, seg): the shingles of each wanted set, cut by their place in the global order."""
    mass = np.bincount(order.value, weights=np.exp2(order.value.astype(float)), minlength=64)
    last = np.cumsum(mass) / max(mass.sum(), 1)
    begins = np.concatenate([[0], last[:-1]])

    def cut(s: np.ndarray) -> np.ndarray:
        """The fragment of each shingle: its place in the global order, as a share of all shingles."""
        lv = order.value[_cells(s)]
        place = begins[lv] + (last[lv] - begins[lv]) * (s / 2.0**64)
        return np.minimum((place * fragments).astype(np.int64), fragments - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, frag, seg = [], [], []
            for _, s in sets_of(batch.column("_text"), size):
                f, v = cut(s), node_of(s)
                for k in np.unique(f):
                    node.append(v)
                    frag.append(int(k))
                    seg.append(s[f == k].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.array(seg, pa.list_(pa.int64()))], ["node", "frag", "seg"])

    wanted = materialize(ends.select("_id").distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(side(wanted, broadcast_rows), "_id", "left_semi")
    return materialize(texts.transform(map_arrow, run, "node long, frag int, seg array<long>").dropDuplicates(["node", "frag"]))


def verify(pairs: DataFrame, seg: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Of (a, b, na, nb) the pairs of the wanted similarity: partial overlaps by fragment, summed per pair."""
    cells = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("frag"))
    of = lambda k: seg.select(F.col("node").alias(k), "frag", F.col("seg").alias(f"seg{k}"))
    part = cells.join(of("a"), ["a", "frag"]).join(of("b"), ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sega", "segb")).alias("common"))
    whole = part.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return whole.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def likeliest(left: DataFrame) -> DataFrame:
    """The pair of each node whose bitmaps differ least for its size: at most as many pairs as nodes."""
    order = F.struct((F.col("differ") / (F.col("na") + F.col("nb"))).alias("d"), F.xxhash64("a", "b").alias("h"), "a", "b", "na", "nb", "differ")
    ends = left.select(F.explode(F.array("a", "b")).alias("node"), order.alias("p"))
    return ends.groupBy("node").agg(F.min("p").alias("p")).select("p.a", "p.b", "p.na", "p.nb", "p.differ").distinct()


def settle(left: DataFrame, n_nodes: int, seg: DataFrame, labels: DataFrame | None, percent: int, fragments: int, broadcast_rows: int, one_task: int = ONE_TASK) -> DataFrame | None:
    """The components after all pairs of ``left`` that could still join two are tried."""
    for step in range(64):
        n = left.count()
        if not n:
            break
        last = n <= FEW * n_nodes or step == 63
        chosen = left if last else materialize(likeliest(left))
        found = materialize(verify(chosen, seg, percent, fragments))
        got = not found.isEmpty()
        if got:
            labels = components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))), one_task)
        if last:
            break
        left = left.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        if got:
            of = lambda k: side(labels, broadcast_rows).select(F.col("node").alias(k), F.col("comp").alias(f"comp{k}"))  # noqa: B023, E731
            left = left.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("compa", "a") != F.coalesce("compb", "b")).select("a", "b", "na", "nb", "differ")
        left = materialize(left)
    return labels


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links at once: labels sink to the least neighbour, and to their own label."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x for x, _ in held] + [y for _, y in held]), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        for side_ in (a, b):
            np.minimum.at(label, before[side_], low)
            np.minimum.at(label, side_, low)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "comp"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, comp): the least node reachable; few links in one task, more by alternating large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # of each node's neighbours, the larger ones move to the least of all
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # smaller neighbours and the node itself move to the least
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        moved = both.join(low, "a")
        if large:
            out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e, state = materialize(edges.where("a <> b").distinct()), None
    if e.count() <= one_task:
        return materialize(e.coalesce(1).transform(map_arrow, _unite, "node long, comp long"))
    while True:
        before, e = e, materialize(star(star(e, True), False))
        discard(before)
        # at the fixed point every node points at the least one of its component
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    out = materialize(e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct())
    discard(e)
    return out


def least_ids(prof: DataFrame, labels: DataFrame | None, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, component_id) of nodes with many rows, which are few, and of the others."""
    own = materialize(prof.where("n > 0").groupBy("node").agg(F.min("_id").alias("_id"), F.count("*").alias("rows")))
    if labels is None:
        of = own.withColumn("component_id", F.col("_id"))
    else:
        # a component may hold a large share of all nodes: it is dealt over salts, and its least id sent to each
        known = own.join(side(labels, broadcast_rows), "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)))
        linked = materialize(known.join(side(labels.select("comp").distinct(), broadcast_rows), "comp", "left_semi"))
        least = linked.groupBy("comp").agg(F.min("_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        named = linked.join(least, ["comp", "salt"]).select("node", "component_id", "rows")
        alone = own.join(side(labels.select("node"), broadcast_rows), "node", "left_anti").select("node", F.col("_id").alias("component_id"), "rows")
        of = named.unionByName(alone)
    of = materialize(of)
    bound = max(HEAVY, (of.agg(F.sum("rows")).first()[0] or 0) // 100_000)  # at most 100,000 nodes are heavy
    return of.where(F.col("rows") > bound).select("node", "component_id"), of.where(F.col("rows") <= bound).select("node", "component_id")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS,
         hubs: tuple[int, ...] = HUBS, broadcast_rows: int = 500_000, hot_log2: int = HOT_LOG2, one_task: int = ONE_TASK, count_links: bool = False) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable by links.

    With ``count_links`` also n_links, the number of other rows (copies too) that it is linked with; then the pairs inside
    components are verified as well, whose number grows with the square of a group's different texts.
    """
    prof, level = profile(docs, id_col, text_col, size)
    order = docs.sparkSession.sparkContext.broadcast(level)
    found = materialize(postings(docs, text_col, order, size, percent, hubs[0] if hubs else 0, _hot(level, hot_log2)))
    shared = found.where("token is not null").select(*POSTING)

    def tried(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        left, ends = bounded(prof, pairs, percent, broadcast_rows)
        n = ends.count()
        if not n:
            return labels
        seg = segments(docs, ends, order, id_col, text_col, size, fragments, broadcast_rows)
        labels = settle(left, n, seg, labels, percent, fragments, broadcast_rows, one_task)
        discard(left, ends, seg)
        return labels

    first = materialize(found.where("a is not null").select("a", "b").distinct())
    labels = tried(first, None)
    posted, step = shared.withColumn("comp", F.col("node")), 1
    if labels is not None:
        posted = open_postings(shared, labels, broadcast_rows)
    n = posted.select("node").distinct().count()
    folds = prof.join(side(posted.select("node").distinct(), broadcast_rows), "node", "left_semi").dropDuplicates(["node"]).select("node", _fold(F.col("bits")).alias("fold"))
    posted = materialize(posted.join(materialize(folds), "node"))
    while n:
        if step > 1 and labels is not None:
            posted, done = open_postings(posted.drop("comp"), labels, broadcast_rows), posted
            discard(done)
        if step < len(hubs):
            pairs, left = near_pairs(posted, percent)
            if left > FEW * n:
                if posted.agg(F.max("salt")).first()[0]:  # near rows of a token that is dealt may be under another salt
                    pairs = pairs.unionByName(hub_pairs(posted, percent, hubs[step], step)).distinct()
                pairs = materialize(pairs)
                labels = tried(pairs, labels)
                discard(pairs)
                step += 1
                continue
        pairs = materialize(rest_pairs(posted, percent))
        labels = tried(pairs, labels)
        discard(pairs)
        break
    heavy, light = least_ids(prof, labels, broadcast_rows)
    rows = prof.where("n > 0").select("_id", "n", "node").join(F.broadcast(heavy.withColumnRenamed("component_id", "_heavy").withColumn("_known", F.lit(True))), "node", "left")
    linked = rows.where("_known").select("_id", "n", "node", F.col("_heavy").alias("component_id")).unionByName(rows.where("_known is null").select("_id", "n", "node").join(light, "node"))
    empty = prof.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    columns = [F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    if not count_links:
        return linked.select("_id", "n", "component_id").unionByName(empty).select(columns)
    left, ends = bounded(prof, materialize(every_pair(shared, percent)), percent, broadcast_rows)
    links = materialize(verify(left, segments(docs, ends, order, id_col, text_col, size, fragments, broadcast_rows), percent, fragments))
    copies = materialize(prof.where("n > 0 and _id is not null").groupBy("node").agg(F.count("*").alias("rows")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("others"))
    met = linked.join(copies, "node", "left").join(others, "node", "left")
    n_links = F.when(F.col("_id").isNull(), 0).otherwise(F.col("rows") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")
    return met.select("_id", "n", "component_id", n_links).unionByName(empty.withColumn("n_links", F.lit(0).cast("long"))).select(*columns, "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The rows that represent their component (smallest id; one row of repeated ones); rows with a null id stay."""
    found = materialize(join(docs, id_col=id_col, broadcast_rows=broadcast_rows, **options))
    out = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    twice = materialize(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    kept = docs.join(side(materialize(out), 4 * broadcast_rows), id_col, "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    again = kept.join(side(twice, broadcast_rows), id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(side(twice, broadcast_rows), id_col, "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
