"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles (a shorter text is one shingle; a text without words has
an empty set and no links).  Its sketch is the ``k`` least values of the set; equal sets are one node from the start.

Of the k least values of a union, those in both sets are a sample without replacement whose share estimates the Jaccard
similarity, and all of them stand in both sketches.  So two linked sets have at least ``least_shared`` retained values in
common: exactly where their union is no larger than a sketch, else but for a chance of under ``RISK`` a pair.

1. ``profile`` gives each row its node and set size, ``sketches`` each node its retained values; ``levels`` counts those in
   a sketch of fixed size, which orders them from rare to frequent.
2. ``inverted``: the inverted lists.  A node that must share c of its s values with a partner is listed under its
   s - c + 1 rarest ones, so that linked nodes meet in at least one list.  Values that are counted often are dealt by node
   over several salts, and nodes without a partner of a fitting size in their list go.  Lists of the same nodes, of which
   a few copies have dozens, are one.
3. Nodes of a list meet through hubs: each is paired with the one of its size class.  Then ``close_pairs`` compares the nodes
   of a list across components in its task: it gives all pairs that may be linked where they are few, and each node's
   likeliest one where they are many; such lists come again, at last with all pairs.
4. Pairs go whose sets differ in too many of 1024 parities (an exact bound).  ``estimate`` holds both sketches against each other: pairs whose union a sketch covers are settled by it exactly, of the
   others those go whose union sketch has fewer than ``least_shared`` values in both.
5. ``verify`` computes the exact Jaccard similarity of the pairs that are left on full sets.  Sketches and sets of a node
   with many pairs are sent to as many salts as those need.

Defined results: null text counts as empty; null ids take part in no link (their component is null unless their copies
have ids); repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, map_arrow, materialize, side
from .ngram_join import ONE_TASK, _groups, _need, components, hub_pairs, least_ids, node_of, open_postings, sets_of

WORDS = 4
PERCENT = 80
RETAINED = 256
RISK = 1e-9
#: Cells of the count sketch, and cells that travel as one row.
CELLS_LOG2 = 22
BLOCK = 1 << 16
#: Values that are counted more often than the mean cell, times this power of two, are dealt over salts.
HOT_LOG2 = 10
#: Parities of a set's counts in buckets, 64 a word.
PARITIES = 1024
FOLD = tuple(f"b{i}" for i in range(PARITIES // 64))
#: Hubs of a value's size class in the first round; a further round for each further number, while lists have many pairs.
HUBS = (1, 4, 16, 64)
#: A list has many pairs beyond this number a node.
FEW = 8
#: Lists of at most this many nodes are compared side by side.
SMALL = 48
#: Pairs of a node that meet its sketch or set in one task.
SHARE = 500


def least_shared(k: int, percent: int, risk: float = RISK) -> int:
    """The count that a sample of ``k`` values, each in both sets with the given chance, falls under with at most ``risk``."""
    p, below = percent / 100, 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > risk:
            return c
    return k


def profile(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, node, n) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(node_of(s), len(s)) for _, s in sets_of(batch.column("_text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], ["_id", "node", "n"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return materialize(rows.transform(map_arrow, scan, f"_id {id_type}, node long, n long"))


def sketches(docs: DataFrame, prof: DataFrame, id_col: str, text_col: str, size: int, k: int, broadcast_rows: int) -> DataFrame:
    """(_id, node, n, kept, fold), one row a node: ``kept`` are the k least hashes, as signed numbers in the same order, and
    ``fold`` the parities of the set's counts in 1024 buckets.

    The text is scanned again, so that no sketch is shuffled to find one row a node.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    first = materialize(prof.where("n > 0").groupBy("node").agg(F.min("_id").alias("_id")).where("_id is not null"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, kept, folds = [], [], [], np.zeros((batch.num_rows, len(FOLD)), np.int64)
            for row, s in sets_of(batch.column("_text"), size):
                folds[row] = np.packbits((np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8), bitorder="little").view(np.int64)
                nodes.append(node_of(s))
                sizes.append(len(s))
                kept.append((s[:k] ^ np.uint64(1 << 63)).view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, *(pa.array(np.ascontiguousarray(folds[:, i])) for i in range(len(FOLD)))], ["_id", "node", "n", "kept", *FOLD])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(side(first.select("_id").distinct(), broadcast_rows), "_id", "left_semi")
    made = rows.transform(map_arrow, scan, f"_id {id_type}, node long, n long, kept array<long>, " + ", ".join(f"{b} long" for b in FOLD))
    made = materialize(made.select("_id", "node", "n", "kept", F.struct(*FOLD).alias("fold")))
    wanted = first.count()
    if made.count() == wanted:
        return made
    # ids of several rows: only the texts that they stand for, once each
    own = made.join(side(first, broadcast_rows), ["node", "_id"], "left_semi")
    out = materialize(own.dropDuplicates(["node"]))
    discard(made)
    return out


def _cells(values: np.ndarray) -> np.ndarray:
    return K.mix(values.view(np.uint64)) >> np.uint64(64 - CELLS_LOG2)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("kept")
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def levels(nodes: DataFrame) -> np.ndarray:
    """Log2 of how often each cell's values are retained."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.zeros(1 << CELLS_LOG2, np.uint16)
        for batch in batches:
            values, _ = _lists(batch)
            cells, got = np.unique(_cells(values), return_counts=True)
            local[cells] = np.minimum(local[cells] + got, 65535)
        for b in range(len(local) // BLOCK):
            part = local[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(c, np.uint16).astype(np.int64)
        for b, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.log2(np.maximum(c, 1)).astype(np.uint8).tobytes()], pa.binary())], ["block", "level"])

    out = np.zeros(1 << CELLS_LOG2, np.uint8)
    summed = nodes.select("kept").transform(map_arrow, count, "block int, counts binary").repartition("block").transform(map_arrow, add_up, "block int, level binary")
    for r in summed.toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.level, np.uint8)
    return out


def inverted(nodes: DataFrame, level: np.ndarray, k: int, percent: int, hot_log2: int) -> DataFrame:
    """(token, salt, node, n, pos, cls): the lists of nodes with a partner of a fitting size.

    ``pos`` is the token's place among the values of a set whose partners' sketches all are full sets, where it bounds how
    much both can share; else 0, which bounds nothing.  Lists of the same nodes are one, under a fingerprint of their nodes
    and with their first places; places bound what a pair shares where it meets first, and that is the first of such lists.
    """
    spark = nodes.sparkSession
    shared, order = least_shared(k, percent), spark.sparkContext.broadcast(level)
    hot = hot_log2 + int(np.ceil(np.log2(np.exp2(level.astype(float)).mean())))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = order.value
        for batch in batches:
            values, counts = _lists(batch)
            if not len(values):
                continue
            n, node = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            must = np.where(100 * n <= percent * k, -(-percent * n // 100), np.minimum(-(-percent * n // 100), shared))
            row = np.repeat(np.arange(len(n)), counts)
            lv = by_cell[_cells(values)]
            by = np.lexsort((values, lv, row))
            first = np.repeat(np.cumsum(counts) - counts, counts)
            place = np.arange(len(by)) - first
            listed = place < np.repeat(counts - must + 1, counts)
            by, place = by[listed], place[listed]
            row, lv, values = row[by], lv[by], values[by]
            place = np.where(100 * n[row] <= percent * k, place, 0)
            salts = np.uint64(1) << np.maximum(lv.astype(np.int64) - hot, 0).astype(np.uint64)
            salt = (K.mix(node.view(np.uint64))[row] % salts).astype(np.int32)
            cols = [values, salt, node[row], n[row].astype(np.int32), place.astype(np.int32), salts > 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "salt", "node", "n", "pos", "dealt"])

    posted = nodes.where("n > 0").select("node", "n", "kept").transform(map_arrow, emit, "token long, salt int, node long, n int, pos int, dealt boolean")
    beside = Window.partitionBy("token", "salt").orderBy("n", "node")
    fits = lambda small, large: F.coalesce(100 * small >= percent * large, F.lit(False))
    whole = Window.partitionBy("token", "salt")
    met = posted.withColumns({"_less": F.lag("n").over(beside), "_more": F.lead("n").over(beside), "_same": F.bit_xor(F.xxhash64("node")).over(whole), "_many": F.count("*").over(whole)})
    cls = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    fitting = met.where(F.col("dealt") | fits(F.col("_less"), F.col("n")) | fits(F.col("n"), F.col("_more")))
    named = fitting.withColumn("token", F.when(F.col("dealt"), F.col("token")).otherwise(F.xxhash64("_same", "_many")))
    once = named.groupBy("token", "salt", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    return materialize(once.withColumn("cls", cls.cast("int")))


def close_pairs(posted: DataFrame, percent: int, every: bool, few: int = FEW, small: int = SMALL) -> DataFrame:
    """(a, b, token) of lists with components and parities: the pairs across components that may be linked, by their sizes,
    places and parities; ``a`` is the smaller set.

    Unless ``every`` is asked for, a list with more than ``few`` pairs a node gives each node's likeliest pair instead, and
    a row with its token and no pair.  Nodes outside a token's largest component visit its other salts.  Pairs are
    compared in the list's task and become rows only where they may be linked.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, salt, guest, node, n, pos, comp, *fold in _groups(batches):
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            start, n, pos, fold = np.flatnonzero(new), n.astype(np.int64), pos.astype(np.int64), np.stack(fold, 1).view(np.uint64)  # bits of signed numbers are counted without their sign
            size, group, last = np.diff(np.append(start, len(token))), np.cumsum(new) - 1, guest.astype(bool)
            coarse = np.bitwise_xor.reduce(fold.reshape(len(fold), -1, 4), 1)  # parities in 256 buckets, a lower bound

            def fitting(x, y):
                """Of rows x and y the pairs that may be linked, and how much their parities differ for their size."""
                first = (n[x] < n[y]) | ((n[x] == n[y]) & (node[x] < node[y]))
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                fit = (comp[x] != comp[y]) & (100 * low >= percent * high) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= -(-percent * (low + high) // (100 + percent)))
                fit &= np.where(first, pos[x], pos[y]) < _need(low, percent)
                x, y = x[fit], y[fit]
                got = []
                for i in range(0, len(x), 50_000):
                    u, v = x[i : i + 50_000], y[i : i + 50_000]
                    for bits in (coarse, fold):
                        differ = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
                        near = (100 + percent) * differ <= (100 - percent) * (n[u] + n[v])
                        u, v, differ = u[near], v[near], differ[near]
                    got.append((u, v, differ / (n[u] + n[v])))
                return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [x, y, np.zeros(0)]

            def likeliest(x, y, d):
                by = np.lexsort((d, x))
                by = by[np.concatenate([[True], x[by][1:] != x[by][:-1]])] if len(by) else by
                return x[by], y[by]

            def rows(x, y, tokens):
                """The pairs of rows x and y, once each, and the tokens that come again."""
                swap = (n[x] > n[y]) | ((n[x] == n[y]) & (node[x] > node[y]))
                pairs, none = np.unique(np.stack([node[np.where(swap, y, x)], node[np.where(swap, x, y)]], 1), axis=0), pa.nulls(len(tokens), pa.int64())
                ends = [pa.concat_arrays([pa.array(pairs[:, i], pa.int64()), none]) for i in (0, 1)]
                return pa.RecordBatch.from_arrays([*ends, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(tokens, pa.int64())])], ["a", "b", "token"])

            # short lists: each row with the one that comes d rows later in its list
            left, x, y = np.flatnonzero((size[group] > 1) & (size[group] <= small)), [], []
            until = (start + size)[group]
            for d in range(1, small):
                left = left[left + d < until[left]]
                if not len(left):
                    break
                some = left[~last[left + d] & (comp[left] != comp[left + d])]  # of two visitors, or of one component: not here
                x.append(some)
                y.append(some + d)
            if x:
                x, y, d = fitting(np.concatenate(x), np.concatenate(y))
                many = np.zeros(len(start), bool) if every else np.bincount(group[x], minlength=len(start)) > few * size
                dense = many[group[x]]
                u, v = likeliest(np.concatenate([x[dense], y[dense]]), np.concatenate([y[dense], x[dense]]), np.concatenate([d[dense]] * 2))
                yield rows(np.concatenate([x[~dense], u]), np.concatenate([y[~dense], v]), token[start[many]])
            # long lists: rows outside the largest component with all, a strip at a time
            for lo, hi in zip(start[size > small], (start + size)[size > small], strict=True):
                at = np.arange(lo, hi)
                here = at[~last[lo:hi]]
                if not len(here):
                    continue
                comps, index, many = np.unique(comp[here], return_inverse=True, return_counts=True)
                top = comp == comps[many.argmax()]
                outer = at[last[lo:hi] | ~top[lo:hi]]
                held, near, found, dense = [], [], 0, False
                strip = max(1, 1_000_000 // len(here))
                for i in range(0, len(outer), strip):
                    part = outer[i : i + strip]
                    x, y, d = fitting(np.repeat(part, len(here)), np.tile(here, len(part)))
                    once = top[y] | last[x] | (x < y)  # two outer rows are seen from both
                    if every:
                        yield rows(x[once], y[once], token[:0])
                        continue
                    found += int(once.sum())
                    dense = dense or found > few * (hi - lo)
                    near.append(likeliest(x, y, d))
                    held = [] if dense else [*held, (x[once], y[once])]
                taken = near if dense else held
                if taken:
                    yield rows(*[np.concatenate(c) for c in zip(*taken, strict=True)], token[lo : lo + int(dense)])

    cols = ["token", "salt", "guest", "node", "n", "pos", "comp"]
    sent = posted.withColumn("guest", F.lit(0))
    most = posted.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("salt").alias("salts")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.max("salts").alias("salts")).where("salts > 0")
    dealt = materialize(most.select("token", F.col("top.comp").alias("top"), "salts"))
    if not dealt.isEmpty():
        outer = posted.withColumnRenamed("salt", "own").join(dealt, "token").where("comp <> top")
        visits = outer.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts")))).where("salt <> own").withColumn("guest", F.lit(1))
        sent = sent.unionByName(visits.drop("own", "top", "salts"))
    sent = sent.select(*cols, *[F.col(f"fold.{b}").alias(b) for b in FOLD])
    met = sent.repartition("token", "salt").sortWithinPartitions("token", "salt", F.desc("guest")).transform(map_arrow, compare, "a long, b long, token long")
    return materialize(met.distinct())


def _with(pairs: DataFrame, values: DataFrame, end: str, share: int, broadcast_rows: int) -> DataFrame:
    """``pairs`` with the columns of ``values`` for their node ``end``; a node of many pairs is dealt over salts."""
    other = "b" if end == "a" else "a"
    of = values.select([F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in values.columns])
    many = materialize(pairs.groupBy(end).agg(F.ceil(F.count("*") / share).cast("int").alias("_salts")).where("_salts > 1"))
    if many.isEmpty():
        return pairs.join(of, end)
    held = side(many, broadcast_rows)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = pairs.join(held, end, "left").withColumn("_salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("_salts")
    copies = of.join(held, end, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [end, "_salt"]).drop("_salt")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs, once each."""
    return pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()


def alike(pairs: DataFrame, nodes: DataFrame, percent: int, share: int, broadcast_rows: int) -> DataFrame:
    """The pairs whose sets do not differ in more parities than sets of the wanted similarity can."""
    held = nodes.select("node", "n", "fold")
    met = _with(_with(pairs, held, "a", share, broadcast_rows), held, "b", share, broadcast_rows)
    differ = sum((F.bit_count(F.col(f"fold_a.{b}").bitwiseXOR(F.col(f"fold_b.{b}"))) for b in FOLD), F.lit(0))
    return materialize(met.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def estimate(pairs: DataFrame, nodes: DataFrame, k: int, percent: int, share: int, broadcast_rows: int) -> DataFrame:
    """(a, b, sure) of the pairs that may be linked: surely where both sketches are full sets."""
    ends = materialize(_ends(pairs))
    held = nodes.select("node", "n", "kept").join(side(ends, broadcast_rows), "node", "left_semi")
    met = _with(_with(pairs, held, "a", share, broadcast_rows), held, "b", share, broadcast_rows)
    whole = F.size(F.array_intersect("kept_a", "kept_b"))
    least = F.slice(F.sort_array(F.array_union("kept_a", "kept_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect(least, "kept_a"), "kept_b"))
    full = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    linked = (100 + percent) * whole >= percent * (F.col("n_a") + F.col("n_b"))
    return materialize(met.where(F.when(full, linked).otherwise(common >= least_shared(k, percent))).select("a", "b", full.alias("sure")))


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int, broadcast_rows: int) -> DataFrame:
    """(node, n, items): the whole sets of the wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s for _, s in sets_of(batch.column("_text"), size)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["node", "n", "items"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(side(ids, broadcast_rows), "_id", "left_semi")
    return materialize(texts.transform(map_arrow, run, "node long, n long, items array<long>").dropDuplicates(["node"]))


def verify(pairs: DataFrame, sets: DataFrame, percent: int, share: int, broadcast_rows: int) -> DataFrame:
    """Of (a, b) the pairs of the wanted similarity, by their full sets."""
    met = _with(_with(pairs.select("a", "b"), sets, "a", share, broadcast_rows), sets, "b", share, broadcast_rows)
    common = F.size(F.array_intersect("items_a", "items_b"))
    return met.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, k: int = RETAINED, hubs: tuple[int, ...] = HUBS,
                    broadcast_rows: int = 500_000, hot_log2: int = HOT_LOG2, share: int = SHARE, one_task: int = ONE_TASK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links) and kept (whether
    that is the row's own)."""
    prof = profile(docs, id_col, text_col, size)
    nodes = sketches(docs, prof, id_col, text_col, size, k, broadcast_rows)
    folds = nodes.select("node", "fold")
    lists = inverted(nodes, levels(nodes), k, percent, hot_log2)

    def tried(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        likely = estimate(pairs, nodes, k, percent, share, broadcast_rows)
        links, unsure = likely.where("sure").select("a", "b"), likely.where("not sure")
        sets = None
        if not unsure.isEmpty():
            sets = full_sets(docs, materialize(nodes.join(side(materialize(_ends(unsure)), broadcast_rows), "node", "left_semi").select("_id")), id_col, text_col, size, broadcast_rows)
            links = links.unionByName(verify(unsure, sets, percent, share, broadcast_rows))
        found = materialize(links)
        if not found.isEmpty():
            labels = components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))), one_task)
        discard(pairs, likely, found, sets)
        return labels

    labels, posted = None, lists.withColumn("comp", F.col("node"))
    if hubs:
        near = materialize(hub_pairs(posted, percent, hubs[0], 0))
        labels = tried(alike(near, nodes, percent, share, broadcast_rows), labels)
        discard(near)
    step = 1
    while True:
        if labels is not None:
            posted = open_postings(lists, labels, broadcast_rows)
        met = close_pairs(posted.join(folds, "node"), percent, every=step >= len(hubs))
        pairs, again = met.where("a is not null").select("a", "b"), met.where("a is null").select("token")
        if not pairs.isEmpty():
            labels = tried(pairs, labels)
        if again.isEmpty():
            break
        lists, step = materialize(lists.join(side(again, broadcast_rows), "token", "left_semi")), step + 1
        posted = lists.withColumn("comp", F.col("node"))
        discard(met)
    heavy, light = least_ids(prof, labels, broadcast_rows)
    rows = prof.where("n > 0").join(F.broadcast(heavy.withColumnRenamed("component_id", "_heavy").withColumn("_known", F.lit(True))), "node", "left")
    linked = rows.where("_known").select("_id", "n", F.col("_heavy").alias("component_id")).unionByName(rows.where("_known is null").select("_id", "n", "node").join(light, "node").select("_id", "n", "component_id"))
    out = linked.unionByName(prof.where("n = 0").select("_id", "n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
