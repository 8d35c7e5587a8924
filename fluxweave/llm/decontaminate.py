"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is held against training windows.

Test windows are hashed once on the driver (benchmarks are small; their bytes are measured first, and beyond
``block_bytes`` the benchmark is taken in blocks whose hits are merged by row).  Each executor scans its texts with
vectorised window hashes, verifies every hash hit word by word, and marks the words that verified windows cover.
One scan, no shuffle (one small shuffle of hits with several blocks).

Defined results: a null or empty text has no words and is clean; a null benchmark text has no window; a null item id
counts as the empty string; repeated rows are judged one by one; repeated items count once by id.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_arrow, with_uid

WINDOW = 13
MIN_SHARE = 20  # contaminated: at least one word in twenty is hit
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Windows of a block of test items: by length sorted hashes with their items and places, and the words of all items,
    which verify a hit; about five bytes for each byte of text."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(self.ids)}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bytes, begins and ends of words
        words = size = 0
        for w in K.words(pa.array([t for _, t in items], pa.string()), K.NOT_ALNUM):
            h = w.hash()
            for r in range(w.row1 - w.row0):
                a, b = int(w.off[r]), int(w.off[r + 1])
                n = min(window, b - a)
                if n:
                    g = K.ngrams(h[a:b], n)
                    parts[n].append((g, np.full(len(g), at[items[w.row0 + r][0]], np.int32), words + np.arange(a, b - n + 1)))
            held.append((w.data, w.starts + size, w.ends + size))
            words, size = words + len(w.starts), size + len(w.data)
        self.data, self.starts, self.ends = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(3))
        if size < 2**31:
            self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, each in parts.items():
            g, item, place = (np.concatenate([x[k] for x in each]) for k in range(3))
            by = np.lexsort((place, item, g))
            g, item, place = g[by], item[by], place[by].astype(np.int64 if words >= 2**31 else np.int32)
            self.by_length[n] = g, item, place

    def _same(self, w: K.Words, i: int, place: int, n: int) -> bool:
        mine = (self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(place, place + n))
        return all(w.word(i + k) == x for k, x in enumerate(mine))

    def hits(self, w: K.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are covered, and the items found by row of the chunk."""
        h, cover, found = w.hash(), np.zeros(len(w.starts) + 1, np.int32), defaultdict(set)
        row = K.row_of(w.off)
        for n, (known, item, place) in self.by_length.items():
            g = K.ngrams(h, n)
            if not len(g):
                continue
            at = np.searchsorted(known, g)
            held = known[np.minimum(at, len(known) - 1)] == g
            for i in np.flatnonzero(held & (row[: len(g)] == row[n - 1 : n - 1 + len(g)])):
                k, last, same = int(at[i]), -1, None
                while k < len(known) and known[k] == g[i]:
                    if item[k] != last or not same:  # an item that holds the window several times counts once
                        last, same = item[k], self._same(w, int(i), int(place[k]), n)
                        if same:
                            cover[i] += 1
                            cover[i + n] -= 1
                            found[int(row[i])].add(self.ids[last])
                    k += 1
        return np.cumsum(cover[:-1]) > 0, found


def _judge(n_words: int, n_hit: int, items: set[str]) -> tuple[int, int, int, str, bool]:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and MIN_SHARE * n_hit >= n_words


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield [(r.id, r.text) for r in block.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: id, the report columns, and ``hit_runs``, the covered word ranges [start, end)."""
    spark = docs.sparkSession
    sets = [spark.sparkContext.broadcast(WindowSet(b, window)) for b in _blocks(benchmark, item_col, item_text, block_bytes)]
    rows = with_uid(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    head = f"_uid long, _id {docs.schema[id_col].dataType.simpleString()}, n_words long"
    runs = "hit_runs array<struct<start:long,end:long>>"

    def found(tested):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in K.words(batch.column("_text"), K.NOT_ALNUM):
                    covered, items = tested.value.hits(w)
                    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    spans: dict[int, list] = defaultdict(list)
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        for r in range(int(np.searchsorted(w.off, a, "right")) - 1, len(w.off) - 1):  # a run may cross rows
                            lo, hi = max(int(a), int(w.off[r])), min(int(b), int(w.off[r + 1]))
                            if lo < hi:
                                spans[r].append((lo - int(w.off[r]), hi - int(w.off[r])))
                            if w.off[r + 1] >= b:
                                break
                    n = w.row1 - w.row0
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("_uid").slice(w.row0, n), batch.column("_id").slice(w.row0, n), pa.array(w.counts.astype(np.int64)),
                            pa.array([[{"start": a, "end": b} for a, b in spans.get(r, [])] for r in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string())),
                        ],
                        ["_uid", "_id", "n_words", "hit_runs", "items"],
                    )

        return run

    parts = [rows.transform(map_arrow, found(s), f"{head}, {runs}, items array<string>") for s in sets]
    all_hits = parts[0]
    if len(parts) > 1:  # the blocks of a large benchmark meet by row; rows without a hit carry empty arrays
        for p in parts[1:]:
            all_hits = all_hits.unionByName(p)
        all_hits = all_hits.groupBy("_uid").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_runs")).alias("hit_runs"), F.flatten(F.collect_list("items")).alias("items"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged, merged = [], []
            for n, spans, items in zip(batch.column("n_words").to_pylist(), batch.column("hit_runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                out: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans):
                    if out and s[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                merged.append([{"start": a, "end": b} for a, b in out])
                judged.append(_judge(n, sum(b - a for a, b in out), set(items)))
            cols = list(zip(*judged, strict=True)) if judged else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_uid"), batch.column("_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["_uid", "_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_runs"],
            )

    return all_hits.transform(map_arrow, judge, f"_uid long, {head.split(', ')[1]}, {REPORT}, {runs}").withColumnRenamed("_id", id_col)


def remove(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", window: int = WINDOW, block_bytes: int = 32 << 20) -> DataFrame:
    """``documents`` drops contaminated rows; ``spans`` cuts the hit words (and what stands between them) from those rows.

    All columns and the order of columns stay as they are.  Blocks of a large benchmark are applied one after the
    other for ``spans``; for ``documents`` their hits are merged by row first, since the share counts them together.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    spark, schema = docs.sparkSession, docs.schema
    sets = [spark.sparkContext.broadcast(WindowSet(b, window)) for b in _blocks(benchmark, item_col, item_text, block_bytes)]

    def kept(tested: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(text_col)
                keep, cut = np.ones(batch.num_rows, bool), {}
                for w in K.words(text, K.NOT_ALNUM):
                    covered = np.zeros(len(w.starts), bool)
                    for s in tested:
                        covered |= s.value.hits(w)[0]
                    total = np.concatenate([[0], np.cumsum(covered)])
                    n_hit = total[w.off[1:]] - total[w.off[:-1]]
                    bad = (n_hit > 0) & (MIN_SHARE * n_hit >= w.counts)
                    keep[w.row0 : w.row1] = ~bad
                    if mode == "spans":
                        for r in np.flatnonzero(bad):
                            a, b = int(w.off[r]), int(w.off[r + 1])
                            raw, at, out, base = (text[w.row0 + int(r)].as_py() or "").encode(), 0, [], 0
                            first = len(raw) - (len(raw) if b == a else 0)
                            base = int(w.starts[a]) - _lead(raw) if first else 0
                            edge = np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]]))
                            for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                                out.append(raw[at : int(w.starts[a + lo]) - base])
                                at = int(w.ends[a + hi - 1]) - base
                            cut[w.row0 + int(r)] = b"".join([*out, raw[at:]]).decode()
                if mode == "documents":
                    yield batch.filter(pa.array(keep))
                elif not cut:
                    yield batch
                else:
                    i = batch.schema.get_field_index(text_col)
                    fixed = pa.array([cut.get(r, t) for r, t in enumerate(text.to_pylist())], text.type)
                    yield pa.RecordBatch.from_arrays([fixed if k == i else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

        return run

    return docs.transform(map_arrow, kept(sets), schema)


def _lead(raw: bytes) -> int:
    """Bytes before the first word."""
    return int(np.argmax(~K.NOT_ALNUM[np.frombuffer(raw, np.uint8)]))
