"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is scanned by a finite automaton over its bytes that says where units (code points, words, lines) begin and where
marks (the sentinels) end.  What a stretch of bytes does is a function: for each state it may be entered in, the state it
is left in and how many units and marks lie in it.  Such functions compose associatively, so stretches are scanned apart
from each other: strips of a text within a task, and chunks of a giant text by different tasks.

1. ``strips``: each strip's function, all start states at once, one numpy step a byte column.
2. Composition from the left gives every strip, and every chunk, its entry state and the number of units before it.
3. Selection: the strip that holds the n-th unit is the only one walked again, from its known entry state.

A text of one chunk is resolved where it lies.  The chunks of a longer one are dealt out over tasks, their functions
(a few bytes each, at most 32,768 for the longest string Spark holds) are composed by text, and the two chunks that
hold its cuts are walked by whichever task has them.  Nothing but chunks and functions is ever held in Python.

Defined results: null text counts as empty; null id draws its cuts like the empty id; repeated rows, ties and copies are
transformed alike, each row by its own id; extra columns stay, except those named like results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, materialize

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text that one task scans at once.
CHUNK = 1 << 16
#: Bytes of a strip, whose function numpy builds a column at a time.
STRIP = 64
#: Of 100 documents: plain ones from this on, and those with the suffix first among the others.
PLAIN_FROM, SPM_BELOW = 90, 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


@dataclass(frozen=True)
class Automaton:
    """``to[state, byte]``; ``unit`` and ``mark`` say whether a byte, met in a state, begins a unit or ends a mark.
    State 0 is the start; byte 256 pads strips and changes nothing."""

    to: np.ndarray
    unit: np.ndarray
    mark: np.ndarray

    @property
    def states(self) -> int:
        return len(self.to)


def _marks(sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the automaton that follows all sentinels at once, and where one of them ends."""
    known = sorted({s[:i] for s in sentinels for i in range(len(s))}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(known)}
    to, ends = np.zeros((len(known), 257), np.int64), np.zeros((len(known), 257), np.int64)
    for p, i in number.items():
        to[i, 256] = i
        for byte in range(256):
            seen = p + bytes([byte])
            ends[i, byte] = any(seen.endswith(s) for s in sentinels)
            to[i, byte] = next(number[seen[k:]] for k in range(len(seen) + 1) if seen[k:] in number)
    return to, ends


def _units(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and unit begins of code points, words (runs of anything but white space) or lines."""
    byte = np.arange(257)
    if kind == "chars":  # state: bytes that the code point still has
        more = np.select([byte >= 256, byte >= 0xF0, byte >= 0xE0, byte >= 0xC0], [0, 3, 2, 1], 0)
        follow = (byte >= 0x80) & (byte < 0xC0)
        to = np.stack([more] + [np.where(follow, left - 1, more) for left in (1, 2, 3)])
        unit = np.stack([~follow & (byte < 256)] * 4)
    elif kind == "words":  # state: inside a word
        space = np.isin(byte, [32, 9, 10, 11, 12, 13])
        to = np.stack([(~space).astype(int)] * 2)
        unit = np.stack([~space & (byte < 256), np.zeros(257, bool)])
    elif kind == "lines":  # state: inside a line
        to = np.stack([(byte != 10).astype(int)] * 2)
        unit = np.stack([byte < 256, np.zeros(257, bool)])
    else:
        raise ValueError(f"units are chars, words or lines, not {kind}")
    to[:, 256] = np.arange(len(to))
    return to, unit.astype(np.int64)


@cache
def automaton(units: str = "chars", sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """The product of both automata, of its reachable states only."""
    ut, ue = _units(units)
    mt, me = _marks(tuple(s.encode() for s in sentinels))
    number, todo = {(0, 0): 0}, [(0, 0)]
    for u, m in todo:
        for pair in zip(ut[u].tolist(), mt[m].tolist(), strict=True):
            if pair not in number:
                number[pair] = len(number)
                todo.append(pair)
    to = np.array([[number[p] for p in zip(ut[u].tolist(), mt[m].tolist(), strict=True)] for u, m in todo])
    return Automaton(to, np.stack([ue[u] for u, _ in todo]), np.stack([me[m] for _, m in todo]))


def _strips(a: Automaton, texts: list[np.ndarray], width: int):
    """Strips of all texts as rows of padded bytes, the first strip of each text, and their functions."""
    n = np.array([-(-len(t) // width) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    rows = np.full((int(off[-1]), width), 256, np.int64)
    flat = rows.reshape(-1)
    for t, at in zip(texts, off[:-1] * width, strict=True):
        flat[at : at + len(t)] = t
    state = np.tile(np.arange(a.states), (len(rows), 1))
    units, marks = np.zeros_like(state), np.zeros_like(state)
    to, both = a.to.reshape(-1), (a.unit + (a.mark << 32)).reshape(-1)
    for k in range(width):
        at = state * 257 + rows[:, k, None]
        units += both[at]
        state = to[at]
    marks, units = units >> 32, units & 0xFFFFFFFF
    return rows, off, state, units, marks


def _entries(a: Automaton, off: np.ndarray, state: np.ndarray, units: np.ndarray, marks: np.ndarray):
    """Of every strip and start state of its text: state at entry, units before; and each text's own function."""
    texts, n = len(off) - 1, np.diff(off)
    now = np.tile(np.arange(a.states), (texts, 1))
    got, met = np.zeros_like(now), np.zeros_like(now)
    entry, before = np.zeros_like(state), np.zeros_like(units)
    by = np.argsort(-n, kind="stable")
    for k in range(int(n.max(initial=0))):
        live = by[: int(np.searchsorted(-n[by], -k, "left"))]  # texts of more than k strips
        row = off[live] + k
        entry[row], before[row] = now[live], got[live]
        s = now[live]
        got[live] += np.take_along_axis(units[row], s, 1)
        met[live] += np.take_along_axis(marks[row], s, 1)
        now[live] = np.take_along_axis(state[row], s, 1)
    return entry, before, now, got, met


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """The byte strings of a column as arrays; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return []
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _groups(texts: list[np.ndarray], most: int = 1 << 20):
    """Neighbouring texts of about ``most`` bytes together."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _select(a: Automaton, rows: np.ndarray, off: np.ndarray, entry: np.ndarray, before: np.ndarray, total: np.ndarray, length: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each text, where its unit number ``want`` (from 0) begins, in bytes; its length if it has no more units.

    ``entry`` and ``before`` are those of the text's start state.
    """
    out = length.copy()
    some = np.flatnonzero(want < total)
    if not len(some):
        return out
    # before of a text's strips never falls: shifted by text, one search finds the strip of each
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    step = int(total.max()) + 1
    strip = np.searchsorted(before + text_of * step, want[some] + some * step, "right") - 1
    state, seen = entry[strip], before[strip]
    found = np.full(len(some), -1)
    for k in range(rows.shape[1]):
        byte = rows[strip, k]
        seen = seen + a.unit[state, byte]
        state = a.to[state, byte]
        found = np.where((found < 0) & (seen > want[some]), k, found)
    out[some] = (strip - off[some]) * rows.shape[1] + found
    return out


FUNCTION = "struct<to:array<int>,units:array<bigint>,marks:array<bigint>>"
CUTS = "struct<n:bigint,marks:bigint,first:bigint,last:bigint>"
PLACES = "struct<n:bigint,marks:bigint,chunks:array<int>,entries:array<int>,wants:array<bigint>>"


def _drawn(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(x, y), np.maximum(x, y)


def whole_scan(units: str, strip: int = STRIP):
    """UDF (bytes, h1, h2) -> units, marks and both cuts in bytes, of texts of one chunk."""

    @F.arrow_udf(CUTS)
    def scan(data: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, texts = automaton(units), _bytes(data)
        x, y = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        cols = [np.zeros(len(texts), np.int64) for _ in range(4)]
        for part in _groups(texts):
            some = texts[part]
            rows, off, state, unit, mark = _strips(a, some, strip)
            entry, before, _, got, met = _entries(a, off, state, unit, mark)
            n, length = got[:, 0], np.array([len(t) for t in some], np.int64)
            ends = [_select(a, rows, off, entry[:, 0], before[:, 0], n, length, want) for want in _drawn(x[part], y[part], n)]
            for col, found in zip(cols, (n, met[:, 0], *ends), strict=True):
                col[part] = found
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n", "marks", "first", "last"])

    return scan


def chunk_function(units: str, strip: int = STRIP):
    """UDF bytes -> what a chunk does from each state that it may be entered in."""

    @F.arrow_udf(FUNCTION)
    def scan(data: pa.Array) -> pa.Array:
        a, texts = automaton(units), _bytes(data)
        to, got, met = [], [], []
        for part in _groups(texts):
            _, off, state, unit, mark = _strips(a, texts[part], strip)
            _, _, s, u, m = _entries(a, off, state, unit, mark)
            to += s.astype(np.int32).tolist()
            got += u.tolist()
            met += m.tolist()
        return pa.StructArray.from_arrays([pa.array(to, pa.list_(pa.int32())), pa.array(got, pa.list_(pa.int64())), pa.array(met, pa.list_(pa.int64()))], ["to", "units", "marks"])

    return scan


def compose():
    """UDF (functions of a text's chunks in order, h1, h2) -> units, marks, and for both cuts the chunk that holds it, the
    state it is entered in and the unit wanted in it (-1: the text's end)."""

    @F.arrow_udf(PLACES)
    def fold(functions: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        out = []
        for chunks, x, y in zip(functions.to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True):
            state, n, marks, entered = 0, 0, 0, []
            for f in chunks:
                entered.append((state, n))
                n, marks, state = n + f["units"][state], marks + f["marks"][state], f["to"][state]
            before = np.array([b for _, b in entered])
            at, entries, wants = [], [], []
            for cut in sorted((x % (n + 1), y % (n + 1))):
                k = int(np.searchsorted(before, cut, "right")) - 1 if cut < n else len(chunks) - 1
                at.append(k)
                entries.append(entered[k][0])
                wants.append(cut - entered[k][1] if cut < n else -1)
            out.append({"n": n, "marks": marks, "chunks": at, "entries": entries, "wants": wants})
        return pa.array(out, pa.struct([("n", pa.int64()), ("marks", pa.int64()), ("chunks", pa.list_(pa.int32())), ("entries", pa.list_(pa.int32())), ("wants", pa.list_(pa.int64()))]))

    return fold


def locate(units: str, strip: int = STRIP):
    """UDF (bytes, entry state, wanted unit) -> where that unit begins in the chunk."""

    @F.arrow_udf("bigint")
    def find(data: pa.Array, entries: pa.Array, wants: pa.Array) -> pa.Array:
        a, texts = automaton(units), _bytes(data)
        start, want = entries.to_numpy(zero_copy_only=False), wants.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for part in _groups(texts):
            some, s = texts[part], start[part]
            rows, off, state, unit, mark = _strips(a, some, strip)
            entry, before, _, got, _ = _entries(a, off, state, unit, mark)
            text_of, each = np.repeat(np.arange(len(some)), np.diff(off)), np.arange(len(off) - 1)
            mine, length = s[text_of], np.array([len(t) for t in some], np.int64)
            w = np.where(want[part] < 0, got[each, s], want[part])
            out[part] = _select(a, rows, off, entry[np.arange(len(entry)), mine], before[np.arange(len(entry)), mine], got[each, s], length, w)
        return pa.array(out)

    return find


def draws(id_col: Column, version: str = "1:") -> list[Column]:
    """h1 to h4 of a row, from the hash of its id alone."""
    digest = F.sha2(F.concat(F.lit(version), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _giant_cuts(long: DataFrame, units: str, chunk: int) -> DataFrame:
    """(_key, _cuts) of the texts of several chunks, each scanned by several tasks."""
    spark = long.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = lambda k: F.substring(F.col("_data"), k * chunk + 1, F.lit(chunk))
    pieces = long.select("_key", "_h1", "_h2", "_data", F.explode(F.sequence(F.lit(0), ((F.octet_length("_data") - 1) / chunk).cast("int"))).alias("k"))
    pieces = pieces.select("_key", "_h1", "_h2", "k", cut(F.col("k")).alias("piece")).repartition(tasks, "_key", "k")
    made = materialize(pieces.select("_key", "_h1", "_h2", "k", chunk_function(units)("piece").alias("f")))
    ordered = made.groupBy("_key").agg(F.first("_h1").alias("_h1"), F.first("_h2").alias("_h2"), F.array_sort(F.collect_set(F.struct("k", "f"))).alias("fs"))
    places = materialize(ordered.select("_key", compose()(F.transform("fs", lambda x: x["f"]), "_h1", "_h2").alias("p")))
    sought = long.select("_key", "_data").dropDuplicates(["_key"]).join(places, "_key")
    sought = sought.select("_key", "p", F.posexplode(F.transform("p.chunks", cut)).alias("e", "piece"))
    at = lambda name: F.col(f"p.{name}")[F.col("e")]
    ends = sought.select("_key", "p", "e", (at("chunks").cast("long") * chunk + locate(units)("piece", at("entries"), at("wants"))).alias("at"))
    both = ends.groupBy("_key").agg(F.first("p.n").alias("n"), F.first("p.marks").alias("marks"), F.min("at").alias("first"), F.max("at").alias("last"))
    return materialize(both.select("_key", F.struct("n", "marks", "first", "last").alias("_cuts")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  Sentinels can't overlap and don't occur in the text, so that each one's
    first place is the true one."""
    after = lambda s, sentinel: F.substring_index(s, sentinel, -1)
    upto = lambda s, sentinel: F.substring_index(s, sentinel, 1)
    head, middle = upto(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(upto(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(upto(head, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", units: str = "chars", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (units; null if plain), output and restored."""
    docs = docs.drop(*RESULTS)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    h1, h2, h3, h4 = draws(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.withColumns({"_h1": h1, "_h2": h2, "_h3": h3, "_h4": h4, "_data": text.cast("binary")})
    short = given.where(F.octet_length("_data") <= chunk).withColumn("_cuts", whole_scan(units)("_data", "_h1", "_h2"))
    # equal ids and texts have equal cuts, so that those are the key: no row number is needed
    long = given.where(F.octet_length("_data") > chunk).withColumn("_key", F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.col("_data")), 256))
    whole = short
    if not long.isEmpty():
        whole = short.unionByName(long.join(_giant_cuts(long.select("_key", "_h1", "_h2", "_data"), units, chunk), "_key").drop("_key"))
    first, last = F.col("_cuts.first").cast("int"), F.col("_cuts.last").cast("int")
    part = lambda start, length: F.substring(F.col("_data"), start + 1, length).cast("string")
    before, middle, after = part(F.lit(0), first), part(first, last - first), part(last, F.octet_length("_data") - last)
    form = F.when((F.octet_length("_data") == 0) | (F.col("_cuts.marks") > 0) | (F.col("_h3") % 100 >= plain_from), "plain").when(F.col("_h4") % 100 < spm_below, "spm").otherwise("psm")
    low, high = _least(F.col("_h1"), F.col("_h2"), F.col("_cuts.n"))
    formed = whole.withColumns({"n": F.col("_cuts.n"), "form": form})
    made = F.when(F.col("form") == "plain", F.col("_data").cast("string")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle))
    made = made.otherwise(F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    out = formed.withColumns({"prefix_chars": cut(low), "middle_chars": cut(high - low), "output": made})
    return out.withColumn("restored", restore(F.col("output"), F.col("form"))).select(*docs.columns, *RESULTS)


def _least(h1: Column, h2: Column, n: Column) -> tuple[Column, Column]:
    x, y = h1 % (n + 1), h2 % (n + 1)
    return F.least(x, y), F.greatest(x, y)
