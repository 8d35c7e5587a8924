"""Merkle manifest of a dataset: leaf digests, a tree a group, a tree over the groups' roots, and proofs.

Rows are leaves.  Within a group (``source``) they ascend by id; every ``arity`` consecutive nodes (the last run: fewer,
even one) become the hash of their digests, until one is left, the group's root.  The groups' roots, in order of the
groups, become the dataset's root in the same way.

The tree is built by a sparse forest, whose elements are maps from (tree, level, index) to digests.  Two forests merge by
union; whenever a run of siblings is complete (the sizes of all levels are known, so it is known when) its parent takes
its place, and a group's root becomes a leaf of the top tree.  That is associative, and any stretch of consecutive leaves
leaves a forest of a few nodes a level.

1. ``positions``: rows are dealt by ranges of (group, id) and sorted; counts of each range give every row its place.
2. Going up: each block of consecutive leaves becomes its forest of unresolved nodes; then, round by round, ``FAN``
   neighbouring forests merge in one task, until one block holds the root alone (a tree reduction whose rounds are
   tables, so that lost executors cost one task).
3. Going down the same rounds: a block that knows the way from its unresolved nodes to the root finds the way of each
   node it was given, so that at last every leaf has its siblings.  No task sees more than a block and its forest.

Defined results: a null column enters the hash as ``-``; the null group comes first; null ids come first in their group;
rows of equal ids are ordered by their digests, so that repeated rows have equal leaves at neighbouring places.  A table
without rows has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialize, side

ARITY = 3
#: Leaves of a block, and forests that merge in one task.
BLOCK = 30_000
FAN = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of the groups.
TOP = -1

Node = tuple[int, int, int]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and the value; nulls as a dash."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


class Shape:
    """Sizes of the levels of all trees that a task meets."""

    def __init__(self, groups: int, arity: int):
        self.arity, self.levels = arity, {}
        self.know(TOP, groups)

    def know(self, tree: int, leaves: int) -> None:
        if tree not in self.levels:
            sizes = [leaves]
            while sizes[-1] > 1:
                sizes.append(-(-sizes[-1] // self.arity))
            self.levels[tree] = sizes

    def size(self, tree: int, level: int) -> int:
        return self.levels[tree][level]

    def run(self, node: Node) -> list[Node]:
        """The node and its siblings, in order."""
        tree, level, i = node
        first = i - i % self.arity
        return [(tree, level, k) for k in range(first, min(first + self.arity, self.size(tree, level)))]

    def parent(self, node: Node) -> Node:
        tree, level, i = node
        return tree, level + 1, i // self.arity

    def lift(self, node: Node) -> Node:
        """The same digest's place in the top tree, once its own tree is one node."""
        tree, level, _ = node
        return (TOP, 0, tree) if tree != TOP and self.size(tree, level) == 1 else node

    def is_root(self, node: Node) -> bool:
        return node[0] == TOP and self.size(TOP, node[1]) == 1


class Forest:
    """Unresolved nodes, and on request the runs that were completed on the way."""

    def __init__(self, shape: Shape, keep_runs: bool = False):
        self.shape, self.nodes = shape, {}
        self.runs: dict[Node, list[str]] | None = {} if keep_runs else None

    def add(self, node: Node, value: str) -> None:
        shape = self.shape
        node = shape.lift(node)
        self.nodes[node] = value
        while not shape.is_root(node):
            run = shape.run(node)
            if not all(x in self.nodes for x in run):
                return
            values = [self.nodes.pop(x) for x in run]
            if self.runs is not None:
                self.runs[run[0]] = values
            node = shape.lift(shape.parent(node))
            self.nodes[node] = digest(*values)

    def merge(self, other: Forest) -> Forest:
        for node, value in other.nodes.items():
            self.add(node, value)
        return self

    def way(self, node: Node) -> tuple[list[str], list[str], Node]:
        """From a node up to the unresolved one: digests to the left and to the right of each step."""
        shape, lefts, rights = self.shape, [], []
        node = shape.lift(node)
        while not shape.is_root(node):
            run = shape.run(node)
            values = self.runs.get(run[0])
            if values is None:
                break
            at = node[2] - run[0][2]
            lefts.append("".join(values[:at]))
            rights.append("".join(values[at + 1 :]))
            node = shape.lift(shape.parent(node))
        return lefts, rights, node


NODES = "block long, tree long, level int, i long, size long, value string"
WAYS = "block long, tree long, level int, i long, lefts array<string>, rights array<string>"


def _load(batches, shape: Shape) -> Iterator[tuple[Node, str]]:
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("tree", "level", "i", "size", "value")]
        for tree, level, i, size, value in zip(*cols, strict=True):
            shape.know(tree, size)
            yield (tree, level, i), value


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def ascend(nodes: DataFrame, groups: int, arity: int) -> DataFrame:
    """The unresolved nodes of each block."""
    schema = pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("size", pa.int64()), ("value", pa.string())])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(Shape(groups, arity))
        for node, value in _load(table.to_batches(), forest.shape):
            forest.add(node, value)
        block = key[0].as_py()
        return pa.Table.from_batches([_table([(block, *node, forest.shape.size(node[0], 0), value) for node, value in forest.nodes.items()], schema)])

    return nodes.groupBy("block").applyInArrow(fold, NODES)


def tree_reduce(forests: DataFrame, groups: int, arity: int, fan: int) -> list[DataFrame]:
    """Rounds of merged forests, from those of the leaves' blocks to the root alone."""
    rounds = [forests]
    while rounds[-1].select("block").distinct().count() > 1:
        merged = rounds[-1].withColumn("block", F.floor(F.col("block") / fan).cast("long"))
        rounds.append(materialize(ascend(merged, groups, arity)))
    return rounds


def _walk(left: pa.Table, right: pa.Table, groups: int, arity: int):
    """Forest of a block with its runs, its nodes, and the known ways of its unresolved nodes."""
    forest = Forest(Shape(groups, arity), keep_runs=True)
    given = []
    for node, value in _load(left.to_batches(), forest.shape):
        given.append(node)
        forest.add(node, value)
    known = {(t, v, i): (x, y) for t, v, i, x, y in zip(*[right.column(c).to_pylist() for c in ("tree", "level", "i", "lefts", "rights")], strict=True)}
    return forest, given, known


def descend(nodes: DataFrame, ways: DataFrame, groups: int, arity: int) -> DataFrame:
    """Ways to the root of a block's nodes, from those of its unresolved nodes."""
    schema = pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])

    def unfold(left: pa.Table, right: pa.Table) -> pa.Table:
        forest, given, known = _walk(left, right, groups, arity)
        rows = []
        for block, node in zip(left.column("was").to_pylist(), given, strict=True):
            lefts, rights, top = forest.way(node)
            rows.append((block, *node, lefts + known[top][0], rights + known[top][1]))
        return pa.Table.from_batches([_table(rows, schema)], schema)

    return nodes.groupBy("block").cogroup(ways.groupBy("block")).applyInArrow(unfold, WAYS)


def _fold(value: str, lefts: list[str], rights: list[str]) -> str:
    for x, y in zip(lefts, rights, strict=True):
        value = digest(x, value, y)
    return value


def prove(leaves: DataFrame, ways: DataFrame, groups: int, arity: int) -> DataFrame:
    """(_at, subroot, proof_sha256, folded_root) of every leaf; ``given`` is the leaf that is held against the manifest."""
    schema = pa.schema([("_at", pa.int64()), ("subroot", pa.string()), ("n_siblings", pa.int32()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        forest, given, known = _walk(left, right, groups, arity)
        shape, rows, subroots = forest.shape, [], {}
        for at, node, value, other in zip(left.column("_at").to_pylist(), given, left.column("value").to_pylist(), left.column("given").to_pylist(), strict=True):
            lefts, rights, top = forest.way(node)
            lefts, rights = lefts + known[top][0], rights + known[top][1]
            tree = node[0]
            if tree not in subroots:
                levels = len(shape.levels[tree]) - 1
                subroots[tree] = _fold(value, lefts[:levels], rights[:levels])
            siblings = sum(len(x) + len(y) for x, y in zip(lefts, rights, strict=True)) // 64
            proof = digest(*[x + y for x, y in zip(lefts, rights, strict=True)])
            rows.append((at, subroots[tree], siblings, proof, _fold(other, lefts, rights)))
        return pa.Table.from_batches([_table(rows, schema)], schema)

    return leaves.groupBy("block").cogroup(ways.groupBy("block")).applyInArrow(run, "_at long, subroot string, n_siblings int, proof_sha256 string, folded_root string")


def positions(rows: DataFrame, group_col: str, order: list[str], block: int) -> tuple[DataFrame, int]:
    """``rows`` with tree (rank of the group), i (place in it), size (of the group), _at (place among all) and block; and
    the number of groups.

    Rows are dealt by ranges and sorted once.  What crosses tasks are counts: one a range and group, and one a range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, group_col, *order).sortWithinPartitions(group_col, *order)
    place = dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    place = materialize(place)
    spans = materialize(place.groupBy("_part", group_col).agg(F.count("*").alias("_rows"), F.min("_pos").alias("_from")))
    here = Window.partitionBy(group_col)
    within = spans.withColumns({"_before": F.coalesce(F.sum("_rows").over(here.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_rows").over(here), "_first": F.min("_part").over(here) == F.col("_part")})
    within = materialize(within)
    parts = within.groupBy("_part").agg(F.sum("_rows").alias("rows"), F.sum(F.col("_first").cast("long")).alias("firsts"))
    # one row a range: the only step in one task
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("_base"), F.coalesce(F.sum("firsts").over(up_to), F.lit(0)).alias("_groups"))
    ranked = within.join(offsets, "_part").withColumn("_new", F.sum(F.col("_first").cast("long")).over(Window.partitionBy("_part").orderBy("_from")))
    ranked = ranked.withColumn("_rank", F.when(F.col("_first"), F.col("_groups") + F.col("_new") - 1))
    ranked = materialize(ranked.withColumn("tree", F.max("_rank").over(here)))
    groups = ranked.agg(F.max("tree")).first()[0]
    known = ranked.select("_part", F.col(group_col).alias("_group"), "_from", "_before", "size", "_base", "tree")
    met = place.join(side(known, 500_000), (place["_part"] == known["_part"]) & place[group_col].eqNullSafe(known["_group"])).drop(known["_part"])
    out = met.withColumns({"i": F.col("_before") + F.col("_pos") - F.col("_from"), "_at": F.col("_base") + F.col("_pos")})
    out = materialize(out.withColumn("block", F.floor(F.col("_at") / block).cast("long")).drop("_part", "_pos", "_group", "_from", "_before", "_base"))
    discard(place, spans, within, ranked)
    return out, 0 if groups is None else groups + 1


def tampered(text: Column, id_col: Column) -> Column:
    """The text without its line ends, for every second id (by its crc32)."""
    return F.when(crc_mod(id_col, 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, given: Column | None = None, arity: int = ARITY, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per row: id, group, leaf, its group's root (subroot), the dataset's root, n_siblings and the digest of its proof,
    and what the proof makes of the leaf ``given`` (default: the row's own), with the verdict ``verified``."""
    own = leaf(*[F.col(c) for c in fields])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_source"), own.alias("value"), (own if given is None else given).alias("given"))
    digests = materialize(rows)
    placed, groups = positions(digests, "_source", ["_id", "value"], block)
    discard(digests)
    node = placed.select("block", "tree", F.lit(0).alias("level"), "i", "size", "value")
    if not groups:
        root, ways = None, docs.sparkSession.createDataFrame([], WAYS)
    else:
        rounds = tree_reduce(materialize(ascend(node, groups, arity)), groups, arity, fan)
        last = rounds[-1].first()
        root = last.value
        none = F.array().cast("array<string>")
        ways = rounds[-1].select("block", "tree", "level", "i", none.alias("lefts"), none.alias("rights"))
        for lower in reversed(rounds[:-1]):
            inner = lower.withColumn("was", F.col("block")).withColumn("block", F.floor(F.col("block") / fan).cast("long"))
            ways = materialize(descend(inner, ways, groups, arity))
    leaves = placed.select("block", "tree", F.lit(0).alias("level"), "i", "size", "value", "given", "_at")
    proofs = prove(leaves, ways, groups, arity)
    out = placed.select("_id", "_source", "value", "_at").join(proofs, "_at")
    root_col = F.lit(root).cast("string")
    return out.select(
        F.col("_id").alias(id_col), F.col("_source").alias(group_col), F.col("value").alias("leaf"), "subroot", root_col.alias("root"), "n_siblings", "proof_sha256", "folded_root", (F.col("folded_root") == root_col).alias("verified")
    )
