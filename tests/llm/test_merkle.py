import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fluxweave.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return H(*[enc(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def levels_of(values):
    out = [values]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row."""
    rows = [dict(r) | {"leaf": leaf_of(r, r["text"])} for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
    trees = [levels_of([r["leaf"] for r in groups[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            bad = r["text"]
            if bad is not None and zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 2 == 0:
                bad = bad.replace("\n", "")
            value, proof = leaf_of(r, bad), ""
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    first = at - at % 3
                    run = level[first : first + 3]
                    proof += "".join(run[: at - first] + run[at - first + 1 :])
                    value = H(*run[: at - first], value, *run[at - first + 1 :])
                    at //= 3
            out.append((r["doc_id"], r["leaf"], trees[k][-1][0], top[-1][0], H(proof), value, value == top[-1][0]))
    return out


FRAME = "doc_id long, text string, lang string, source string, n_chars long"


def run(docs, **options):
    given = M.leaf(*[M.tampered(F.col(c), F.col("doc_id")) if c == "text" else F.col(c) for c in M.FIELDS])
    got = M.manifest(docs, given=given, **options)
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("block, fan", [(30_000, 64), (10, 2), (1, 3), (7, 64)])
def test_brute_force_whatever_the_blocks(spark, docs, corpus, block, fan):
    rng = random.Random(block)
    more = [(1000 + i, rng.choice([None, "", "a\nb", f"t{i}\n"]), None, rng.choice(["é", "z", "Z", "solo" + str(i % 9), None]), i) for i in range(60)]
    more += [(None, "a\n", "en", "src0", None), (None, None, None, None, None), (3, "again", "en", "src0", 1), (3, "again", "en", "src0", 1)]
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in list(corpus) + more]
    frame = docs.unionByName(spark.createDataFrame(more, FRAME))
    assert sorted(run(frame, block=block, fan=fan), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [3], [4], [10], [1, 27, 1, 28], [1] * 13])
def test_small_trees(spark, sizes):
    rows = [(i, f"text\n{i}", "en", f"s{g:02d}", 1) for g, n in enumerate(sizes) for i in range(100 * g, 100 * g + n)]
    docs = spark.createDataFrame(rows, FRAME)
    dicts = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    assert sorted(run(docs, block=3, fan=2), key=key) == sorted(brute(dicts), key=key)


def test_forests_merge_in_any_order():
    rng = random.Random(1)
    sizes = [40, 1, 9, 5]
    shape = M.Shape(len(sizes), 3)
    leaves = []
    for t, n in enumerate(sizes):
        shape.know(t, n)
        leaves += [((t, 0, i), H(f"{t}/{i}")) for i in range(n)]
    trees = [levels_of([v for (t, _, _), v in leaves if t == k])[-1][0] for k in range(len(sizes))]
    root = levels_of(trees)[-1][0]
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(leaves)), 9))
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(leaves)], strict=True):
            forest = M.Forest(shape)
            for node, value in leaves[a:b]:
                forest.add(node, value)
            parts.append(forest)
        while len(parts) > 1:  # neighbours or not, in any grouping
            i, j = sorted(rng.sample(range(len(parts)), 2))
            parts[i].merge(parts.pop(j))
        assert list(parts[0].nodes.values()) == [root] and shape.is_root(next(iter(parts[0].nodes)))


def test_a_stretch_of_leaves_leaves_few_nodes():
    shape = M.Shape(1, 3)
    shape.know(0, 3**9)
    forest = M.Forest(shape)
    for i in range(1000, 15_000):
        forest.add((0, 0, i), H(str(i)))
    assert len(forest.nodes) <= 4 * 9


def test_odd_inputs(spark, clashing, empty):
    assert M.manifest(empty).count() == 0
    got = M.manifest(clashing.withColumns({"leaf": F.lit("x"), "tree": F.lit(1), "_id": F.lit(2), "value": F.lit(3)}), block=10)
    rows = got.collect()
    assert len(rows) == clashing.count() and all(r.verified for r in rows)


def test_other_columns_and_arity(spark):
    docs = spark.createDataFrame([(i, f"g{i % 2}", f"v{i}") for i in range(30)], "k long, g string, v string")
    got = M.manifest(docs, id_col="k", group_col="g", fields=("k", "v"), arity=2, block=4, fan=2).collect()
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2 and all(r.verified for r in got)
    changed = M.manifest(docs.withColumn("v", F.when(F.col("k") == 7, "w").otherwise(F.col("v"))), id_col="k", group_col="g", fields=("k", "v"), arity=2).collect()
    was, now = {r.k: r for r in got}, {r.k: r for r in changed}
    assert was[7].root != now[7].root and was[8].subroot == now[8].subroot and was[9].subroot != now[9].subroot
