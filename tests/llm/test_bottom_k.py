import random
import re

import pytest
from pyspark.sql import functions as F

from fluxweave.llm import bottom_k as B

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, percent=80, size=4):
    """{id: (n, component)} by every pair."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if sets[x][1] and sets[y][1] and sets[x][0] is not None and sets[y][0] is not None:
                c = len(sets[x][1] & sets[y][1])
                if 100 * c >= percent * (len(sets[x][1]) + len(sets[y][1]) - c):
                    parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return {i: (len(s), least[find(x)]) for x, (i, s) in enumerate(sets) if i is not None}


def run(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in B.near_duplicates(docs, **options).where("doc_id is not null").collect()}


def families(rng, groups, size, length, changed):
    """Groups of near copies, each of which changes a few words of its group's text, and texts that share a passage."""
    words = [f"w{i}" for i in range(3000)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, changed)):
                w[rng.randrange(length)] = rng.choice(words)
            rows.append(w + (passage if rng.random() < 0.3 else []))
    rows += [passage + [rng.choice(words) for _ in range(60)] for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("length, changed, options", [(40, 3, {}), (300, 14, {}), (300, 14, {"hot_log2": 0, "share": 3, "broadcast_rows": 0, "one_task": 10}), (90, 6, {"hubs": ()}), (200, 9, {"k": 32})])
def test_brute_force(spark, length, changed, options):
    rows = families(random.Random(length), 8, 25, length, changed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs, **options) == brute(rows)


def test_corpus(docs, corpus):
    assert run(docs) == brute([(r[0], r[1]) for r in corpus])


def test_other_sizes_and_similarities(spark):
    rows = families(random.Random(2), 5, 20, 120, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((1, 90), (2, 60), (6, 100)):
        assert run(docs, size=size, percent=percent) == brute(rows, percent, size)


def test_least_shared_is_a_tail_of_the_binomial():
    rng = random.Random(5)
    assert B.least_shared(128, 80, 1e-12) == 67 and B.least_shared(10, 100) == 10
    c = B.least_shared(64, 80, 0.01)
    low = sum(sum(rng.random() < 0.8 for _ in range(64)) < c for _ in range(4000)) / 4000
    assert low < 0.02 and c > 35


def test_union_sketch_estimates(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(1200)]
    pairs = [(2 * i + j, " ".join(words[i + j * shift : i + j * shift + 700])) for i, shift in enumerate((10, 60, 200, 400)) for j in (0, 1)]
    rng.shuffle(pairs)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    made = B.sketches(docs, B.profile(docs, "doc_id", "text", 4), "doc_id", "text", 4, 128, 1000)
    assert made.where(F.size("kept") > 128).count() == 0
    got = {r._id: set(r.kept) for r in made.collect()}
    for i, shift in enumerate((10, 60, 200, 400)):
        a, b = got[2 * i], got[2 * i + 1]
        least = sorted(a | b)[:128]
        j = (697 - shift) / (697 + shift)
        assert abs(len([x for x in least if x in a and x in b]) / 128 - j) < 0.2


def test_odd_inputs(spark, clashing, empty, corpus):
    assert B.near_duplicates(empty).count() == 0
    got = B.near_duplicates(clashing)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == clashing.count()
    want = brute([(r[0], r[1]) for r in corpus])
    rows = got.collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert all(r.component_id is None or r.component_id == 8 for r in rows if r.doc_id is None)


def test_lists_of_the_same_nodes_are_one(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = B.sketches(docs, B.profile(docs, "doc_id", "text", 4), "doc_id", "text", 4, 256, 1000)
    lists = [tuple(sorted(r.nodes)) for r in B.inverted(made, B.levels(made), 256, 80, 10).groupBy("token").agg(F.collect_list("node").alias("nodes")).collect()]
    assert len(lists) == 1 and len(lists[0]) == len(set(lists[0])) == 2


@pytest.mark.parametrize("small", [4, 48])
def test_close_pairs(spark, small):
    """All pairs across components within the bound of the parities; many of them as the likeliest of each node, once a pair."""
    rng = random.Random(6)
    posted, bits, comp = [], {}, {}
    for node in range(60):
        family = node // 20
        word = (random.Random(family).getrandbits(1024)) ^ sum(1 << b for b in rng.sample(range(1024), rng.randint(5, 9)))
        bits[node], comp[node] = word, node if node % 4 else 1000 + family
        fold = [((word >> (64 * i)) & (2**64 - 1)) - (2**64 if (word >> (64 * i + 63)) & 1 else 0) for i in range(16)]
        posted += [(token, node % 3 if token == 2 else 0, node, 100, 0, comp[node], tuple(fold)) for token in (1, 2, 3)]
    schema = "token long, salt int, node long, n int, pos int, comp long, fold struct<" + ", ".join(f"b{i}: long" for i in range(16)) + ">"
    posted = spark.createDataFrame(posted, schema)
    far = {(a, b): (bits[a] ^ bits[b]).bit_count() for a in range(60) for b in range(a + 1, 60) if comp[a] != comp[b]}
    want = {p for p, d in far.items() if 180 * d <= 20 * 200}
    assert 300 < len(want) < len(far)
    every = B.close_pairs(posted, 80, True, small=small).collect()
    assert {(r.a, r.b) for r in every} == want and len(every) == len(want)
    some = B.close_pairs(posted, 80, False, few=2, small=small).collect()
    pairs = {(r.a, r.b) for r in some if r.a is not None}
    assert {r.token for r in some if r.a is None} == {1, 2, 3} and pairs < want
    for node in (x for x in range(60) if comp[x] < 1000):  # the likeliest partner of each is among them
        least = min(d for p, d in far.items() if node in p)
        assert any(node in p and far[p] == least for p in pairs)
