import random
import re

import pytest
from pyspark.sql import functions as F

from fluxweave.llm import ngram_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall((t or "").encode())]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, percent=75):
    """(id, set size, smallest id reachable) by comparing everything."""
    sets, up = [(i, shingles(t)) for i, t in rows], {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def run(df, **options):
    return sorted((tuple(r) for r in ngram_join.join(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_against_brute_force(docs, corpus):
    assert run(docs) == brute([r[:2] for r in corpus])


@pytest.mark.parametrize(("seed", "hubs"), [(1, (1,)), (2, (1, 4)), (3, (8,)), (4, ())])
def test_chains_of_near_copies(spark, seed, hubs):
    """Texts near the limit, in chains and stars whose ends are not alike, and a passage that all share."""
    rng = random.Random(seed)
    shared, rows = [f"p{k}" for k in range(30)], []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice([12, 40, 80]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(base + (shared if g % 2 else []))))
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = f"x{rng.random()}"
            if rng.random() < 0.3:
                base.insert(rng.randrange(len(base)), "more")
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert run(df, hubs=hubs) == brute(rows)


def test_exactly_at_the_limit(spark):
    """7 shingles against 9 with 7 in common is 7/9; 3 of 4 is exactly 75 %."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "q r s t u v w x"), (4, "q r s t u v z y")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert brute(rows)[1][2] == 1


def test_ngram_joins_at_other_thresholds(docs, corpus):
    assert run(docs, percent=90) == brute([r[:2] for r in corpus], 90)


def test_odd_inputs(spark, clashing, empty):
    assert run(empty) == []
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    got = dict((r[0], r[2]) for r in run(clashing) if r[0] is not None)
    want = dict((r[0], r[2]) for r in brute([r for r in rows if r[0] is not None]))
    assert got == want
    kept = ngram_join.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in want.items()})
    assert ids.count(None) == 1


def test_shuffle_path_agrees(docs, corpus):
    assert run(docs, broadcast_rows=-1) == brute([r[:2] for r in corpus])


@pytest.mark.parametrize("hubs", [(1, 2, 3), ()])
def test_dealt_tokens_and_distributed_rounds(spark, docs, corpus, hubs):
    """Tokens held a few times are dealt over salts, and links are joined without the one-task path."""
    assert run(docs, hubs=hubs, hot_log2=0, one_task=0) == brute([r[:2] for r in corpus])


def test_partners_of_one_class_of_sizes_and_the_next(spark):
    rng, rows = random.Random(6), []
    for g in range(5):
        base = [f"c{g}w{k}" for k in range(60)]
        for n in range(40, 60):
            rows.append((len(rows), " ".join(base[: n + rng.randint(0, 1)])))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_random_links(spark, one_task):
    rng = random.Random(one_task)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    up = {x: x for pair in links for x in pair}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in ngram_join.components(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(3))
    assert {r.comp for r in ngram_join.components(edges, 0).collect()} == {0}
    assert {r.comp for r in ngram_join.components(edges).collect()} == {0}


@pytest.mark.parametrize("block", [2000, 3])
def test_no_link_inside_a_component_is_lost(spark, clashing, monkeypatch, block):
    """Every row's number of links by comparing everything, in a large group of near copies too."""
    every = ngram_join.every_pair
    monkeypatch.setattr(ngram_join, "every_pair", lambda shared, percent: every(shared, percent, block))
    rng, base = random.Random(5), [f"w{k}" for k in range(60)]
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"y{rng.random()}"
        rows.append((1000 + i, " ".join(w)))
    sets = [(i, shingles(t)) for i, t in rows]
    want = sorted(((i, sum(1 for k, (j, t) in enumerate(sets) if k != at and i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t))) for at, (i, s) in enumerate(sets)), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_links) for r in ngram_join.join(df, count_links=True).collect()), key=repr)
    assert got == want
    assert run(df) == sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, count_links=True).collect()), key=repr)


def _posted(spark, rows):
    """Postings (token, salt, node, n, comp, parities) of one size class."""
    df = spark.createDataFrame(rows, "token long, salt int, node long, n int, comp long, b long")
    return df.selectExpr("token", "salt", "node", "n", "0 AS pos", "0 AS cls", "comp", "named_struct('b0', b, 'b1', 0L, 'b2', 0L, 'b3', 0L) AS fold")


def test_near_rows_of_a_token_are_linear_and_the_likeliest(spark):
    """Each row outside the largest component comes with one of another component; the rest of the pairs is only counted."""
    rows = [(7, 0, i, 40, i // 2, (1 << (i % 5)) - 1) for i in range(60)] + [(8, 0, 100, 40, 100, 0), (8, 0, 101, 90, 101, 0), (9, 0, 1, 40, 0, 0)]
    got, left = ngram_join.near_pairs(_posted(spark, rows), 75)
    got = sorted(map(tuple, got.collect()))
    of = {r[2]: (r[4], r[5]) for r in rows[:60]}
    assert left == 60 * 59 // 2 - 30
    assert 29 <= len(got) <= 58 and all(a < b for a, b in got)
    assert all(of[a][0] != of[b][0] and of[a][1] == of[b][1] for a, b in got)


def test_rest_pairs_meet_once_a_token(spark, monkeypatch):
    rows = [(7, i % 2, i, 40, i, 0) for i in range(60)]
    made, real = [], ngram_join._pairs
    monkeypatch.setattr(ngram_join, "_pairs", lambda met: made.append(met) or real(met))
    got = ngram_join.rest_pairs(_posted(spark, rows), 75)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert made[0].count() == 60 * 59 // 2
