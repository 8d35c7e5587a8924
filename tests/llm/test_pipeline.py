"""The pipeline, stage by stage, against plain Python over a small corpus."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from fluxweave.llm.queries import mixing_model

from .conftest import prose
from .test_decontaminate import brute as contaminated
from .test_ngram_join import brute as linked


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(4), [], []
    items = [(k, prose(rng, 30)) for k in range(4)]
    for i in range(260):
        w = prose(rng, rng.randint(60, 120)).split(" ")
        if i % 8 == 0:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vilething", "rudeone"]))
        t = " ".join(w)
        if i % 20 == 7:
            t += " " + items[i % 4][1]
        if i % 20 == 11:
            t = rows[i - 1][1]
        rows.append((i, t, "de" if i % 5 == 0 else "en", f"src{i % 4}", len(t)))
        labels.append((i, 1, int("nastyword" in t or "vilething" in t or "rudeone" in t)))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, {i: t for i, _, t in labels}, items


def test_stages(spark, folder):
    d, rows, toxic, items = folder
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before, counts = docs.columns, sorted(text), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k == 4:
            break
        assert out.columns == columns
        out.write.parquet(f"{d}/stage{k}")
        counts = Counter(r.doc_id for r in spark.read.parquet(f"{d}/stage{k}").collect())
        if name == "toxicity":
            clean = {i for i in before if not toxic.get(i)}
            assert len(clean - set(counts)) <= 2
            assert len(set(counts) - clean) <= 2
        elif name == "ngram_jaccard_join":
            assert set(counts) == {c for _, _, c in linked([(i, text[i]) for i in before])}
        elif name == "benchmark_decontamination":
            assert set(counts) == {r[0] for r in contaminated([(i, text[i]) for i in before], items) if not r[5]}
        else:
            assert set(counts) == set(before)  # default rates drop nothing
            model = mixing_model(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert model.domains == ["de", "en"]
        if name != "source_mixing":
            assert set(counts.values()) == {1}
        before, docs = sorted(counts), spark.read.parquet(f"{d}/stage{k}")
    shards, ids = defaultdict(list), Counter()
    for r in out.collect():
        shards[r.shard].append(r.slot)
        ids[r.doc_id] += 1
    assert ids == counts
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_run_applies_all_stages(spark, folder):
    d, rows, toxic, _ = folder
    got = corpus_pipeline.run(spark, d)
    assert "shard" in got.columns
    assert 0 < got.select("doc_id").distinct().count() < len(rows)
