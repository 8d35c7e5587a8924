import random

import pytest

VOCAB = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s", "nd", "st")]


def prose(rng, n):
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        out += [" ".join(rng.choice(VOCAB) for _ in range(k)).capitalize() + "."]
    words = " ".join(out).split()[:n]
    lines, at = [], 0
    while at < len(words):
        k = rng.randint(6, 20)
        lines.append(" ".join(words[at : at + k]))
        at += k
    return "\n".join(lines)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, nulls, empty, one-word and very long texts."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append([i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de"]), f"src{i % 3}", 0])
    for i in range(60, 75):  # exact copies of row 5, in other sources
        rows.append([i, rows[5][1], "en", f"src{i % 3}", 0])
    for i in range(75, 90):  # near copies of row 7: one word changed
        w = rows[7][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), "en", "src0", 0])
    rows += [[90, None, "en", "src0", 0], [91, "", None, None, 0], [92, "one", "en", "src1", 0], [93, "One", "en", "src1", 0], [94, " \t\n ", "de", "src1", 0], [95, prose(rng, 20_000), "en", "src2", 0]]
    rows += [[96, "Ünïcode ẞtraße 数据 \U0001f600 x", "de", "src1", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with repeated rows, a null id and columns named like results and internals."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("n_words", "score", "kept", "shard", "slot", "size", "component_id", "copies", "rate", "spans", "base", "found", "host", "_uid", "_cut", "_text", "_id", "contaminated")}
    twice = docs.unionByName(docs.where("doc_id in (3, 5, 90)"))
    return twice.unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))).withColumns(extra)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")
