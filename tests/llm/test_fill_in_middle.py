import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxweave.llm import fill_in_middle as M


def brute(doc_id, text):
    t = text or ""
    n = len(t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(9)
    letters = ["a", "<", ">", "P", "S", "M", "é", "数", "\U0001f600", "\n", " "]
    odd = ["<", "<P", "<P>", "x<<S>y", "<M", "<P<M>", "a<S >", "\U0001f600" * 70, "é" * 64, "<" * 200 + "S>", "数" * 5000]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    return [(r[0], r[1]) for r in corpus] + [(1000 + i, t) for i, t in enumerate(odd + made)] + [(None, "no id"), (None, None), (3, "other text, same id"), (3, "other text, same id")]


@pytest.mark.parametrize("chunk", [1 << 16, 100, 7])
def test_brute_force_at_any_chunk_length(spark, texts, chunk):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in M.transform(docs, chunk=chunk).collect()]
    assert len(got) == len(texts)
    for doc_id, text, result, restored in got:
        assert result == brute(doc_id, text)
        assert restored == (text or "")
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("units", ["words", "lines"])
def test_other_units(spark, texts, units):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for chunk in (1 << 16, 50):
        for r in M.transform(docs, units=units, chunk=chunk).collect():
            t = r.text or ""
            n = len(t.encode().split()) if units == "words" else len([x for x in t.split("\n")]) - (not t.split("\n")[-1])
            assert r.n == n and r.restored == t
            if r.form != "plain":
                middle = r.output.split("<M>", 1)[1]
                assert r.middle_chars >= 0 and middle in t


def test_functions_of_chunks_compose_to_the_function_of_the_whole():
    rng, a = np.random.default_rng(4), M.automaton()
    data = rng.choice(np.frombuffer("<PSM>aé\U0001f600".encode(), np.uint8), 999)

    def function(piece):
        _, off, state, units, marks = M._strips(a, [piece], 16)
        return [x[0] for x in M._entries(a, off, state, units, marks)[2:]]

    whole = function(data)
    to, units, marks = function(data[:0])
    assert to.tolist() == list(range(a.states)) and not units.any()  # the identity
    for piece in np.split(data, [1, 5, 17, 400, 401]):
        s, u, m = function(piece)
        to, units, marks = s[to], units + u[to], marks + m[to]
    assert [x.tolist() for x in (to, units, marks)] == [x.tolist() for x in whole]


def test_odd_inputs(spark, docs, clashing, empty):
    assert M.transform(empty).count() == 0
    out = M.transform(clashing.withColumns({"form": F.lit("x"), "n": F.lit(0)}), chunk=500)
    assert out.count() == clashing.count()
    assert out.where("restored <> coalesce(text, '')").count() == 0
    assert set(clashing.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)


def test_query(spark, docs, tmp_path):
    from fluxweave.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, form, a, b, out = brute(r.doc_id, text[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(text[r.doc_id] or ""))
