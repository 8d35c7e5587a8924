import hashlib
import re

from fluxweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window=13):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            b = words(x)
            n = min(window, len(b))
            for k in range(len(b) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items_of(corpus):
    long = corpus[2][1].split()
    return [(1, " ".join(long[10:40])), (2, "Short, item!"), (11, " ".join(corpus[95][1].split()[500:520]).upper()), (3, None), (4, "..."), (12, " ".join(long[15:28])), (5, "数据")]


def run(df, bench, **options):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in decontaminate.scan(df, bench, **options).select(*cols).collect()), key=repr)


def test_against_brute_force(spark, docs, corpus):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [r[:2] for r in corpus] + [(200, "a short item here and short item"), (201, "short item " + "x " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, items)
    assert run(df, bench) == want
    assert run(df, bench, block_bytes=40) == want  # several blocks
    assert sum(r[5] for r in want) >= 3


def test_removal(spark, corpus):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x\nShort item, y z"), (2, "clean text"), (3, None), (4, "short item")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in decontaminate.remove(df, bench).collect()] == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.remove(df, bench, mode="spans").collect()}
    assert cut == {1: "x\n, y z", 2: "clean text", 3: None, 4: ""}


def test_odd_inputs(spark, clashing, docs, empty):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    none = bench.where("item_id < 0")
    assert run(empty, bench) == []
    assert run(docs, none) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [])
    assert len(run(clashing, bench)) == clashing.count()
    assert decontaminate.remove(clashing, bench).columns == clashing.columns
    assert decontaminate.remove(clashing, none).count() == clashing.count()
