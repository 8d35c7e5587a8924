import re
from collections import defaultdict

from fluxweave.llm import quality

WORD, SEP = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"


def brute(rows, min_docs=5, min_share=0.01, max_loss=0.5):
    held, hosts = defaultdict(set), defaultdict(set)
    lines = lambda t: [x for x in t.split("\n") if x.strip(SEP)]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(SEP)).lower()
    for _, text, _, host, _ in rows:
        t = text or ""
        hosts[host].add(t)
        for x in lines(t):
            held[host, norm(x)].add(t)
    out = []
    for i, text, _, host, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        wins = defaultdict(list)
        for k in range(len(w) - 2):
            wins[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for at in wins.values() if len(at) > 1 for k in at for j in range(3)}
        own = lines(t)
        cut = [x for x in own if len(held[host, norm(x)]) >= min_docs and len(held[host, norm(x)]) >= min_share * len(hosts[host])]
        chars, lost = sum(map(len, w)), sum(len("".join(WORD.findall(x))) for x in cut)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append((i, len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(repeated), failed, not failed and lost <= max_loss * chars, lost))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]


def test_against_brute_force(spark, docs, corpus):
    got = sorted((tuple(r) for r in quality.line_frequency(docs).select(*COLUMNS).collect()), key=repr)
    assert got == brute(corpus)


def test_repeats_lines_and_depletion(spark):
    shared, own = "shared line of the host with many words in it", "own words that are only here number"
    rows = [(i, "\n".join([shared] * 8 + [f"{own} {i} {k}" for k in range(2)]), "en", "h", 0) for i in range(8)]
    rows += [(8, " ".join(f"w{k}" for k in range(60)), "en", "h", 0), (9, "a b c " * 30, "en", "h", 0), (10, "x\n" * 3 + "$$ # <b>", "en", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for min_docs in (5, 9):
        got = sorted((tuple(r) for r in quality.line_frequency(df, min_docs=min_docs).select(*COLUMNS).collect()), key=repr)
        assert got == brute(rows, min_docs=min_docs)
    clean = {r.doc_id: r.clean_text for r in quality.line_frequency(df).collect()}
    assert clean[0] == f"{own} 0 0\n{own} 0 1"
    assert clean[8] == rows[8][1]


def test_shuffle_path_agrees_with_broadcast(docs):
    a = quality.line_frequency(docs, min_docs=2).select(*COLUMNS).collect()
    b = quality.line_frequency(docs, min_docs=2, broadcast_rows=-1).select(*COLUMNS).collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_odd_inputs(clashing, empty):
    assert quality.line_frequency(empty).count() == 0
    got = quality.line_frequency(clashing)
    assert got.count() == clashing.count()
    assert {r.kept for r in got.where("text is null").collect()} == {False}


def test_many_documents_are_enough_at_any_share(spark):
    """A line of a small share of its host goes once it stands in many_docs documents."""
    rows = [(i, f"own line number {i} of this text\n" + ("a line that some share\n" if i < 12 else "") + "x " * 60, "one") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = lambda **o: quality.line_frequency(docs, min_share=0.9, **o).where("lost_chars > 0 and doc_id < 12 and clean_text not like '%some share%'").count()
    assert (lost(many_docs=13), lost(many_docs=12)) == (0, 12)
