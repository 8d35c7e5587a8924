import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxweave.llm import textkernel as K

SPACE, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t.éß\U0001f6001", max_size=40)), max_size=12), st.sampled_from([1, 16, 1 << 20]))
def test_words_and_hashes(texts, chunk):
    for seps, pattern in ((K.SPACE, SPACE), (K.NOT_ALNUM, ALNUM)):
        got, hashes = [], {}
        for w in K.words(pa.array(texts, pa.string()), seps, chunk):
            h = w.hash()
            for r in range(w.row1 - w.row0):
                own = [w.word(i) for i in range(w.off[r], w.off[r + 1])]
                got.append(own)
                for x, v in zip(own, h[w.off[r] : w.off[r + 1]], strict=True):
                    assert hashes.setdefault(x, v) == v
        assert got == [pattern.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_slices_of_a_column():
    column = pa.array(["x", "a b", None, "c"]).slice(1, 3)
    (w,) = K.words(column, K.SPACE)
    assert [w.word(i) for i in range(3)] == [b"a", b"b", b"c"]
    assert w.off.tolist() == [0, 2, 2, 3]


def test_ngrams_depend_on_order_and_length():
    h = K.mix(np.arange(6, dtype=np.uint64))
    assert len(set(K.ngrams(h, 3)) | set(K.ngrams(h[::-1], 3)) | set(K.ngrams(h, 2))) == 4 + 4 + 5
