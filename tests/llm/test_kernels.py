import random
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import kernels as K
from gridloom.llm.components import components

PATTERNS = {"ascii": "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "space": "[^\x20\x09-\x0d]+"}


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_words_and_hashes():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB1é日 \n\t\x00\x0b.,-_~\x7f😀Z{") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", None, "x" * 3000]
    column = pa.array(["skipped", *texts])[1:]
    for kind, pattern in PATTERNS.items():
        abc, seen = K.alphabet(kind), {}
        t = K.texts_of(column)
        w = K.words(t, abc)
        h = K.spans_hash(t, abc.low, w.starts, w.ends)
        want = [re.findall(pattern, low(x or "")) for x in texts]
        assert w.counts.tolist() == [len(x) for x in want]
        for word, one in zip([x for ws in want for x in ws], h.tolist()):
            assert seen.setdefault(word, one) == one
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_chunk():
    batch = pa.record_batch({"text": pa.array([f"word{i} and {i * i} more Words {'long ' * (i % 50)}" for i in range(400)] + [None, ""])})
    abc = K.alphabet("space")

    def sets(limit):
        out = []
        for rows, t in K.chunks(batch, "text", limit):
            assert rows.num_rows == len(t)
            w = K.words(t, abc)
            d, o = K.distinct_by_text(*K.shingles(K.spans_hash(t, abc.low, w.starts, w.ends), w), len(t))
            out += [tuple(d[a:b]) for a, b in zip(o, o[1:])]
        return out

    assert sets(50) == sets(1 << 20) == sets(1)


def test_short_texts_have_one_shingle():
    t = K.texts_of(pa.array(["a b c d e", "a b c d", "A  B c D", "a", "b", "", "a b c d e f"]))
    w = K.words(t, K.alphabet("space"))
    h, of = K.shingles(K.spans_hash(t, K.alphabet("space").low, w.starts, w.ends), w)
    assert np.bincount(of, minlength=7).tolist() == [1, 1, 1, 1, 1, 0, 2]
    by = [set(h[of == i].tolist()) for i in range(7)]
    assert by[1] == by[2] and by[0] < by[6] and len({*by[0], *by[1], *by[3], *by[4]}) == 4


def test_components(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    loose = [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in chain + star + loose if a != b]
    rnd.shuffle(links)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_distinct_hashes_of_long_short_and_unsorted_texts():
    rnd = np.random.default_rng(3)
    where = np.concatenate([np.repeat([0, 2, 3], [K.LONG + 40, 5, K.LONG]), [1, 5, 1, 0], np.full(900, 6)])
    hashes = rnd.integers(0, 60, len(where)).astype(np.uint64) << np.uint64(58) | rnd.integers(0, 60, len(where)).astype(np.uint64)
    for order in (np.arange(len(where)), rnd.permutation(len(where))):
        h, o = K.distinct_by_text(hashes[order], where[order], 8)
        assert [h[a:b].tolist() for a, b in zip(o, o[1:])] == [sorted(set(hashes[where == i].tolist())) for i in range(8)]
