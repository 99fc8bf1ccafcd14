import random
import time

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import kernels as K
from gridloom.llm import quality, toxicity


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    a, b = np.array(good)[:, None], np.array(bad)[None, :]
    return float(((a > b) + (a == b) / 2).mean())


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score_documents(docs, labels)
    rows = got.join(labels, "doc_id").select("held_out", "score", label).collect()
    held = [(r.score, r[label]) for r in rows if r.held_out]
    assert len(held) > 30 and auc(held) > 0.9
    assert got.count() == docs.count()


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(["good words here " * 3, "bad bad worthless thing", None, "", "!!", "x " * 5000] * 30)] + [(None, "a", 0.0), (0, "good words here", 0.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, i % 6 == 1) for i in range(180)] + [(None, True), (3, None)], "doc_id bigint, y boolean").selectExpr("doc_id", f"CAST(y AS INT) AS {label}")
    rows = module.score_documents(docs, labels).collect()
    assert len(rows) == 182 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = module.score_documents(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * 5 + "awful" * (i % 3 == 0)) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def brute_segments(s):
    """Maximal segments by their definition: split at the best segment, again left and right of it."""
    if not any(x > 0 for x in s):
        return []
    best = max(((sum(s[i:j]), i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return brute_segments(s[:i]) + [(i, j, sum(s[i:j]))] + [(a + j, b + j, x) for a, b, x in brute_segments(s[j:])]


def test_segments_against_definition():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.choice([-3.0, -1.5, -1.0, 1.0, 2.0, 2.5]) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        got, want = toxicity.segments(s), brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_word_vectors_and_pooling_against_plain_sums(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [" ".join(f"W{min(int(rnd.expovariate(0.15)), 40)}" for _ in range(rnd.choice([0, 1, 5, 60]))) for _ in range(50)] + [None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    words = quality.vocabulary(df, 10)
    split = [(t or "").lower().split() for t in docs]
    hashes = {w: int(K.spans_hash(t, quality._ABC.low, np.array([0]), np.array([len(w)]))[0]) for w in {x for s in split for x in s} for t in [K.texts_of(pa.array([w]))]}
    held = {w: sum(w in s for s in split) for w in hashes}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    best = sorted(held, key=lambda w: (-held[w], signed(hashes[w])))[:10]
    assert sorted(words.tolist()) == sorted(hashes[w] for w in best)
    row = {w: words.tolist().index(h) if w in best else 10 + (h >> 40) % quality.BUCKETS for w, h in hashes.items()}

    def index(w):
        v = np.zeros(quality.DIM)
        for shift in (0, 6, 12, 18):
            v[(hashes[w] >> shift) & 31] += 1 - 2 * ((hashes[w] >> (shift + 5)) & 1)
        return v

    want = np.zeros((10 + quality.BUCKETS, quality.DIM))
    for s in split:
        if len(s) > quality.REACH:
            for i, w in enumerate(s):
                for j in range(max(0, i - 2), min(len(s), i + 3)):
                    if j != i:
                        want[row[w]] += index(s[j])
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(length > 0, length, 1)
    vectors = quality.word_vectors(df, words)
    assert np.allclose(vectors, want, atol=1e-6)
    got = quality.pooled(K.texts_of(pa.array(docs)), words, vectors)
    for s, x in zip(split, got):
        mean = sum((want[row[w]] for w in s), np.zeros(quality.DIM)) / max(1, len(s))
        assert np.allclose(x[: quality.DIM], mean, atol=1e-6) and np.isclose(x[-1], np.log1p(len(s)))


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([(f"d{i}", "good words here" if i % 2 else "bad worthless thing", 1) for i in range(60)], "doc_id string, text string, n int")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(60)], "doc_id string, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.score_documents(docs, labels).collect()
        assert {r.doc_id for r in rows} == {f"d{i}" for i in range(60)}


def test_segments_take_linear_time():
    for unit in ([1.0, -2.0], [2.0, -1.0], [1.0, -1.0, 3.0, -5.0]):
        spent = []
        for n in (50_000, 400_000):
            began = time.process_time()
            toxicity.segments((unit * n)[:n])
            spent.append(time.process_time() - began)
        assert spent[1] < 16 * spent[0] + 0.5, (unit, spent)


def test_one_id_with_many_rows_is_sampled_once(spark):
    from gridloom.llm.sample import labelled_sample

    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "x") for i in range(100, 130)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, 0) for i in range(100, 130)]], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", 4, 2).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.label == (r.doc_id == 7) for r in got)
    assert len(labelled_sample(docs, labels, "toxic", 4, 2, rows=5).collect()) == 5


def test_word_beginnings():
    w, f = toxicity.features(K.texts_of(pa.array(["héllowörld héllo", "HÉLL", ""])))
    _, g = toxicity.features(K.texts_of(pa.array(["héllxyz"])))
    assert f[0, 0] == f[0, 1] == g[0, 0] and f[1, 0] != g[1, 0] and f[2, 0] != f[2, 1]
    assert np.array_equal(w.counts, [2, 1, 0])
