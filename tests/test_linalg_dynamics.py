import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import dynamics as D
from gridloom.operators import linalg as L
from gridloom.operators import relational as Q
from gridloom.sources import files as S

A = [[3.0, 1.0, 1.0], [-1.0, 3.0, 1.0]]


def rows(spark, m):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id bigint, x array<double>")


def test_svd_and_inverse(spark):
    s = [r.s for r in L.singular_values(rows(spark, A), 2).orderBy("place").collect()]
    assert s == pytest.approx([math.sqrt(12), math.sqrt(10)])
    p = np.array([r.p for r in L.pseudo_inverse(rows(spark, A), "corrected").orderBy("id").collect()]).T
    assert p == pytest.approx(np.linalg.pinv(np.array(A)))
    m = np.random.default_rng(1).normal(size=(40, 6))
    u, s, v = L.svd(rows(spark, m))
    back = np.array([r.u for r in u.orderBy("id").collect()]) * s @ v.T
    assert back == pytest.approx(m)
    got = L.rank_k(rows(spark, m), [1, 3, 6, 128]).orderBy("k", "id").collect()
    errors = [np.linalg.norm(np.array([np.subtract(r.y, r.x) for r in got if r.k == k])) for k in (1, 3, 6, 128)]
    assert errors == pytest.approx([*(np.sqrt((s[k:] ** 2).sum()) for k in (1, 3)), 0, 0], abs=1e-9)


@pytest.mark.parametrize("m", [np.arange(1.0, 10).reshape(3, 3), np.array(A), np.outer(np.arange(1, 9), [1, 2, 3]), np.zeros((4, 2)), np.diag([1, 1e-6, 1e-9]), np.ones((1, 5))])
def test_inverse_of_singular_and_wide_matrices(spark, m):
    x = rows(spark, m)
    p = np.array([r.p for r in L.pseudo_inverse(x, "corrected").orderBy("id").collect()]).T
    assert p == pytest.approx(np.linalg.pinv(m), rel=1e-6, abs=1e-9)
    s = [r.s for r in L.singular_values(x).orderBy("place").collect()]
    assert s == pytest.approx(np.linalg.svd(m, compute_uv=False), abs=1e-13)
    u, s, v = L.svd_full(x)
    assert u.shape[0] == u.shape[1] == len(m) and v.shape == (m.shape[1],) * 2
    assert (u[:, : len(s)] * s) @ v[:, : len(s)].T == pytest.approx(m, abs=1e-12)


def test_power_value_of_close_values_is_that_of_its_steps(spark):
    x = rows(spark, np.diag([1, 0.99]))
    v = np.array([1, 0.99 ** (2 * 100)])
    assert [tuple(r) for r in L.power_value(x).collect()] == [(0, pytest.approx(math.sqrt((v**2 @ [1, 0.99**2]) / (v @ v))))]
    assert L.power_value(rows(spark, np.diag([3, 1]))).first().s == pytest.approx(3) and L.power_value(rows(spark, np.zeros((2, 2)))).first().s == 0
    assert L.power_value(x.limit(0)).count() == 0


def test_compat_inverse_divides_by_everything(spark):
    p = np.array([r.p for r in L.pseudo_inverse(rows(spark, np.arange(1.0, 10).reshape(3, 3))).collect()])
    assert np.abs(p).max() > 1e6 or np.isnan(p).any()
    assert L.pseudo_inverse(rows(spark, A).limit(0)).count() == 0


def test_reduction_tree_of_many_tasks(spark):
    m = np.random.default_rng(3).normal(size=(300, 5))
    x = rows(spark, m).repartition(70)
    assert L.gram_matrix(x) == pytest.approx(m.T @ m)
    assert [r.s for r in L.singular_values(x).orderBy("place").collect()] == pytest.approx(np.linalg.svd(m, compute_uv=False))


def test_dense_and_zeros(spark):
    e = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0)], "i long, j int, v double")
    assert [r.x for r in L.dense(e, 4, 2).orderBy("id").collect()] == [[0, 2.5], [0, 0], [1, 0], [0, 0]]
    assert [r.x for r in S.zeros(spark, 2, 3).collect()] == [[0, 0, 0]] * 2


def test_document_ranking_and_clusters(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, ""), (4, None), (5, "c C a.")], "doc_id long, text string")
    m = np.array([[2, 1, 0], [0, 1, 1], [1, 0, 2.0]])
    w = np.linalg.matrix_power(m @ m.T, 5) @ np.ones(3)
    got = {r.doc_id: r.rank for r in L.document_ranking(docs).collect()}
    assert [got[i] for i in (1, 2, 5)] == pytest.approx(w / np.linalg.norm(w)) and got[3] == got[4] == 0 and len(got) == 5
    points = spark.createDataFrame([(i, [float(i % 3) * 50 + i / 100, float(i % 2) / 10]) for i in range(90)], "id long, y array<double>")
    groups = {}
    for r in L.clusters(points, 3).collect():
        groups.setdefault(r.cluster, set()).add(r.id % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]


def test_pca_and_least_squares(spark):
    m = np.random.default_rng(2).normal(size=(50, 4)) @ np.diag([4, 2, 1, 0.5])
    _, var = L.pca(rows(spark, m), 4)
    assert var == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1])
    df = spark.range(30).select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") * 2.0 + 5).alias("y"))
    assert [r.b for r in L.least_squares(df).orderBy("place").collect()] == pytest.approx([5, 2])
    with pytest.raises(ValueError, match="one length"):
        L.gram_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, x array<double>"))


def test_lyapunov_known_values(spark):
    df = spark.createDataFrame([(2.5,), (3.2,), (4.0,)], "r double")
    got = [tuple(r) for r in df.select(D.lyapunov_direct(F.col("r"), 0.5, 2000), D.lyapunov_derivative(F.col("r"), 0.5, 2000), D.lyapunov_direct(F.col("r"), 0.5, 2000, base2=True)).collect()]
    for (direct, derivative, bits), want in zip(got, (-math.log(2), 0.5 * math.log(0.16), math.log(4))):
        assert direct == pytest.approx(want, abs=1e-4) and derivative == pytest.approx(want, abs=1e-6) and bits == pytest.approx(want / math.log(2), abs=1e-4)
    tail = df.select(D.tail(F.col("r"), 0.5, 1000).alias("t")).collect()
    assert all(len(r.t) == 300 for r in tail) and tail[0].t[-1] == pytest.approx(0.6)


def test_spectrum(spark):
    (row,) = D.spectrum_qr(spark.createDataFrame([(1, 1.4, 0.3)], "id bigint, a double, b double"), 3000).withColumn("d", D.fractal_dimension(F.col("spectrum"))).collect()
    assert row.spectrum[0] == pytest.approx(0.42, abs=0.03) and sum(row.spectrum) == pytest.approx(math.log(0.3), abs=1e-6)
    assert row.d == pytest.approx(1.26, abs=0.03)


def test_spectra_of_other_systems(spark):
    one = spark.createDataFrame([(1, 1.4, 0.3)], "id bigint, a double, b double")
    nats, bits = (D.spectrum_qr(one, 500, base2=b).first().spectrum for b in (False, True))
    assert bits == pytest.approx([v / math.log(2) for v in nats])
    flow = spark.createDataFrame([(1, 10.0, 28.0, 8 / 3)], "id bigint, sigma double, rho double, beta double")
    got = D.spectrum_qr(flow, 20000, 2000, D.lorenz, (1.0, 1.0, 20.0), time=0.01).first().spectrum
    assert got[0] == pytest.approx(0.9, abs=0.05) and got[1] == pytest.approx(0, abs=0.03) and sum(got) == pytest.approx(-(10 + 1 + 8 / 3), abs=1e-2)


def test_exponents_from_series(spark):
    """Both methods on the logistic map at r = 4 (ln 2) and at a stable cycle; Rosenstein's against a plain version."""
    df = spark.createDataFrame([(1, 4.0), (2, 3.5)], "id bigint, r double").select("id", D.tail(F.col("r"), 0.3, 2000, last=1500).alias("xs"))
    wolf, rosenstein = ({r.id: r.le for r in f(df).collect()} for f in (D.largest_wolf, D.largest_rosenstein))
    assert wolf[1] == pytest.approx(math.log(2), abs=0.12) and rosenstein[1] == pytest.approx(math.log(2), abs=0.12)
    xs = df.filter("id = 1").first().xs
    e = [(a, b) for a, b in zip(xs, xs[1:])]
    m, gap, curve = len(e) - 10, 10, []
    near = [min((j for j in range(m) if abs(i - j) > gap), key=lambda j: (math.dist(e[i], e[j]), j)) for i in range(0, m, 1)][:m]
    for k in range(5):
        d = [math.dist(e[i + k], e[j + k]) for i, j in enumerate(near)]
        d = [math.log(x) for x in d if x > 0]
        curve.append(sum(d) / len(d))
    assert rosenstein[1] == pytest.approx(np.polyfit(range(5), curve, 1)[0], abs=1e-6)


def test_lookup_and_sorted_outer_join(spark):
    known = spark.createDataFrame([("x", 1.0, 2.0), ("y", None, 2.0)], "address string, lon double, lat double")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id int, a string")
    assert [(r.id, r.coords and tuple(r.coords)) for r in Q.geocode(asked, "a", known).orderBy("id").collect()] == [(1, (1, 2)), (2, None), (3, None), (4, None)]
    a = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), (None, 4)], "k string, v int")
    got = [(r.k, r.v_x, r.v_y) for r in Q.outer_sorted(a, a, "k").collect()]
    assert got[:2] == [("a", 3, 3), ("b", 1, 1)] and sorted(got[2:], key=str) == [(None, x, y) for x in (2, 4) for y in (2, 4)]


def test_filters_and_joins(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,), ("A",)], "k string")
    assert [r.k for r in Q.keep_equal(df, "k", "A").collect()] == ["A", None, "A"]
    assert [r.k for r in Q.keep_equal(df, "k", "A", "corrected").collect()] == ["A", "A"]
    a = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "k string, v int")
    b = spark.createDataFrame([("a", 5), (None, 6), ("z", 7)], "k string, v int")
    got = {(r.k, r.v_x, r.v_y) for r in Q.full_outer(a, b, "k").collect()}
    assert got == {("a", 2, 5), ("b", 1, None), ("c", 4, None), ("z", None, 7), (None, 3, 6)}
