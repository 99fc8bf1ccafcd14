import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import graph as R
from gridloom.sources import files as S


def poly(*rings):
    return ("Polygon", 0, [[[(float(x), float(y)) for x, y in (*r, r[0])] for r in rings]])


BOX = poly([(0, 0), (4, 0), (4, 3), (0, 3)])
HOLED = poly([(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)])


def test_area_and_box(spark):
    df = spark.createDataFrame([(BOX,), (HOLED,)], f"g {G.GEOM}")
    assert [r[0] for r in df.select(G.area(F.col("g"))).collect()] == [12.0, 64.0]
    b = df.select(G.bbox(F.col("g")).alias("b")).first().b
    assert (b.xmin, b.ymin, b.xmax, b.ymax) == (0, 0, 4, 3)


@pytest.mark.parametrize(
    ("a", "b", "apart"),
    [
        (BOX, poly([(4, 3), (5, 3), (5, 4)]), False),  # a corner
        (BOX, poly([(4, 1), (6, 1), (6, 2), (4, 2)]), False),  # part of a side
        (BOX, poly([(1, 1), (2, 1), (2, 2)]), False),  # inside
        (BOX, poly([(5, 0), (6, 0), (6, 1)]), True),
        (HOLED, poly([(3, 3), (7, 3), (7, 7), (3, 7)]), True),  # in the hole
        (HOLED, poly([(2, 3), (7, 3), (7, 7), (3, 7)]), False),  # touches the hole's side
        (poly([(0, 0), (9, 9), (0, 9)]), poly([(5, 0), (9, 0), (9, 4)]), True),  # boxes meet, shapes don't
        (BOX, None, False),
    ],
)
def test_disjoint(spark, a, b, apart):
    row = spark.createDataFrame([(a, b)], f"a {G.GEOM}, b {G.GEOM}").select(G.disjoint(F.col("a"), F.col("b")), G.disjoint(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (apart, apart)


def test_crs(spark):
    df = spark.createDataFrame([(("Point", 4326, [[[(-8.0, 53.5)]]]),)], f"g {G.GEOM}")
    p = df.select(G.to_crs(F.col("g")).alias("g")).first().g.parts[0][0][0]
    # the grid's origin lies at 200000, 250000; the datum shift moves it by tens of metres
    assert abs(p.x - 200000) < 150 and abs(p.y - 250000) < 150
    # the Spire in Dublin, in both systems
    spire = spark.createDataFrame([(("Point", 4326, [[[(-6.260310, 53.349805)]]]),)], f"g {G.GEOM}")
    p = spire.select(G.to_crs(F.col("g")).alias("g")).first().g.parts[0][0][0]
    assert abs(p.x - 315904) < 12 and abs(p.y - 234671) < 12
    with pytest.raises(Exception, match="already has srid"):
        df.select(G.set_crs(F.col("g"), 29902)).collect()


def grid(spark, n=5, lost=False):
    x, y = (F.col("id") % n).cast("double"), F.floor(F.col("id") / n).cast("double")
    df = spark.range(n * n).select(F.col("id").alias("unit_id"), G.box(x, y, x + 1, y + 1).alias("geom"), (F.col("id") + 1).cast("double").alias("value"))
    return df.withColumn("geom", F.when(F.col("unit_id") != 3, F.col("geom"))) if lost else df


def test_neighbours(spark):
    g = grid(spark)
    for cell in (0.7, 1.0, 3.0):
        pairs = R.neighbours(g, cell, "corrected").collect()
        assert len(pairs) == len(set(pairs)) == 144
    assert R.neighbours(g).count() == 169
    d = [r.degree for r in R.degrees(g, R.neighbours(g, mode="corrected")).collect()]
    assert sorted(d) == [3] * 4 + [5] * 12 + [8] * 9
    lost = R.neighbours(grid(spark, lost=True)).filter("src = 3 OR dst = 3").collect()
    assert len(lost) == len(set(lost)) == 24 * 2 + 1


def test_neighbours_of_odd_shapes(spark):
    """A hole, two parts, a triangle and a missing geometry; against all pairs."""
    two = ("MultiPolygon", 0, [poly([(20, 0), (21, 0), (21, 1)])[2][0], poly([(10, 4), (12, 4), (12, 6), (10, 6)])[2][0]])
    shapes = [HOLED, poly([(3, 3), (7, 3), (7, 7), (3, 7)]), poly([(2, 4), (3, 4), (3, 5)]), two, poly([(21, 1), (22, 1), (22, 2)]), None, poly([(50, 50), (51, 50), (50, 51)])]
    df = spark.createDataFrame(list(enumerate(shapes)), f"unit_id bigint, geom {G.GEOM}")
    x, y = (df.select(F.col("unit_id").alias(n), F.col("geom").alias("g" + n)) for n in "ab")
    want = {tuple(r) for r in x.crossJoin(y).filter(~G.disjoint(F.col("ga"), F.col("gb"))).select("a", "b").collect()}
    assert {(0, 2), (1, 2), (0, 3), (3, 4), (5, 6), (5, 5)} <= want and not {(0, 1), (2, 3)} & want
    for cell in (None, 0.9, 100.0):
        got = [tuple(r) for r in R.neighbours(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_neighbours_of_many_units_in_metres(spark):
    n = 316
    x, y = F.col("id") % n * 1000.0, F.floor(F.col("id") / n) * 1000.0
    df = spark.range(n * n).select(F.col("id").alias("unit_id"), G.box(x, y, x + 1000, y + 1000).alias("geom"))
    assert R.neighbours(df, mode="corrected").count() == 2 * (2 * n * (n - 1) + 2 * (n - 1) ** 2)


def test_frames_on_disk_and_kinds(spark, tmp_path):
    frames = spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.25)], "frame_k int, unit_id bigint, value double")
    S.write_frames(frames, str(tmp_path / "f"))
    one = S.read_frame(spark, str(tmp_path / "f"), "unit_id bigint, value double", 2)
    assert [tuple(r) for r in one.collect()] == [(5, 0.25, 2)] and len(one.inputFiles()) >= 1
    (tmp_path / "g.json").write_text('{"type":"Feature","properties":{"a":1},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}\n')
    with pytest.raises(Exception, match="not supported"):
        S.read_geojson(spark, str(tmp_path / "g.json"), "struct<a:int>", lines=True).collect()
    shapes = spark.createDataFrame([(1, HOLED), (2, ("Point", 0, [[[(3.0, 4.0)]]])), (3, None)], f"a int, geom {G.GEOM}")
    S.write_geojson(shapes, str(tmp_path / "h"), ["a"])
    back = {r.a: r.geom for r in S.read_geojson(spark, str(tmp_path / "h"), "struct<a:int>", lines=True).collect()}
    assert back[1].parts == shapes.first().geom.parts and back[2].kind == "Point" and back[3] is None


def test_runge_kutta_against_euler(spark):
    """Many small Euler steps come near one step of fourth order; a constant state stays."""
    g = grid(spark, 3).select("unit_id", "value")
    lap = R.laplacian(grid(spark, 3), R.neighbours(grid(spark, 3), mode="corrected"))
    import numpy as np

    m = np.zeros((9, 9))
    for r in lap.collect():
        m[r.i, r.j] = r.v
    got = [r.value for r in R.runge_kutta_step(lap, g).orderBy("unit_id").collect()]
    p = np.arange(1.0, 10)
    for _ in range(2000):
        p = p - 0.0625 / 2000 * (m @ p)
    assert got == pytest.approx(p, abs=1e-3)


def test_diffusion(spark):
    g = grid(spark)
    compat, corrected = ({(r.step, r.unit_id): r.value for r in R.solve(g, R.neighbours(g, mode=m), max_t=10, mode=m).collect()} for m in ("compat", "corrected"))
    last = {u: v for (s, u), v in compat.items() if s == 9}
    assert sum(last.values()) == pytest.approx(170.44965439083626)
    assert (last[0], last[12], last[24]) == pytest.approx((3.5513399783640125, 6.81798617563345, 10.084632372902888))
    assert max(s for s, _ in compat) == 9 and max(s for s, _ in corrected) == 10
    assert sum(v for (s, _), v in corrected.items() if s == 10) == pytest.approx(325)
    assert corrected[10, 24] == pytest.approx(19.497869767405064)
    with pytest.raises(ValueError, match="no steps"):
        R.solve(g, R.neighbours(g), max_t=0)


def test_diffusion_by_joins(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    g = grid(spark, 3)
    pairs = R.neighbours(g)
    a = {(r.step, r.unit_id): round(r.value, 9) for r in R.solve(g, pairs, max_t=4).collect()}
    b = {(r.step, r.unit_id): round(r.value, 9) for r in R.solve(g, pairs, max_t=4, array_units=2).collect()}
    assert a == b and len(a) == 4 * 9
