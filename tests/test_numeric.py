import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import numeric as N


def test_ieee(spark):
    xs = [4.0, 0.0, -1.0, None, math.nan, math.inf]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", N.ieee_log2(F.col("x")).alias("l"), N.ieee_ln(F.col("x")).alias("n"), N.nan_to_zero(F.col("x")).alias("z")).orderBy("i").collect()
    assert rows[0].l == 2.0 and rows[0].n == pytest.approx(math.log(4))
    assert rows[1].l == rows[1].n == -math.inf
    assert math.isnan(rows[2].l) and rows[3].l is None and math.isnan(rows[4].n) and rows[5].l == math.inf
    assert [r.z for r in rows] == [4.0, 0.0, -1.0, 0.0, 0.0, math.inf]


def test_division(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0), (1.0, None)]
    got = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double").orderBy("i").select(N.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [0.25, None, None]
