"""Neighbour graphs of spatial units and diffusion over them.

``compat`` counts each unit among its own neighbours for the degree, as the tables this mimics do, so the operator is
D + I - A and totals shrink; ``corrected`` uses D - A.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import ieee_ln
from ..session import kept, scratch

#: Up to so many units and pairs the whole state is one row of arrays; beyond, a join each step.
ARRAY_UNITS, ARRAY_PAIRS = 4_096, 100_000


def _survey(boxed: DataFrame) -> tuple[float, int]:
    """The median of the boxes' longer sides (1 if there is none), so that a box lies in few cells and a cell in few boxes;
    and how many units have no geometry."""
    side = F.greatest(F.expr("shape.box.xmax - shape.box.xmin"), F.expr("shape.box.ymax - shape.box.ymin"))
    got = boxed.agg(F.percentile_approx(side, 0.5, 1000).alias("side"), F.count_if(F.col("shape").isNull()).alias("lost")).first()
    return got["side"] or 1.0, got["lost"]


def neighbours(units: DataFrame, cell: float | None = None, mode: str = "compat") -> DataFrame:
    """``src, dst`` of units that share a point (``compat``: also each with itself).

    Units are listed in the grid cells their boxes cover (of side ``cell``, in the units of the coordinates; by default the median
    of the boxes' longer sides); only units of a cell are compared, and a pair is kept in the cell of the lower left corner of the boxes'
    overlap, so no pair comes twice and no distinct is needed. In compat mode a missing geometry neighbours every unit, so
    the result then has units x missing rows. The pairs are computed once and kept.
    """
    boxed = kept(units.select("unit_id", F.when(F.col("geom").isNotNull(), G.shape(F.col("geom"))).alias("shape")))
    median, n_lost = _survey(boxed)
    cell = cell or median
    known = boxed.filter("shape IS NOT NULL")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = known.withColumn("cx", F.explode(span("shape.box.xmin", "shape.box.xmax"))).withColumn("cy", F.explode(span("shape.box.ymin", "shape.box.ymax")))
    a, b = cells.alias("a"), cells.alias("b")
    at = lambda c, lo: F.floor(F.greatest(F.col(f"a.shape.box.{lo}"), F.col(f"b.shape.box.{lo}")) / cell) == F.col(f"a.{c}")
    near = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.unit_id") < F.col("b.unit_id")) & at("cx", "xmin") & at("cy", "ymin")
    pairs = a.join(b, near).filter(~G.apart(F.col("a.shape"), F.col("b.shape")))
    one = F.array(F.struct(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst")), F.struct(F.col("b.unit_id").alias("src"), F.col("a.unit_id").alias("dst")))
    both = pairs.select(F.inline(one))
    if mode == "compat":
        both = both.unionByName(boxed.select(F.col("unit_id").alias("src"), F.col("unit_id").alias("dst")))
        if n_lost:
            lost = boxed.filter("shape IS NULL").select(F.col("unit_id").alias("lost"))
            others = boxed.select(F.col("unit_id").alias("other"), F.col("shape").isNull().alias("also"))
            met = lost.join(others, F.col("lost") != F.col("other"))
            there = met.select(F.col("lost").alias("src"), F.col("other").alias("dst"))
            back = met.filter("NOT also").select(F.col("other").alias("src"), F.col("lost").alias("dst"))
            both = both.unionByName(there).unionByName(back)
    return kept(both)


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def degrees(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """``unit_id, degree``; units without neighbours have 0."""
    counted = pairs.groupBy(F.col("src").alias("unit_id")).agg(F.count(F.lit(1)).alias("_d"))
    return units.select("unit_id").join(counted, "unit_id", "left").select("unit_id", F.coalesce("_d", F.lit(0)).alias("degree"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """``src, dst, v`` with a zero diagonal."""
    return pairs.filter("src <> dst").withColumn("v", F.lit(1.0))


def laplacian(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """``i, j, v``: degrees minus adjacency."""
    diagonal = degrees(units, pairs).select(F.col("unit_id").alias("i"), F.col("unit_id").alias("j"), F.col("degree").cast("double").alias("v"))
    return diagonal.unionByName(adjacency(pairs).select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("v")).alias("v")))


def matvec(matrix: DataFrame, vector: DataFrame, id_col: str = "unit_id", value: str = "value") -> DataFrame:
    """``unit_id, value`` of a sparse matrix (i, j, v) times a vector; products are summed before the second shuffle."""
    v = vector.select(F.col(id_col).alias("j"), F.col(value).alias("_x"))
    return matrix.join(v, "j").groupBy(F.col("i").alias(id_col)).agg(F.sum(F.col("v") * F.col("_x")).alias(value))


def euler_step(matrix: DataFrame, state: DataFrame, dt: float = 1.0, alpha: float = 0.25) -> DataFrame:
    """One explicit step: p - alpha^2 dt L p."""
    moved = matvec(matrix, state).withColumnRenamed("value", "_l")
    return state.join(moved, "unit_id", "left").select("unit_id", (F.col("value") - F.lit(alpha**2 * dt) * F.coalesce("_l", F.lit(0.0))).alias("value"))


def runge_kutta_step(matrix: DataFrame, state: DataFrame, dt: float = 1.0, alpha: float = 0.25) -> DataFrame:
    """One classical fourth-order step of p' = -alpha^2 L p. For a linear equation its four slopes are powers of the operator:
    p + h k + h^2 k^2 / 2 + h^3 k^3 / 6 + h^4 k^4 / 24 with k = -alpha^2 L."""
    power, terms = state.select("unit_id", "value"), [state.select("unit_id", "value")]
    for i in range(1, 5):
        power = matvec(matrix, power).select("unit_id", (F.col("value") * F.lit(-(alpha**2) * dt / i)).alias("value"))
        terms.append(power)
    total = terms[0]
    for t in terms[1:]:
        total = total.unionByName(t)
    return total.groupBy("unit_id").agg(F.sum("value").alias("value"))


def steps_of(t0: float, dt: float, max_t: float) -> int:
    n = max(0, math.ceil((max_t - t0) / dt))
    if n == 0:
        raise ValueError("no steps between t0 and max_t")
    return n


def solve(units: DataFrame, pairs: DataFrame, t0: float = 0.0, dt: float = 1.0, max_t: float = 144.0, alpha: float = 0.25, mode: str = "compat", array_units: int = ARRAY_UNITS) -> DataFrame:
    """``step, unit_id, value`` of every recorded step. ``compat``: the last row holds the state after the last step, so the
    state before it is missing; ``corrected``: rows 0..n, the final state included."""
    n = steps_of(t0, dt, max_t)
    if units.limit(array_units + 1).count() <= array_units and pairs.limit(ARRAY_PAIRS + 1).count() <= ARRAY_PAIRS:
        return _solve_arrays(units, pairs, n, alpha**2 * dt, mode)
    return _solve_joins(units, pairs, n, dt, alpha, mode)


def _recorded(n: int, mode: str) -> list[int]:
    return [*range(n - 1), n] if mode == "compat" else list(range(n + 1))


def _solve_arrays(units: DataFrame, pairs: DataFrame, n: int, rate: float, mode: str) -> DataFrame:
    """The state as one array, folded over the steps: no shuffle and no job for a step."""
    place = units.select("unit_id", (F.row_number().over(Window.orderBy("unit_id")) - 1).alias("at"))  # few units, one task
    of = lambda c: place.select(F.col("unit_id").alias(c), F.col("at").alias(f"at_{c}"))
    placed = pairs.join(of("src"), "src").join(of("dst"), "dst")
    lists = placed.groupBy(F.col("src").alias("unit_id")).agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list(F.when(F.col("src") != F.col("dst"), F.col("at_dst")))).alias("near"))
    rows = units.select("unit_id", F.col("value").cast("double").alias("value")).join(lists, "unit_id", "left")
    of_unit = F.struct("unit_id", "value", F.coalesce("degree", F.lit(0)).cast("double").alias("degree"), F.coalesce("near", F.array().cast("array<int>")).alias("near"))
    one = rows.agg(F.sort_array(F.collect_list(of_unit)).alias("u"))
    one = one.select(*[F.col(f"u.{c}").alias(n) for n, c in (("ids", "unit_id"), ("p0", "value"), ("deg", "degree"), ("near", "near"))])

    def step(p: F.Column) -> F.Column:
        return F.transform(p, lambda v, i: v - F.lit(rate) * (F.col("deg")[i] * v - F.aggregate(F.col("near")[i], F.lit(0.0), lambda a, j: a + p[j])))

    kind = "struct<p:array<double>,all:array<array<double>>>"
    start = F.struct(F.col("p0").alias("p"), F.array(F.col("p0")).alias("all")).cast(kind)

    def fold(acc: F.Column, _: F.Column) -> F.Column:
        return F.transform(F.array(step(acc["p"])), lambda q: F.struct(q.alias("p"), F.concat(acc["all"], F.array(q)).alias("all")))[0].cast(kind)

    # the fold runs once, before rows are made of it
    states = one.select("ids", F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, fold, lambda acc: acc["all"]).alias("all"))
    keep = F.array(*[F.lit(s) for s in _recorded(n, mode)])
    shown = states.select("ids", F.explode(F.transform(keep, lambda s, i: F.struct(i.alias("step"), F.col("all")[s].alias("p")))).alias("r"))
    return shown.select(F.col("r.step").alias("step"), F.explode(F.arrays_zip(F.col("ids").alias("unit_id"), F.col("r.p").alias("value"))).alias("x")).select("step", "x.unit_id", "x.value")


def _solve_joins(units: DataFrame, pairs: DataFrame, n: int, dt: float, alpha: float, mode: str) -> DataFrame:
    """The state as rows; a step is a join on the unit and a sum. Each state is written once, to a table in the shared folder
    that is both the result and where the next step starts."""
    spark, path = units.sparkSession, scratch(units.sparkSession)
    matrix = laplacian(units, pairs).repartition("j").persist()
    state = units.select("unit_id", F.col("value").cast("double").alias("value"))
    keep, schema = {s: i for i, s in enumerate(_recorded(n, mode))}, state.schema
    for s in range(n + 1):
        if s:
            state = euler_step(matrix, state, dt, alpha)
        at = f"{path}/state={s}"
        state.write.parquet(at)
        state = spark.read.schema(schema).parquet(at)
    matrix.unpersist()
    step = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col("state")]
    return spark.read.schema("unit_id bigint, value double, state int").parquet(path).select(step.alias("step"), "unit_id", "value").filter("step IS NOT NULL")


def frames(history: DataFrame, areas: DataFrame, every: int = 10) -> DataFrame:
    """``frame_k, unit_id, value, density_to_plot`` of every tenth step."""
    picked = history.filter(F.col("step") % every == 0).withColumn("frame_k", (F.col("step") / every).cast("int") + 1)
    return picked.join(areas.select("unit_id", "area_ha"), "unit_id").select("frame_k", "unit_id", "value", ieee_ln(F.col("value") / F.col("area_ha")).alias("density_to_plot"))
