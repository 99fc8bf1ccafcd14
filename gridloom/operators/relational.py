"""Filters, joins and reports with the semantics of in-memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept


WAYS = 16


def keep_equal(df: DataFrame, column: str, value: str, mode: str = "compat") -> DataFrame:
    """``compat`` drops rows that have another value, so missing values stay; ``corrected`` keeps equal rows only."""
    c = F.col(column)
    return df.filter(c.isNull() | (c == value)) if mode == "compat" else df.filter(c == value)


def key_text(c: Column) -> Column:
    """The text of a key: a missing one is 'nan', as in the tables this mimics (``corrected`` callers keep null)."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def full_outer(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """All rows of both sides in one key column; missing keys match each other; clashing columns get suffixes."""
    clash = (set(a.columns) & set(b.columns)) - {key}
    x = a.select(F.col(key).alias("_k"), *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in a.columns if c != key])
    y = b.select(F.col(key).alias("_l"), *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in b.columns if c != key])
    if x.filter("_k IS NULL").limit(1).count() and y.filter("_l IS NULL").limit(1).count():
        # those without a key all match: each left row goes to one of WAYS tasks, which have all right rows
        left = x.filter("_k IS NULL").withColumn("_way", (F.rand(1) * WAYS).cast("int"))
        right = y.filter("_l IS NULL").withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
        keyed = x.filter("_k IS NOT NULL").join(y.filter("_l IS NOT NULL"), F.col("_k") == F.col("_l"), "full_outer")
        joined = keyed.unionByName(left.join(right, "_way").drop("_way"))
    else:
        joined = x.join(y, F.col("_k") == F.col("_l"), "full_outer")
    return joined.withColumn(key, F.coalesce("_k", "_l")).select(key, *[c for c in joined.columns if c not in ("_k", "_l")])


def outer_sorted(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """``full_outer`` in the order of the key, missing keys last: for a sink whose rows are to be in order."""
    return full_outer(a, b, key, suffixes).orderBy(F.asc_nulls_last(key))


def geocode(df: DataFrame, address: str, known: DataFrame) -> DataFrame:
    """Adds ``coords`` (lon, lat), null where the address is missing or not among ``known`` (address, lon, lat; one row each).
    Stands in for a service that answers with a place or with nothing."""
    at = known.select(F.col("address").alias("_address"), F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).alias("coords"))
    joined = df.join(at, F.col(address) == F.col("_address"), "left").drop("_address")
    found = F.col("coords.lon").isNotNull() & F.col("coords.lat").isNotNull()
    return joined.withColumn("coords", F.when(found, F.col("coords")))


def null_column(df: DataFrame, name: str, kind: str = "array<bigint>") -> DataFrame:
    """Adds a column that is null everywhere, to be filled later."""
    return df.withColumn(name, F.lit(None).cast(kind))


def min_max(df: DataFrame, column: str, frame: str | None = None) -> DataFrame:
    """Adds ``shade``: the column scaled to 0..1 within its frame. The limits are aggregated first, so no frame gathers in
    a task; the rows are kept, so they are computed once."""
    df, keys = kept(df), [frame] if frame else []
    limits = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(limits, keys) if keys else df.crossJoin(F.broadcast(limits))  # one row
    return joined.withColumn("shade", F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def overlay(layers: dict[str, DataFrame]) -> DataFrame:
    """The layers' rows with ``layer`` and ``draw_order``; columns a layer lacks are null."""
    out = None
    for i, (name, df) in enumerate(layers.items()):
        one = df.withColumns({"layer": F.lit(name), "draw_order": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def info(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null`` in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("non_null")) for c, t in df.dtypes]
    return counts.select(F.explode(F.array(*pairs)).alias("_r")).select("_r.*")
