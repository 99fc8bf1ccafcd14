"""Connected components of a links table, by labels that only fall, in Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task holds; as a round's work is small, more tasks would only fill the driver with their figures. No more links
#: than that are one task's work as a whole.
TASK_LINKS = 1 << 18


def salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "left", ways: int = 16) -> DataFrame:
    """Join on ``key`` where many rows of ``left`` may share one and ``right`` has one row for each: the left rows are dealt by
    ``by`` to copies of it. They aren't broadcast: Spark would take them for as small as what they are copies of."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(ways)))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(ways)]))).hint("merge")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the smallest node that each reaches."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        own, other = up[x], up[y]
        least = np.minimum(own, other)
        np.minimum.at(up, own, least)
        np.minimum.at(up, other, least)
        while (up[up] != up).any():
            up = up[up]
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[up]


def _at_once(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [np.empty((2, 0), np.int64), *(np.stack([x.column(i).to_numpy() for i in range(2)]) for x in batches)]
        node, label = smallest(*np.concatenate(read, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node bigint, label bigint")


def components(links: DataFrame, at_once: int = TASK_LINKS) -> DataFrame:
    """``links`` (a, b), as they are stored, to ``node, label``: the smallest node that links reach, for every node of a link.

    Up to ``at_once`` links are a few MB and one task's work, without a shuffle. More are worked on in rounds.

    Each round a node takes the smallest label among itself and its neighbours, then the label of its label; the
    number of rounds grows with the logarithm of the longest path. Aggregations are summed before shuffles, the joins'
    hot hubs are split by the adaptive skew join and the lookup of a large component's label is salted. A round has as many
    tasks as its links need, however many shuffle partitions the session has.
    """
    sc = links.sparkSession.sparkContext
    count = links.count()
    if count <= at_once:
        return cut(_at_once(links.select("a", "b").filter("a <> b")))
    n = max(2 * sc.defaultParallelism, math.ceil(count / TASK_LINKS))
    links = links.coalesce(n)
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().coalesce(n))
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).coalesce(n))
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").coalesce(n).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        taken = labels.join(near, "node").coalesce(n).select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old"))
        if turn > 2:  # most groups are near stars and done by now
            up = taken.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("_up"))
            taken = salted(taken, up, "label", "node").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_old")
        jumped = cut(taken.coalesce(n))
        moved = jumped.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
