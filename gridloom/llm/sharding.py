"""Weighted rendezvous hashing of record keys.

Every shard draws a number from a hash of the key and the shard, divided by the shard's weight; the smallest
draw wins. A further shard only takes the records for which its own draw is smaller than the best so far, so
nothing moves between old shards. All of it is column expressions.

Slots number the rows of a shard from 0 without gaps. Rows are ranked inside (shard, block) groups, blocks
being ``blocks`` hash ranges of the record, and each group starts where the groups before it end; the start
table has shards x blocks rows at most, which bounds the broadcast. So no task sorts a whole shard.

Defined results: a null key is a key like any other; a null text has no bytes and crc32 0; repeated rows get
slots of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OVERHEAD = 16
BLOCKS = 1024


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """An exponential variate with rate ``weight``, fixed by key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 11)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(uniform) / weight


def best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(draw, shard) of the winning shard; ties go to the lower shard."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(draw(key, s["shard"], s["weight"]).alias("draw"), s["shard"].alias("shard"))))


def assign(df: DataFrame, key: str, weights: Sequence[float], added: float | None = None) -> DataFrame:
    """Adds ``shard``, and with ``added`` (the weight of one more shard) ``grown_shard``."""
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and weights over 0")
    out = df.withColumn("_best", best(F.col(key), weights)).withColumn("shard", F.col("_best.shard"))
    if added is not None:
        more = best(F.col(key), [added], len(weights))
        out = out.withColumn("grown_shard", F.least(F.col("_best"), more)["shard"])
    return out.drop("_best")


def with_slots(rows: DataFrame, counted: DataFrame, order: Sequence[str], block: Column, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` and ``counted`` have ``shard`` and the columns of ``block``; ``counted`` may be a cheaper plan of the same rows."""
    slot_block = F.pmod(block, F.lit(blocks)).cast("int")
    sizes = counted.groupBy("shard", slot_block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # kept: at most shards x blocks rows, made before the rows that they are joined with
    starts = cut(sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    ranked = rows.withColumn("_block", slot_block).withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*order)))
    placed = ranked.join(F.broadcast(starts), ["shard", "_block"])
    return placed.withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("bigint")).drop("_block", "_rank", "_start")


def shard_documents(documents: DataFrame, weights: Sequence[float] = (1.0,) * 40, added: float = 1.0, blocks: int = BLOCKS) -> DataFrame:
    """Law ``key``: the id and the shard count decide; one more shard takes rows only into itself."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = documents.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = assign(chosen, "doc_id", weights, added)
    counted = assign(chosen.select("doc_id", "text_crc32"), "doc_id", weights)
    block = F.xxhash64("doc_id", "text_crc32", F.lit("slot"))
    placed = with_slots(rows, counted, ["doc_id", "text_crc32", "size"], block, blocks)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
