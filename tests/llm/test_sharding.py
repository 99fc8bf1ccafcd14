import math
import struct
import zlib
from collections import defaultdict

import xxhash

from gridloom.llm import sharding as S


def spark_hash(key, shard):
    """xxhash64 of a long and an int, chained by seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42) if key is not None else 42
    return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=h)


def winner(key, weights):
    draws = [(-math.log(((spark_hash(key, s) >> 11) + 0.5) / (1 << 53)) / w, s) for s, w in enumerate(weights)]
    return min(draws)[1]


def table(spark):
    texts = ["é" * 3, None, "", "same", "same"] * 60
    return spark.createDataFrame([(i * 7 if i else None, t, i) for i, t in enumerate(texts)] + [(7, "é" * 3, 9)], "doc_id bigint, text string, slot int")


def test_against_brute_force(spark):
    df = table(spark)
    rows = S.shard_documents(df, (1.0,) * 5, 1.0, blocks=4).collect()
    assert len(rows) == df.count()
    by, slots = defaultdict(list), defaultdict(list)
    for r in df.collect():
        by[r.doc_id].append((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())))
    for r in rows:
        assert r.shard == winner(r.doc_id, [1.0] * 5) and r.law == "key"
        assert r.grown_shard == winner(r.doc_id, [1.0] * 6) and r.grown_shard in (r.shard, 5)
        assert (r["size"], r.text_crc32) in by[r.doc_id]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_and_small_moves(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    got = S.assign(df, "k", [1.0, 2.0, 1.0], 1.0).groupBy("shard", "grown_shard").count().collect()
    n = defaultdict(int)
    for r in got:
        n[r.shard] += r["count"]
        assert r.grown_shard in (r.shard, 3)
    assert abs(n[1] / 20000 - 0.5) < 0.02
    assert abs(sum(r["count"] for r in got if r.grown_shard == 3) / 20000 - 0.2) < 0.02


def test_empty(spark):
    assert S.shard_documents(table(spark).limit(0)).count() == 0


def test_counts_groups_and_one_frequent_id(spark):
    df = spark.createDataFrame([(1 if i % 2 else None, f"t{i}" * 3, i) for i in range(600)] + [(2, "x" * 200_000, 1)], "doc_id bigint, text string, shard int")
    got = S.shard_documents(df, (1.0,) * 5, 1.0, blocks=16)
    assert got.count() == 601
    for r in got.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert r["max(slot)"] + 1 == r["count(1)"]
    block = S.F.pmod(S.F.xxhash64("doc_id", S.F.crc32(S.F.col("text").cast("binary")), S.F.lit("slot")), S.F.lit(16))
    assert max(r["count"] for r in df.filter("doc_id = 1").groupBy(block).count().collect()) < 60
