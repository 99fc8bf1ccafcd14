"""Document fingerprints by consistent weighted sampling, in column expressions only.

A text's terms are its lower-case words, weighted 1 + ln(count). A weight is split into whole parts and a remainder;
each part has its own hash, which fixes r and c, both gamma(2, 1), and beta, uniform. With weight w (1, or the
remainder) the part offers t = floor(ln w / r + beta) at the price ln a = ln c - r (t - beta) - r (Ioffe's scheme). Parts fall
into ``BINS`` bins by hash, and each bin keeps the (part, t) with the lowest price; two texts keep the same in a bin with a
probability that is the generalised Jaccard similarity of the bin's parts. As parts have nearly equal weights, the share of
equal bins among those that either text fills estimates the similarity of the texts: one offer a part fills the whole
signature, and heavy terms have many parts.

The next document (descending id) is found without a global sort: ids are cut into ranges at approximate quantiles,
an id (or none) that many rows share into further ones by a hash of the text; each range gets the first document of the
range below it (the lowest gets the highest document), and a window inside ranges does the rest. Texts are shuffled once.

Defined results: a null text is empty; texts without words have an empty fingerprint, equal to each other (1.0) and
unlike all others (0.0); null ids come last; rows that share an id are ordered by a hash of their text; the only row is its
own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
RANGES_A_PARTITION = 4


def _uniform(bits: Column) -> Column:
    """32 bits to (0, 1)."""
    return (bits + F.lit(0.5)) / F.lit(float(1 << 32))


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def _offer(part: Column) -> Column:
    g, k, b = (F.xxhash64(part["term"], F.lit(i)) for i in (1, 2, 3))
    return F.struct(
        part["term"].alias("term"),
        part["lw"].alias("lw"),
        (-F.ln(_uniform(_low(g)) * _uniform(_high(g)))).alias("r"),
        (-F.ln(_uniform(_low(k)) * _uniform(_high(k)))).alias("c"),
        _uniform(_low(b)).alias("beta"),
    )


def _further(e: Column) -> Column:
    """The parts of a term beyond the first, which weighs 1."""
    return F.transform(F.sequence(F.lit(1), F.ceil(e["w"]).cast("int") - 1), lambda u: F.struct(F.xxhash64(e["x"], u).alias("term"), F.ln(F.least(F.lit(1.0), e["w"] - u)).alias("lw")))


def _packed(o: Column) -> Column:
    """bin (7 bits), price (32 bits, rising), tag of (term, t) (24 bits): the least of a bin is its sample."""
    price = F.ln(o["c"]) - o["r"] * (o["t"] - o["beta"]) - o["r"]
    fixed = (F.greatest(F.lit(0.0), F.least(F.lit(500.0), price + 250.0)) * F.lit(float(1 << 23))).cast("bigint")
    tag = F.xxhash64(o["term"], o["t"].cast("bigint")).bitwiseAND(F.lit(0xFFFFFF))
    return F.shiftleft(F.pmod(o["term"], F.lit(BINS)).cast("bigint"), 56) + F.shiftleft(fixed, 24) + tag


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of (bin, tag) numbers, sorted by bin. Steps are separate projections, so each is computed
    once."""
    step = f"_{name}"
    split = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    out = df.withColumn(step, F.sort_array(F.transform(split, lambda x: F.xxhash64(x))))
    s = F.col(step)
    # the last of each run of equal terms, with its place; counts are differences of places
    ends = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: F.coalesce(F.get(s, e["i"] + 1) != e["x"], F.lit(True)))
    out = out.withColumn(step, ends)
    weight = lambda e, j: F.lit(1.0) + F.ln((e["i"] - F.coalesce(F.get(s, j - 1)["i"], F.lit(-1))).cast("double"))
    out = out.withColumn(step, F.transform(s, lambda e, j: F.struct(e["x"].alias("x"), weight(e, j).alias("w"))))
    first = F.transform(s, lambda e: F.struct(e["x"].alias("term"), F.lit(0.0).alias("lw")))
    more = F.flatten(F.transform(F.filter(s, lambda e: e["w"] > 1.0), _further))
    out = out.withColumn(step, F.concat(first, more))
    out = out.withColumn(step, F.transform(s, _offer))
    timed = F.transform(s, lambda o: F.struct(o["term"].alias("term"), o["r"].alias("r"), o["c"].alias("c"), o["beta"].alias("beta"), F.floor(o["lw"] / o["r"] + o["beta"]).cast("double").alias("t")))
    out = out.withColumn(step, timed)
    out = out.withColumn(step, F.sort_array(F.transform(s, _packed)))
    first = F.filter(s, lambda v, i: F.coalesce(F.shiftright(v, 56) != F.shiftright(F.get(s, i - 1), 56), F.lit(True)))
    return out.withColumn(name, F.transform(first, lambda v: F.shiftleft(F.shiftright(v, 56), 24) + v.bitwiseAND(F.lit(0xFFFFFF)))).drop(step)


def shown(prints: str) -> Column:
    """8 hexadecimal digits for each filled bin."""
    return F.array_join(F.transform(prints, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Equal bins among filled bins: estimates the generalised Jaccard similarity."""
    bins = lambda c: F.transform(c, lambda v: F.shiftright(v, 24))
    filled = F.size(F.array_union(bins(a), bins(b)))
    same = F.size(F.array_intersect(F.col(a), F.col(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled).cast("double")


def _place(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are below x, by halving."""
    if not bounds:
        return F.lit(0)
    table, n = F.lit([int(b) for b in bounds]).cast("array<bigint>"), len(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & (F.get(table, mid) < x)
        above = (acc["lo"] < acc["hi"]) & ~below
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(above, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, halve, lambda acc: acc["lo"])


def _range_of(bounds: list[int], shares: dict[int, int], nulls: int) -> Column:
    """Rises with the order (id, hash of the text). ``shares``: into how many ranges the rows of a frequent id go."""
    unit = (F.shiftright("_hash", 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))  # rises with the hash
    at = _place(bounds, F.col("doc_id")).cast("bigint")
    further = F.lit(0).cast("bigint")
    if shares:
        ways = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])[F.col("doc_id")]
        further = F.when(ways.isNotNull(), 1 + F.floor(unit * ways)).otherwise(0)
    return F.when(F.col("doc_id").isNull(), F.floor(unit * nulls) - (1 << 40)).otherwise(at * (1 << 20) + further)


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text, _hash, _range, _halo``: each row in its range, and after each range's rows the row that follows them."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    points = [i / ranges for i in range(1, ranges)] or [0.5]
    seen = documents.select(F.percentile_approx("doc_id", points, max(10_000, 10 * ranges)), F.count("doc_id"), F.count(F.lit(1))).first()
    found = Counter(int(c) for c in seen[0] or [])
    nulls = 1 + ranges * (seen[2] - seen[1]) // max(1, seen[2])
    place = _range_of(sorted(found), {c: n for c, n in found.items() if n > 1}, nulls)
    own = docs.withColumns({"_range": place, "_halo": F.lit(0)})
    # a row for each range, at most twice ``ranges``
    tops = sorted((r["_range"], r["top"]["doc_id"], r["top"]["_hash"]) for r in own.groupBy("_range").agg(F.max(F.struct("doc_id", "_hash")).alias("top")).collect())
    follow = [(*tops[i][1:], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    heads = documents.sparkSession.createDataFrame(follow, "_top bigint, _top_hash bigint, _range bigint")
    halo = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("_hash") == F.col("_top_hash"))).select("doc_id", "text", "_hash", "_range", F.lit(1).alias("_halo"))
    return own.unionByName(halo)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(documents, RANGES_A_PARTITION * partitions).repartition(partitions, F.col("_range"))
    order = Window.partitionBy("_range").orderBy(F.asc("_halo"), F.desc_nulls_last("doc_id"), F.desc("_hash"))
    rows = with_fingerprint(rows, "text", "_own")
    rows = rows.withColumns({"_next": F.lead("text").over(order), "_next_own": F.lead("_own").over(order)}).filter("_halo = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.coalesce("_next", F.lit("")), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("_edited"), "_own", "_next_own")
    rows = with_fingerprint(rows, "_edited", "_changed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        shown("_own").alias("fingerprint"),
        shown("_changed").alias("edited_fingerprint"),
        likeness("_own", "_changed").alias("near_edited"),
        likeness("_own", "_next_own").alias("near_next"),
    )
