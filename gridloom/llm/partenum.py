"""Exact Jaccard self-join of word shingle sets by PartEnum signatures.

A text's set are its distinct 5-word shingles (lower case; fewer words: all of them as one). Two sets link when
their Jaccard similarity is at least ``num/den``.

Signatures. Sizes fall into bands. A pair belongs to the band of its smaller set, so a set signs for its own band
and for the band below if partners can be there. Linked sets of a band differ in at most k features. The feature domain
is partitioned twice: into blocks, and each block into N2 parts. With at most k differences, at most k // (K2 + 1) blocks
hold more than K2, so with k // (K2 + 1) + 1 + slack blocks there are slack + 1 that hold at most K2 = 1. For each block
all subsets of N2 - K2 parts are enumerated; a signature is (band, block, subset, features there). In each of
those slack + 1 blocks the sets agree on a whole subset. A block is safe for a set if none of its subsets is empty there, so a
pair shares a signature as long as one of the two has at most ``slack`` unsafe blocks. Where k is small (short texts), blocks have one
part only and none of it is left out (K2 = 0).

Frequent features (found on a bounded sample; any choice is safe) are left out of the domain first, since leaving out
features never adds a difference; thus passages that many texts share make no large groups. Sets that then have too many
unsafe blocks (``poor``) sign both without and with those features, and sign empty subsets too if even all their
features leave too many unsafe. A pair with a good set shares a signature of the first kind, a pair of poor sets one
of the second. So no link is lost.

Links. Equal sets collapse into classes first. Signatures travel packed by hash range. Among the sets that share a
signature no pairs are listed. Each set is compared with the centre of each of its groups: that member which shares most signatures
with others, so the least edited copy. What then is unconnected in a group is bounded: a feature that only one component
has can't be common to two, so sets of which less than ``num/den`` is found in other components have no further link. The few
that are left meet in clusters of components, in blocks of bounded size, where counts are kept in matrices and only a forest
of links comes out. Every link is verified exactly on whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, drop_stored, release, store
from .components import components, salted

SHINGLE = 5
RATIO = 1.3
SLACK = 0.25
#: Parts of a block, and how many of them a signature leaves out, in bands where sets may differ in at least DEEP features.
N2, K2, DEEP = 3, 1, 16
#: Bounded sample on which frequent features are found, and the share of its sets from which a feature is frequent.
SAMPLE_SETS = 20_000
FREQUENT = 0.0002
FLUSH = 1 << 20
BUCKET_BYTES = 6 << 20
#: Features of the sets that one task compares at once, and cells of its matrix of counts.
BLOCK_FEATURES = 1 << 19
CELLS = 1 << 20
#: Features whose sets one task of a plain join has.
TASK_FEATURES = 1 << 20
_ABC = K.alphabet("space")
_U = np.uint64


def bands(num: int, den: int, largest: int) -> list[tuple[int, int, int, int, bool]]:
    """(smallest size, largest size, blocks, slack, whether blocks have parts) of each band; sizes below the first link
    only with equal sets."""
    low = 1
    while low * den < num * (low + 1):  # smaller sets link with equal sets only
        low += 1
    out = []
    while low <= largest:
        high = max(low, math.floor(low * RATIO))
        total = high + (high * den) // num
        k = total * (den - num) // (den + num)
        deep = k >= DEEP
        full = k // (K2 + 1) if deep else k  # at most so many blocks hold more differences than a subset leaves out
        slack = max(2, math.ceil(SLACK * full)) if deep else max(2, math.ceil(0.15 * k))
        out.append((low, high, full + 1 + slack, slack, deep))
        low = high + 1
    return out


def sets_of(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    K.forget()
    w = K.words(texts, _ABC)
    h = K.spans_hash(texts, _ABC.low, w.starts, w.ends)
    return K.distinct_by_text(*K.shingles(h, w, SHINGLE), len(texts))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_ids(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    n = np.diff(offsets).astype(np.uint64)
    a = K.mix(_sums(K.mix(hashes ^ _U(0x51ED270B + salt)), offsets) + n)
    b = K.mix(_sums(K.mix(hashes ^ _U(0x2545F491)), offsets) ^ n)
    return a, b


class Signer:
    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent = num, den, frequent
        self.table: list[tuple[int, int, int, int, bool]] = []

    def _bands(self, largest: int) -> None:
        if not self.table or self.table[-1][1] < largest:
            self.table = bands(self.num, self.den, max(largest, 1 << 16))
            self.lows, _, self.blocks, self.slacks, self.deep = (np.array(x) for x in zip(*self.table))

    def sign(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and the set of each."""
        size = np.diff(offsets)
        if not len(size) or not len(hashes):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._bands(int(size.max()))
        of = np.repeat(np.arange(len(size)), size)
        rare = np.ones(len(hashes), bool)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, hashes)
            rare = self.frequent[np.minimum(at, len(self.frequent) - 1)] != hashes
        own = np.searchsorted(self.lows, size, side="right") - 1
        least = -(-size * self.num // self.den)
        below = np.where((own > 0) & (least < self.lows[np.maximum(own, 0)]), own - 1, -1)
        sigs, sets = [], []
        for band in (own, below):
            slack = self.slacks[np.maximum(band, 0)]
            active = band >= 0
            got, unsafe = self._subsets(hashes, of, rare & active[of], band, 1)
            sigs += got[0]
            sets += got[1]
            poor = active & (unsafe > slack)
            if poor.any():
                got, unsafe = self._subsets(hashes, of, poor[of], band, 2)
                sigs += got[0]
                sets += got[1]
                for s in np.flatnonzero(poor & (unsafe > slack)):
                    gaps = self._gaps(hashes[offsets[s] : offsets[s + 1]], int(band[s]))
                    sigs.append(K.mix(K.mix(gaps + _U(int(band[s]) << 32)) + _U(3)))
                    sets.append(np.full(len(gaps), s))
        return np.concatenate(sigs), np.concatenate(sets)

    def _subsets(self, hashes, of, keep, band, kind):
        """Signatures of the non-empty subsets (lists of arrays) and their sets; how many unsafe blocks each set has."""
        h, s = hashes[keep], of[keep]
        blocks = self.blocks[np.maximum(band, 0)]
        if not len(h):
            return ([np.empty(0, np.uint64)], [np.empty(0, np.int64)]), blocks
        block = ((h >> _U(32)) * blocks[s].astype(np.uint64)) >> _U(32)  # rises with the hash, so a block's features are neighbours
        new = np.ones(len(h), bool)
        new[1:] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        heads = np.flatnonzero(new)
        at, size, value = s[heads], np.diff(np.append(heads, len(h))), K.mix(h)
        whole = np.add.reduceat(value, heads)
        where = K.mix(block[heads] + (band[at].astype(np.uint64) << _U(32))) + _U(kind)
        deep = self.deep[band[at]]
        sigs, sets = [K.mix(whole + K.mix(where))[~deep]], [at[~deep]]
        filled = np.zeros(len(heads), np.int64)
        if deep.any():
            part = ((h & _U(0xFFFFFFFF)) * _U(N2)) >> _U(32)
            for left_out in range(N2):
                inside = part == left_out
                n = np.add.reduceat(inside.astype(np.int64), heads)
                filled += n > 0
                rest = whole - np.add.reduceat(np.where(inside, value, _U(0)), heads)
                ok = deep & (size > n)
                sigs.append(K.mix(rest + K.mix(where + _U((left_out + 1) << 40)))[ok])
                sets.append(at[ok])
        safe = ~deep | (filled > K2)
        return (sigs, sets), blocks - np.bincount(at[safe], minlength=len(blocks))

    def _gaps(self, h: np.ndarray, band: int) -> np.ndarray:
        """The set's empty subsets, each a number."""
        n = int(self.blocks[band])
        block = (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
        if not self.deep[band]:
            return np.setdiff1d(np.arange(n), block).astype(np.uint64)
        part = (((h & _U(0xFFFFFFFF)) * _U(N2)) >> _U(32)).astype(np.int64)
        held = np.bincount(block * N2 + part, minlength=n * N2).reshape(n, N2)
        return np.flatnonzero(held.sum(1, keepdims=True) == held).astype(np.uint64) + _U(1 << 20)


def _documents(documents: DataFrame, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *also)


def _set_table(docs: DataFrame, salt: int, also: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                h, o = sets_of(texts)
                a, b = set_ids(h, o, salt)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(o)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *[rows.column(c) for c in also]], names=["doc_id", "n", "node", "check", *also])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(["doc_id bigint, n bigint, node bigint, check bigint", *[f"{c} {kinds[c]}" for c in also]]))


def _frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Features in at least FREQUENT of a sample of about SAMPLE_SETS distinct sets (whole texts)."""
    every = max(1, round(rows / SAMPLE_SETS))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in K.chunks(batch, "text"):
                h, o = sets_of(texts)
                ids, _ = set_ids(h, o, 0)
                _, first = np.unique(ids, return_index=True)
                one = np.zeros(len(texts), bool)
                one[first] = True
                f, c = np.unique(h[np.repeat(one, np.diff(o))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c)], names=["feature", "n"])

    least = max(4, math.ceil(FREQUENT * min(rows, SAMPLE_SETS)))
    found = picked.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # at most (features of the sample / least) rows
    return np.sort(found.select("feature").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


_PACKED = "bucket int, sigs binary, nodes binary, ids binary"


def _range_of(sigs: np.ndarray, buckets: int) -> np.ndarray:
    """The 24 high bits choose the hash range, the 40 low bits tell signatures apart inside it."""
    return (((sigs >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)


def _pack(bucket: int, sigs: np.ndarray, nodes: np.ndarray) -> dict:
    low = sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    ids, index = np.unique(nodes, return_inverse=True)
    if len(ids) <= 65536 and 8 * len(ids) < 6 * len(nodes):
        return {"bucket": bucket, "sigs": low, "nodes": index.astype(np.uint16).tobytes(), "ids": ids.tobytes()}
    return {"bucket": bucket, "sigs": low, "nodes": nodes.tobytes(), "ids": b""}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(row["sigs"], np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    nodes = np.frombuffer(row["nodes"], np.uint16 if row["ids"] else np.uint64)
    return wide.view("<u8").ravel().astype(np.uint64), np.frombuffer(row["ids"], np.uint64)[nodes] if row["ids"] else nodes


def _grouped(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Signatures in order and their sets; where each signature begins, how many rows it has, whether it has several sets. By
    one key only, which takes a third of the time of two."""
    order = np.argsort(sigs)
    sigs, nodes = sigs[order], nodes[order]
    heads = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
    size = np.diff(np.append(heads, len(sigs)))
    return sigs, nodes, heads, size, np.minimum.reduceat(nodes, heads) != np.maximum.reduceat(nodes, heads)


def _common_only(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of several sets, each set once."""
    if not len(sigs):
        return sigs, nodes
    sigs, nodes, _, size, several = _grouped(sigs, nodes)
    among = np.repeat(several, size)
    sigs, nodes = sigs[among], nodes[among]
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    once = np.ones(len(sigs), bool)
    once[1:] = (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])
    return sigs[once], nodes[once]


def _packed(docs: DataFrame, frequent: np.ndarray, buckets: int, salt: int, num: int, den: int) -> DataFrame:
    """Signatures by hash range. Of the sets of a task's flush that share a signature only the smallest is sent to
    the signature's range; the whole group goes to a range of the flush (below 0), so no signature, however many
    sets share it, gathers in one range."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("ids", pa.binary())])

    def flush(sigs: np.ndarray, nodes: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        sigs, nodes, heads, size, several = _grouped(sigs, nodes)
        out = []
        if several.any():
            among = np.repeat(several, size)
            out.append({"bucket": -1 - number % buckets, "sigs": sigs[among].tobytes(), "nodes": nodes[among].tobytes(), "ids": b""})
        s, d = sigs[heads], np.minimum.reduceat(nodes, heads)
        top = _range_of(s, buckets)
        ends = np.append(np.flatnonzero(np.diff(top)) + 1, len(top))
        at = 0
        for end in ends:
            out.append(_pack(int(top[at]), s[at:end], d[at:end]))
            at = end
        yield pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, kept, n, number = Signer(num, den, shared.value), [], 0, TaskContext.get().partitionId() * 7919
        for batch in batches:
            for _, texts in K.chunks(batch, "text"):
                h, o = sets_of(texts)
                ids, _ = set_ids(h, o, salt)
                _, first = np.unique(ids, return_index=True)
                if len(first) < len(ids):  # equal sets of a chunk sign once
                    one = np.zeros(len(ids), bool)
                    one[first] = True
                    size = np.diff(o)
                    h, ids = h[np.repeat(one, size)], ids[one]
                    o = np.concatenate([[0], np.cumsum(size[one])])
                sigs, sets = signer.sign(h, o)
                kept.append((sigs, ids[sets]))
                n += len(sigs)
                if n >= FLUSH:
                    yield from flush(*(np.concatenate(x) for x in zip(*kept)), number)
                    kept, n, number = [], 0, number + 1
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*kept)), number)

    return docs.select("text").mapInArrow(run, _PACKED)


def _shared(packed: DataFrame, buckets: int) -> DataFrame:
    """``gid, node``: who shares a signature with others, by a number of the signature."""

    def run(group: pa.Table) -> pa.Table:
        at, rows = group.column("bucket")[0].as_py(), group.to_pylist()
        if at < 0:  # each row is a flush
            read = [_common_only(np.frombuffer(r["sigs"], np.uint64), np.frombuffer(r["nodes"], np.uint64)) for r in rows]
        else:
            read = [_common_only(*(np.concatenate(x) for x in zip(*map(_unpack, rows))))]
        sigs, nodes = (np.concatenate(x) for x in zip(*read))
        bucket = _range_of(sigs, buckets) if at < 0 else np.full(len(sigs), at)
        gid = (bucket.astype(np.uint64) << _U(40)) | (sigs & _U((1 << 40) - 1))
        return pa.table({"gid": pa.array(gid.view(np.int64)), "node": pa.array(nodes.view(np.int64))})

    # as many tasks as buckets, whatever the session's number of partitions is
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "gid bigint, node bigint")


def _different(listed: DataFrame) -> DataFrame:
    """``gid, node, times`` of ``listed`` (gid, node): near copies share many signatures, so of the groups with equal sets one is kept,
    with how many there were. Groups are equal if their smallest and largest set, their size and two 32-bit sums of hashes are."""
    part = lambda *c: F.sum(F.shiftrightunsigned(F.xxhash64(*c), 32))
    told = listed.groupBy("gid").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"), part("node").alias("x"), part("node", F.lit(1)).alias("y"))
    return listed.join(told.groupBy("lo", "hi", "size", "x", "y").agg(F.min("gid").alias("gid"), F.count(F.lit(1)).alias("times")).select("gid", "times"), "gid")


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features of each row's text, and their offsets."""
    features, sizes = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for batch in table.select(["text"]).to_batches():
        for _, texts in K.chunks(batch, "text"):
            h, o = sets_of(texts)
            features.append(h)
            sizes.append(np.diff(o))
    return np.concatenate(features), np.cumsum(np.concatenate(sizes))


def _support(members: DataFrame, features: int, buckets: int) -> DataFrame:
    """``node, support`` of ``members`` (node, label, text): how many of a set's features sets of other labels have. Only
    those can be common with a set that isn't linked yet. (Equal low bits of different features may only raise it.)

    Sets are dealt into parts of about BLOCK_FEATURES. A part tells the feature's range at most two labels that it saw
    with a feature, and is told which features have several; so no feature, however frequent, gathers in one task.
    """
    parts = max(1, math.ceil(features / BLOCK_FEATURES))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)))

    def send(group: pa.Table) -> pa.Table:
        h, o = _sets(group)
        label = np.repeat(group.column("label").to_numpy().view(np.uint64), np.diff(o))
        order = np.lexsort((label, h))
        h, label = h[order], label[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (label[1:] != label[:-1])
        h, label = h[new], label[new]
        change = np.flatnonzero(h[1:] != h[:-1])
        keep = np.zeros(len(h), bool)  # the smallest and the largest label of each feature
        keep[:1] = keep[-1:] = keep[change] = keep[change + 1] = True
        h, label = h[keep], label[keep]
        top = _range_of(h, buckets)
        out, at = [], 0
        for end in np.append(np.flatnonzero(np.diff(top)) + 1, len(top)) if len(top) else []:
            out.append({"part": group.column("part")[0].as_py()} | _pack(int(top[at]), h[at:end], label[at:end]))
            at = end
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("ids", pa.binary())]))

    def find(group: pa.Table) -> pa.Table:
        rows, bucket = group.to_pylist(), _U(group.column("bucket")[0].as_py())
        low, label = (np.concatenate(x) for x in zip(*map(_unpack, rows)))
        part = np.repeat([r["part"] for r in rows], [len(r["sigs"]) // 5 for r in rows])
        order = np.lexsort((label, low))
        low, label, part = low[order], label[order], part[order]
        heads = np.flatnonzero(np.diff(low, prepend=low[0] + _U(1)))
        size = np.diff(np.append(heads, len(low)))
        several = np.repeat(label[heads] != label[heads + size - 1], size)
        low, part = low[several], part[several]
        order = np.argsort(part, kind="stable")
        low, part = low[order], part[order]
        out, at = [], 0
        for end in np.append(np.flatnonzero(np.diff(part)) + 1, len(part)) if len(part) else []:
            out.append({"part": int(part[at]), "features": np.unique(low[at:end] | (bucket << _U(40))).tobytes()})
            at = end
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("features", pa.binary())]))

    def total(group: pa.Table, told: pa.Table) -> pa.Table:
        h, o = _sets(group)
        known = np.sort(np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in told.column("features").to_pylist()]]))
        mine = (_range_of(h, buckets).astype(np.uint64) << _U(40)) | (h & _U((1 << 40) - 1))
        at = np.searchsorted(known, mine)
        held = (known[np.minimum(at, len(known) - 1)] == mine) if len(known) else np.zeros(len(mine), bool)
        of = np.repeat(np.arange(group.num_rows), np.diff(o))
        return pa.table({"node": group.column("node"), "support": pa.array(np.bincount(of[held], minlength=group.num_rows).astype(np.int64))})

    sent = dealt.select("part", "label", "text").groupBy("part").applyInArrow(send, "bucket int, part bigint, sigs binary, nodes binary, ids binary")
    told = sent.groupBy("bucket").applyInArrow(find, "part bigint, features binary")
    return dealt.select("part", "node", "text").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(total, "node bigint, support bigint")


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of common features, of some left sets (from the number given) and all right ones at a time. Features of many
    right sets are counted by a product of matrices, the others by their lists."""
    (lh, lo), (rh, ro) = left, right
    nl, nr = len(lo) - 1, len(ro) - 1
    of = np.repeat(np.arange(nr), np.diff(ro))
    order = np.argsort(rh, kind="stable")
    known, first, many = np.unique(rh[order], return_index=True, return_counts=True)
    of = of[order]
    wide = many > max(32, nr // 16)
    column = np.cumsum(wide) - 1
    dense = np.zeros((nr, int(wide.sum())), np.float32)
    among = np.repeat(wide, many)
    dense[of[among], np.repeat(column, many)[among]] = 1
    at = np.minimum(np.searchsorted(known, lh), len(known) - 1)
    hit = known[at] == lh
    work = np.concatenate([[0], np.cumsum(np.where(hit & ~wide[at], many[at], 0))])[lo]
    begin = 0
    while begin < nl:
        end = min(begin + max(1, CELLS // nr), max(begin + 1, int(np.searchsorted(work, work[begin] + CELLS, side="right")) - 1), nl)
        span = slice(lo[begin], lo[end])
        x, row = at[span], np.repeat(np.arange(end - begin), np.diff(lo[begin : end + 1]))
        x, row = x[hit[span]], row[hit[span]]
        mine = np.zeros((end - begin, dense.shape[1]), np.float32)
        mine[row[wide[x]], column[x[wide[x]]]] = 1
        count = mine @ dense.T
        x, row = x[~wide[x]], row[~wide[x]]
        n = many[x]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x], n)
        cells = np.bincount(np.repeat(row, n) * nr + of[place], minlength=(end - begin) * nr)
        yield begin, count.astype(np.int64) + cells.reshape(end - begin, nr)
        begin = end


def forest(h: np.ndarray, o: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets ``left`` and ``right`` (row numbers): enough to connect, with the labels as they are, all that
    link, and no more."""
    take = lambda rows: (h[np.concatenate([np.arange(o[r], o[r + 1]) for r in rows])], np.concatenate([[0], np.cumsum(np.diff(o)[rows])]))
    _, code = np.unique(label, return_inverse=True)
    up = np.arange(len(code))
    size = np.diff(o)

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            y = up[x]
            if (y == x).all():
                return x
            up[x] = up[y]
            x = up[y]

    a, b = [], []
    for begin, common in _common(take(left), take(right)):
        some = left[begin : begin + len(common)]
        ok = (common > 0) & (den * common >= num * (size[some][:, None] + size[right][None] - common))
        for i in np.flatnonzero(ok.any(1)):
            js = right[ok[i]]
            of, own = root(code[js]), root(code[some[i : i + 1]])[0]
            others, at = np.unique(of, return_index=True)
            at = at[others != own]
            if len(at):
                a.append(np.full(len(at), some[i]))
                b.append(js[at])
                up[np.append(others, own)] = min(others[0], own)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _compared(rows: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among ``rows`` (pack, key, side, node, label): in each key, sets of side 0 meet those of side 1, and
    those of side 2 meet all. A pack of keys is one group of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        h, o = _sets(group)
        key, node, side = (group.column(c).to_numpy() for c in ("key", "node", "side"))
        h = K.mix(h ^ np.repeat(key.view(np.uint64), np.diff(o)))  # sets of different keys have nothing in common
        a, b = forest(h, o, np.flatnonzero(side != 1), np.flatnonzero(side != 0), group.column("label").to_numpy(), num, den)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    wide = rows.join(texts.select("node", "text"), "node").select("pack", "key", "side", "node", "label", "text")
    return wide.groupBy("pack").applyInArrow(run, "a bigint, b bigint")


def _stars(pairs: DataFrame, tasks: int) -> DataFrame:
    """Rows for _compared: each set ``a`` (of n features) with its centre ``c``."""
    load = cut(pairs.groupBy("c").agg(F.sum("n").alias("load")).coalesce(tasks))
    packs = max(1, math.ceil((load.agg(F.sum("load")).first()[0] or 0) / BLOCK_FEATURES))
    large = load.filter(F.col("load") > BLOCK_FEATURES).select("c", F.ceil(F.col("load") / BLOCK_FEATURES).alias("ways"))
    dealt = pairs.join(large, "c", "left").withColumn("way", F.pmod(F.xxhash64("a"), F.coalesce("ways", F.lit(1))))
    pack = F.when(F.col("ways").isNull(), F.pmod(F.xxhash64("c"), F.lit(packs))).otherwise(F.xxhash64("c", "way"))
    dealt = dealt.select(pack.alias("pack"), F.col("c").alias("key"), "a").coalesce(tasks)
    member = dealt.select("pack", "key", F.lit(1).alias("side"), F.col("a").alias("node"), F.col("a").alias("label"))
    centre = dealt.select("pack", "key").distinct().coalesce(tasks).select("pack", "key", F.lit(0).alias("side"), F.col("key").alias("node"), F.col("key").alias("label"))
    return member.unionByName(centre)


def _blocks(members: DataFrame, tasks: int) -> DataFrame:
    """Rows for _compared: all sets of a cluster of components (cluster, label, node, n), in blocks of bounded size. The sets
    of the largest component needn't meet each other, so they meet the blocks of the others only."""
    of_label = members.groupBy("cluster", "label").agg(F.sum("n").alias("load"))
    of_cluster = cut(of_label.groupBy("cluster").agg(F.sum("load").alias("load"), F.max(F.struct("load", "label")).alias("main")).filter("load > main.load").coalesce(tasks))
    packs = max(1, math.ceil((of_cluster.agg(F.sum(F.least("load", F.lit(BLOCK_FEATURES)))).first()[0] or 0) / BLOCK_FEATURES))
    ways = lambda load: F.ceil(load / BLOCK_FEATURES).cast("int")
    small = F.col("load") <= BLOCK_FEATURES
    plan = of_cluster.select("cluster", small.alias("small"), F.col("main.label").alias("main"), F.when(small, 1).otherwise(ways(F.col("load") - F.col("main.load"))).alias("rest"), F.when(small, 0).otherwise(ways(F.col("main.load"))).alias("mains"))
    known = members.join(plan, "cluster")
    first = F.col("small") | (F.col("label") != F.col("main"))
    own = F.when(first, F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))).cast("int")
    known = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    key = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    return known.select(F.when(F.col("small"), F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(key).alias("pack"), key.alias("key"), side.alias("side"), "node", "label")


def link_components(documents: DataFrame, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the set's size and the smallest id that links reach.

    With names in ``also``, those columns too, and ``label``: a number of the component that no other has, even if rows of
    both share their smallest id (null if the row is alone by definition).

    Defined results: null, empty and word-less texts have no set and are alone; repeated ids and rows are linked as
    their texts are; a row without an id is counted but linked with nothing; an empty table gives an empty result;
    further columns are ignored.
    """
    docs = _documents(documents, key, text)
    told = _documents(documents, key, text, also)
    for salt in range(8):
        sets = store(_set_table(told, salt, also))
        named = sets.filter("n > 0 AND doc_id IS NOT NULL")
        nodes = store(named.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("doc_id").alias("first"), F.min("n").alias("n")))
        if nodes.filter("lo <> hi").limit(1).count() == 0:
            break  # else two different sets share a 64-bit id: take other ids
    labels = _labels(docs.filter("doc_id IS NOT NULL"), sets, nodes, salt, num, den)
    linked = cut(labels.join(nodes.select("node", "first"), "node"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = salted(linked.select("node", "label"), smallest, "label", "node")
    of_node = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"), *[F.coalesce("label", "node").alias("label")] * bool(also))
    joined = sets.join(of_node, "node", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    further = [*also, F.when(~alone, F.col("label")).alias("label")] if also else []
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *further)


def _labels(docs: DataFrame, sets: DataFrame, nodes: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """``node, label`` of the sets that link with others. Joins without Python have as many tasks as the features need, since
    the driver keeps figures of each task."""
    spark = docs.sparkSession
    stats = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("features")).first()
    features = stats["features"] or 0
    frequent = _frequent(docs, stats["rows"])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(features * 7 / BUCKET_BYTES))
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(features / TASK_FEATURES))
    listed = store(_shared(_packed(docs, frequent, buckets, salt, num, den), buckets))
    shared = store(_different(listed).coalesce(tasks))
    drop_stored(listed)
    seen = cut(shared.groupBy("node").agg(F.sum("times").alias("seen")).join(nodes.select("node", "first", "n"), "node").coalesce(tasks))
    # an id that several rows have may have other texts too, so the set's id is checked again
    release(spark)
    texts = store(_texts(docs.join(seen.select(F.col("first").alias("doc_id"), "node", "n"), "doc_id"), salt).dropDuplicates(["node"]))

    member = shared.join(seen.select("node", "n", "seen"), "node").coalesce(tasks)
    centre = member.groupBy("gid").agg(F.max(F.struct("seen", "node", "n")).alias("c"))
    near = (F.col("c.node") != F.col("node")) & (F.least("n", "c.n") * den >= F.greatest("n", "c.n") * num)
    pairs = cut(member.join(centre, "gid").filter(near).select(F.col("node").alias("a"), F.col("c.node").alias("c"), "n").coalesce(tasks).distinct().coalesce(tasks))
    labels = components(cut(_compared(_stars(pairs, tasks), texts, num, den)))
    release(spark)

    known = cut(seen.select("node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).coalesce(tasks))
    open_ = cut(_unconnected(shared, known, tasks).select("node", "label", "n").distinct().coalesce(tasks))
    release(spark)
    rest = open_.join(texts.select("node", "text"), "node")
    support = _support(rest, open_.agg(F.sum("n")).first()[0] or 0, buckets)
    known = cut(open_.join(support, "node").filter(F.col("support") * den >= F.col("n") * num).coalesce(tasks))
    meet = _unconnected(shared, known, tasks)
    clusters = components(cut(meet.select(F.col("label").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct().coalesce(tasks)))
    members = salted(meet.select("node", "label", "n", "support").distinct().coalesce(tasks), clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label", "node", "inner")
    members = cut(members.coalesce(tasks))
    release(spark)
    least = members.groupBy("cluster").agg(F.min("n").alias("least"))
    fit = F.col("support") * (den + num) >= (F.col("n") + F.col("least")) * num
    more = cut(_compared(_blocks(cut(salted(members, least, "cluster", "node", "inner").filter(fit).coalesce(tasks)), tasks), texts, num, den))
    if more.limit(1).count():
        labels = _joined_labels(labels, more)
    drop_stored(shared)
    drop_stored(texts)
    release(spark)
    return labels


def _texts(rows: DataFrame, salt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch, "text"):
                ids, _ = set_ids(*sets_of(texts), salt)
                yield part.filter(pa.array(ids.view(np.int64) == part.column(0).to_numpy()))

    return rows.select("node", "n", "text").mapInArrow(run, "node bigint, n bigint, text string")


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only the labels that the links connect are looked at again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    raised = components(cut(named)).toDF("_old", "_new")
    known = labels.unionByName(raised.join(labels, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_old").alias("label")))
    changed = raised.filter("_old <> _new").withColumnRenamed("_old", "label")
    return cut(salted(known, changed, "label", "node").select("node", F.coalesce("_new", "label").alias("label")))


def _unconnected(shared: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """The members of groups in which sets of ``known`` (node, label, ...) are in several components, and the group's
    ``least`` label."""
    members = shared.join(known, "node").coalesce(tasks)
    groups = members.groupBy("gid").agg(F.min("label").alias("least"), F.max("label").alias("_hi")).filter("least <> _hi").select("gid", "least")
    return cut(members.join(groups, "gid").coalesce(tasks))
