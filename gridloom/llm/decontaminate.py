"""Benchmark decontamination with a stored positional inverted index.

``build_index`` writes, for every block of about 1 MB of training text, the postings of *all* its tokens:
sorted term hashes, where each term's list starts, and the positions (a gap parts the documents of a
block). The index does not depend on the test set. ``search`` takes a test set against all blocks: for each
window of test words it starts from the list of the term that is rarest in the block and intersects the other
lists, each moved by the term's offset, in order of rising frequency. Slop 0 gives exact phrases; a larger
slop lets every term stray that far from its place (proximity matches).

Blocks hold whole documents, so a match never spans blocks, no posting list is shuffled, and no source or
frequent word can make one task large. The test set is sent to the tasks in groups of at most
``GROUP_WORDS`` words; a larger test set is searched group after group.

Defined results: null or word-less texts have no words and no hits; repeated rows each get a row; items
without words match nothing; rows of the test set with a null id can hit words but are not listed; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_stored, store

WINDOW = 10
GROUP_WORDS = 2_000_000
_GAP = 64

INDEX_SCHEMA = "block bigint, doc_ids array<bigint>, doc_words array<int>, terms binary, list_starts binary, steps binary"
MATCH_SCHEMA = (
    "block bigint, ordinal int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, "
    "items array<bigint>, near_items array<bigint>"
)


def build_index(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each block; ``steps`` are differences of positions, which compress well."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        abc, at = K.alphabet("ascii"), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                w = K.words(texts, abc)
                h = K.spans_hash(texts, abc.low, w.starts, w.ends)
                place = (np.arange(len(h)) + _GAP * w.text).astype(np.int32)
                order = np.argsort(h, kind="stable")
                terms, first = np.unique(h[order], return_index=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([at], pa.int64()),
                        "doc_ids": pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                        "doc_words": pa.array([w.counts.astype(np.int32)], pa.list_(pa.int32())),
                        "terms": [terms.tobytes()],
                        "list_starts": [first.astype(np.int32).tobytes()],
                        "steps": [np.diff(place[order], prepend=np.int32(0)).astype(np.int32).tobytes()],
                    }
                )
                at += 1

    chosen = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(index, INDEX_SCHEMA)


class Windows(NamedTuple):
    """Windows of one length: their terms (numbers of the test set's terms) and items, in the order of their rarest terms."""

    terms: np.ndarray  # windows x length
    items: np.ndarray
    first: np.ndarray  # for each term: the first window of which it is the rarest; one more at the end


class TestSet(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes of the distinct terms
    windows: dict[int, Windows]


def test_windows(ids: list, texts: list[str | None], size: int = WINDOW) -> TestSet:
    """The windows of a test set, by their length; items are numbered as they come."""
    abc = K.alphabet("ascii")
    found: dict[int, tuple[list, list]] = {}
    for i, one in enumerate(texts):
        t = K.texts_of(pa.array([one], pa.large_string()))
        w = K.words(t, abc)
        h = K.spans_hash(t, abc.low, w.starts, w.ends)
        if not len(h):
            continue
        n = min(size, len(h))
        cut = np.lib.stride_tricks.sliding_window_view(h, n)
        rows, of = found.setdefault(n, ([], []))
        rows.append(cut)
        of.append(np.full(len(cut), i, np.int32))
    joined = {n: (np.concatenate(rows), np.concatenate(of)) for n, (rows, of) in found.items()}
    flat = np.concatenate([np.empty(0, np.uint64), *[rows.ravel() for rows, _ in joined.values()]])
    vocabulary, times = np.unique(flat, return_counts=True)
    out = {}
    for n, (rows, of) in joined.items():
        terms = np.searchsorted(vocabulary, rows).astype(np.int32)
        rarest = terms[np.arange(len(terms)), times[terms].argmin(1)]
        order = np.argsort(rarest, kind="stable")
        out[n] = Windows(terms[order], of[order], np.searchsorted(rarest[order], np.arange(len(vocabulary) + 1)))
    return TestSet(vocabulary, out)


def _intersect(lists: list[np.ndarray], offsets: np.ndarray, slop: int) -> np.ndarray:
    """Starts at which every list has an entry within ``slop`` of its offset; lists come rarest first."""
    base = offsets[0]
    starts = lists[0].astype(np.int64) - base
    for postings, offset in zip(lists[1:], offsets[1:]):
        if not len(starts):
            break
        want = starts + offset
        at = np.searchsorted(postings, want - slop)
        ok = at < len(postings)
        ok[ok] = postings[at[ok]] <= want[ok] + slop
        starts = starts[ok]
    return starts


def _merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1] + 1
    heads = np.flatnonzero(new)
    return first[heads], np.maximum.reduceat(reach, heads)


def search_block(block: dict, tests: TestSet, slop: int) -> list[tuple[list, set, set]]:
    """For each document of a block: merged hit spans, items matched exactly, items matched in proximity."""
    counts = np.asarray(block["doc_words"], np.int64)
    out: list[tuple[list, set, set]] = [([], set(), set()) for _ in counts]
    terms = np.frombuffer(block["terms"], np.uint64)
    if not len(terms):
        return out
    starts = np.append(np.frombuffer(block["list_starts"], np.int32), int(counts.sum()))
    places = np.cumsum(np.frombuffer(block["steps"], np.int32))
    first_place = np.cumsum(counts) - counts + _GAP * np.arange(len(counts))
    hits: list[tuple[np.ndarray, int]] = []
    few, many = (terms, tests.vocabulary) if len(terms) < len(tests.vocabulary) else (tests.vocabulary, terms)
    near_by = np.minimum(np.searchsorted(many, few), max(len(many) - 1, 0))
    same = many[near_by] == few if len(many) else np.zeros(0, bool)
    here = np.full(len(tests.vocabulary), -1, np.int64)  # where the block has each term of the test set
    if len(terms) < len(tests.vocabulary):
        here[near_by[same]] = np.flatnonzero(same)
    else:
        here[same] = near_by[same]
    present = np.flatnonzero(here >= 0)
    for n, w in tests.windows.items():
        size = w.first[present + 1] - w.first[present]
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.first[present], size)
        at = here[w.terms[rows]]
        known = (at >= 0).all(axis=1)
        if not known.any():
            continue
        at, of = at[known], w.items[rows][known]
        order = np.argsort(starts[at + 1] - starts[at], axis=1, kind="stable")
        for row, by, item in zip(at, order, of):
            lists = [places[starts[t] : starts[t + 1]] for t in row[by]]
            exact = _intersect(lists, by, 0)
            if len(exact):
                hits.append((exact, n))
                for d in np.unique(np.searchsorted(first_place, exact, side="right") - 1):
                    out[d][1].add(int(item))
            if slop and n > 1:
                near = _intersect(lists, by, slop)
                near = near[np.isin(near, exact, invert=True)] if len(near) else near
                if len(near):
                    mid = np.searchsorted(first_place, near + by[0], side="right") - 1
                    for d in np.unique(mid):
                        out[d][2].add(int(item))
    if hits:
        first = np.concatenate([p for p, _ in hits])
        last = np.concatenate([p + n - 1 for p, n in hits])
        a, b = _merge(first, last)
        doc = np.searchsorted(first_place, a, side="right") - 1
        for d, x, y in zip(doc, a - first_place[doc], b - first_place[doc]):
            out[d][0].append({"first": int(x), "last": int(y)})
    return out


def search(index: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", slop: int = 2, size: int = WINDOW) -> DataFrame:
    """A row for each indexed document: its words, hit spans (word numbers), and the ids of matching items."""
    chosen = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    chars = chosen.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(chars / 2 / GROUP_WORDS))
    # by id and text: repeated items are spread, so a group has about GROUP_WORDS words, or one longer item more
    spread = chosen.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    parts = []
    for g in range(groups):
        rows = spread.filter(F.col("group") == g).collect()
        parts.append(_search_group(index, [r["item_id"] for r in rows], [r["text"] for r in rows], slop, size))
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c))
    return both.groupBy("block", "ordinal", "doc_id", "n_words").agg(
        flat("spans").alias("spans"), F.array_distinct(flat("items")).alias("items"), F.array_distinct(flat("near_items")).alias("near_items")
    )


def _search_group(index: DataFrame, ids: list, texts: list, slop: int, size: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((ids, test_windows(ids, texts, size)))
    kept = pa.schema(
        [("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
         ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                found = search_block(block, windows, slop)
                listed = lambda s: sorted({names[i] for i in s if names[i] is not None})
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [block["block"]] * len(found),
                        "ordinal": list(range(len(found))),
                        "doc_id": block["doc_ids"],
                        "n_words": block["doc_words"],
                        "spans": [s for s, _, _ in found],
                        "items": [listed(i) for _, i, _ in found],
                        "near_items": [listed(n - i) for _, i, n in found],
                    },
                    schema=kept,
                )

    return index.mapInArrow(look, MATCH_SCHEMA)


def hit_words(spans: str = "spans") -> F.Column:
    """How many word numbers the spans cover together (they may overlap)."""
    ordered = F.sort_array(spans)
    start = F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["reach"], s["last"]).alias("reach"),
        (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["reach"] + 1) + 1)).cast("bigint").alias("n"),
    )
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, slop: int = 2) -> DataFrame:
    """Index, search and digest: one row for each row of ``documents``."""
    index = store(build_index(documents))
    found = store(search(index, benchmark, slop=slop))
    drop_stored(index)
    texts = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(texts, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )
