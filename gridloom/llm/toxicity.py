"""Toxic passages as maximum-scoring segments of token log-odds.

Fit (on a bounded labelled sample). Words and their first 4 and 6 characters are counted once per document in toxic
and other documents; near copies (documents that share the smallest shingle hash) share the weight of one. A nested Dirichlet
prior shrinks a word's rate to its 6-character beginning's, that to the 4-character beginning's, that to the corpus
rate. A word keeps its log-odds if they stand out (``Z``); a beginning stands for words not seen before if nearly all
of its documents are toxic (``PURE``). All other words score ``-DRIFT``, so scores have a negative mean.

Search. One linear scan (Ruzzo and Tompa) finds all maximal segments. Extreme-value theory turns a segment's score S
in a text of n words into the bits ``lambda S - ln(K n)``: lambda solves sum p exp(lambda s) = 1 over
the scores of other documents. Segments with positive bits are significant passages. Their sum is calibrated to a
probability by a logistic fit on the sample.

Defined results: null, empty and word-less texts have no passages and the calibrated score of none; repeated rows get
a row each; without learnable labels all scores are 0; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_mod, drop_stored, store
from .components import salted
from .sample import SAMPLE_ROWS, labelled_sample

PRIOR, Z, PURE, SUPPORT, DRIFT = 5.0, 3.0, 0.8, 4, 0.05
#: The fit looks at so many words and beginnings at most, those in most toxic documents of the sample.
VOCABULARY = 500_000
THRESHOLD = 0.3
HELD_OUT = (4, 2)
_ABC = K.alphabet("ascii")
_LEVELS = (4, 6)


class Model(NamedTuple):
    keys: np.ndarray  # sorted hashes of words and beginnings
    scores: np.ndarray
    rate: float  # lambda
    log_k: float
    slope: float
    offset: float


def features(texts: K.Texts) -> tuple[K.Words, np.ndarray]:
    """Hashes of each word's first 4 and 6 characters and of the whole word: one row for each level."""
    w = K.words(texts, _ABC)
    first = np.flatnonzero((texts.data & 0xC0) != 0x80)
    rank = np.searchsorted(first, w.starts)
    ends = np.append(first, [len(texts.data)] * max(_LEVELS))
    out = [K.mix(K.spans_hash(texts, _ABC.low, w.starts, np.minimum(w.ends, ends[rank + n])) + np.uint64(n)) for n in _LEVELS]
    return w, np.stack([*out, K.spans_hash(texts, _ABC.low, w.starts, w.ends)]) if len(w.starts) else np.empty((3, 0), np.uint64)


def _counts(sample: DataFrame) -> DataFrame:
    """``level, feature, parent, toxic, other``: weights of the documents with each feature."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                w = K.words(texts, _ABC)
                h, of = K.shingles(K.spans_hash(texts, _ABC.low, w.starts, w.ends), w)
                least = np.full(len(texts), np.uint64(2**64 - 1))
                np.minimum.at(least, of, h)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(least.view(np.int64))], names=["doc_id", "least"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                w, f = features(texts)
                label, weight = rows.column(1).to_numpy(), rows.column(3).to_numpy()
                for level in range(3):
                    h, o = K.distinct_by_text(f[level], w.text, len(texts))
                    each, toxic = np.repeat(weight, np.diff(o)), np.repeat(label * weight, np.diff(o))
                    _, at = np.unique(f[level], return_index=True)
                    up = dict(zip(f[level][at].tolist(), (f[level - 1] if level else np.zeros_like(f[0]))[at].tolist()))
                    keys, back = np.unique(h, return_inverse=True)
                    n, t = (np.bincount(back, weights=x, minlength=len(keys)) for x in (each, toxic))
                    parent = np.array([up[k] for k in keys.tolist()], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(parent.view(np.int64)), pa.array(t), pa.array(n - t)],
                        names=["level", "feature", "parent", "toxic", "other"],
                    )

    least = sample.select("doc_id", "text").mapInArrow(copies, f"doc_id {dict(sample.dtypes)['doc_id']}, least bigint")
    weights = salted(least, least.groupBy("least").agg((1 / F.count(F.lit(1))).alias("weight")), "least", "doc_id").select("doc_id", "weight")
    weighted = sample.join(weights, "doc_id").select("doc_id", "label", "text", "weight")  # the sample has an id once
    rows = weighted.mapInArrow(count, "level int, feature bigint, parent bigint, toxic double, other double")
    return rows.groupBy("level", "feature").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def log_odds(rows: list, base: float) -> dict[int, float]:
    """Scores by feature. ``rows``: (level, feature, parent, toxic, other) of features with enough toxic documents."""
    rate: list[dict[int, float]] = [{}, {}, {}]
    out: dict[int, float] = {}
    for level, feature, parent, toxic, other in sorted(rows):
        prior = base if level == 0 else rate[level - 1].get(parent, base)
        p = (toxic + PRIOR * prior) / (toxic + other + PRIOR)
        rate[level][feature] = p
        sd = math.sqrt(1 / (toxic + PRIOR * base) + 1 / (other + PRIOR * (1 - base)))
        score = _logit(p) - _logit(base)
        if score / sd >= Z and (level == 2 or p >= PURE):
            out[feature] = score
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), by Ruzzo and Tompa's linear scan.

    An open segment links to the last one before it that starts from a smaller sum; the search for a later one's link
    follows those links and passes each open segment once, so the scan is linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum through, link
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            first, before, through = i, total, total + s
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            while j >= 0 and found[j][3] < through:  # joined with all from there on
                first, _, before, _, link = found[j]
                del found[j:]
                j = link
            found.append((first, i + 1, before, through, j))
        total += s
    return [(a, b, d - c) for a, b, c, d, _ in found]


def token_scores(f: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Each word's score: its own, else its longest known beginning's, else 0."""
    out = np.zeros(f.shape[1])
    if len(keys):
        for level in range(3):
            at = np.minimum(np.searchsorted(keys, f[level]), len(keys) - 1)
            hit = keys[at] == f[level]
            out[hit] = scores[at[hit]]
    return out


def passages(texts: K.Texts, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """The words of each text, and its significant passages (first word, last word, bits)."""
    w, f = features(texts)
    s = token_scores(f, model.keys, model.scores)
    hot = np.flatnonzero(s > 0)
    out: list[list[tuple[int, int, float]]] = [[] for _ in w.counts]
    first = np.cumsum(w.counts) - w.counts
    ends = np.append(np.flatnonzero(np.diff(w.text[hot])) + 1, len(hot)) if len(hot) else []
    at = 0
    for end in ends:
        places = hot[at:end]
        doc = int(w.text[places[0]])
        n = int(w.counts[doc])
        # the words between two scoring words are one step down
        line = [float(s[places[0]])]
        for a, b in zip(places[:-1], places[1:]):
            line += [-DRIFT * float(b - a - 1), float(s[b])]
        for a, b, score in segments(line):
            bits = model.rate * score - model.log_k - math.log(n)
            if bits > 0:
                out[doc].append((int(places[a // 2] - first[doc]), int(places[(b - 1) // 2] - first[doc]), bits))
        at = end
    return w.counts, out


def _karlin(scores: np.ndarray, counts: np.ndarray, words: float) -> tuple[float, float]:
    """lambda and ln K for other documents: ``counts`` of each score among ``words`` words."""
    p = (counts + 0.5 / max(1, len(scores))) / (words + 0.5)
    rest = 1 - p.sum()
    low, high = 0.0, 1.0
    grow = lambda x: float((p * np.exp(x * scores)).sum() + rest * math.exp(-DRIFT * x)) - 1
    while grow(high) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    mean = float((p * scores).sum() - rest * DRIFT)
    drift = float((p * scores * np.exp(low * scores)).sum() - rest * DRIFT * math.exp(-DRIFT * low))
    return low, math.log(max(1e-12, mean * mean / max(drift, 1e-12) * low)) if low > 0 else 0.0


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(documents, labels, "toxic", *HELD_OUT, rows)
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    empty = Model(np.empty(0, np.uint64), np.empty(0), 1.0, 0.0, 0.0, -math.inf)
    if not toxic or not other:
        return empty
    base = toxic / (toxic + other)
    table = _counts(sample).filter(F.col("toxic") >= SUPPORT).orderBy(F.desc("toxic"), "level", "feature").limit(VOCABULARY).collect()
    odds = log_odds([tuple(r) for r in table], base)
    if not odds:
        return empty
    keys = np.array(sorted(k % (1 << 64) for k in odds), np.uint64)
    scores = np.array([odds[int(k)] for k in keys.view(np.int64)])
    rough = Model(keys, scores, 1.0, 0.0, 0.0, 0.0)

    def nulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other documents: words, and how often each score of the table occurs."""
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                w, f = features(texts)
                label = rows.column(1).to_numpy()
                s = token_scores(f, keys, scores)[label[w.text] == 0]
                values, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["score", "n"])

    seen = {r["score"]: r["n"] for r in sample.select("doc_id", "label", "text").mapInArrow(nulls, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    values = np.unique(scores)
    rate, log_k = _karlin(values, np.array([seen.get(float(v), 0) for v in values], float), float(sum(seen.values())))
    rough = rough._replace(rate=rate, log_k=log_k)
    evidence = score_rows(sample, rough, ["label"]).select("label", "evidence").collect()  # at most ``rows`` rows
    x, y = np.array([math.log1p(r["evidence"]) for r in evidence]), np.array([r["label"] for r in evidence], float)
    slope, offset = _logistic(x, y)
    drop_stored(sample)
    return rough._replace(slope=slope, offset=offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge, so separable samples have a finite fit."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * beta
        beta = beta + np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-3 * np.eye(2), grad)
    return float(beta[0]), float(beta[1])


_SPANS = "array<struct<first:int,last:int,bits:double>>"


def score_rows(documents: DataFrame, model: Model, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``doc_id``, the columns ``keep``, ``score, evidence, passages`` (word numbers) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                _, found = passages(texts, m)
                evidence = np.array([sum(b for _, _, b in p) for p in found], float)
                score = 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(evidence) + m.offset, -700, 700)))
                if m.offset == -math.inf:
                    score = np.zeros(len(found))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep) + 1)), pa.array(score), pa.array(evidence), pa.array([[{"first": a, "last": b, "bits": c} for a, b, c in p] for p in found], spans)],
                    names=["doc_id", *keep, "score", "evidence", "passages"],
                )

    chosen = documents.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c in keep)
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {kept + ', ' if kept else ''}score double, evidence double, passages {_SPANS}")


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, that score under ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, texts in K.chunks(batch, "text"):
                if m.offset == -math.inf:
                    yield rows
                    continue
                evidence = np.array([sum(b for _, _, b in p) for p in passages(texts, m)[1]], float)
                score = 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(evidence) + m.offset, -700, 700)))
                yield rows.filter(pa.array(score < threshold))

    return documents.mapInArrow(run, documents.schema)


def score_documents(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` for each row of ``documents``."""
    scored = score_rows(documents, fit(documents, labels, rows))
    held = F.coalesce(crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
