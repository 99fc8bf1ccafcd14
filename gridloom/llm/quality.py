"""Quality classifier: random-indexing vectors pooled per document, and a two-layer network.

Random indexing. Every word has a fixed sparse ternary index vector made from its hash. A word's context vector is
the sum of the index vectors of its neighbours over *all* documents. The ``VOCABULARY`` words that most documents of the corpus hold
have a vector each; the rest, each of them rare, share ``BUCKETS`` hash classes, so the table's size is fixed. Sums are whole
numbers, so they don't depend on the order of tasks. Shapes of tokens (case, length, first and last characters) have index
vectors only. A document's input is the mean of its words' context vectors, the mean of its shapes' index vectors, both means'
lengths (a repeated word doesn't average out) and its log length.

Network. One hidden layer of ``HIDDEN`` units, fitted by Adam on a bounded labelled sample; the temperature is the one
with the least log loss on a fifth of the sample that the weights haven't seen.

Defined results: null, empty and blank texts have zero vectors; repeated rows get a row each; without learnable
labels all scores are the sample's share of 1 (0.5 if there is none); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_mod, drop_stored
from .sample import SAMPLE_ROWS, labelled_sample

VOCABULARY, BUCKETS, DIM, REACH = 32_768, 8192, 32, 2
#: Words that a task holds while it counts; beyond, it sends what it has and begins anew.
HELD_WORDS = 1 << 20
HIDDEN, EPOCHS, BATCH, STEP = 32, 25, 256, 3e-3
THRESHOLD = 0.3
HELD_OUT = (5, 0)
_ABC = K.alphabet("space")
_KEEP_CASE = np.arange(256, dtype=np.uint8)
INPUTS = 2 * DIM + 3


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the vocabulary
    vectors: np.ndarray  # a row for each of them, then BUCKETS more
    mean: np.ndarray
    sd: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four places and signs of each hash's index vector."""
    shifts = np.array([0, 6, 12, 18], np.uint64)[:, None]
    place = ((h[None, :] >> shifts) & np.uint64(DIM - 1)).astype(np.int64)
    sign = 1 - 2 * ((h[None, :] >> (shifts + np.uint64(5))) & np.uint64(1)).astype(np.int64)
    return place, sign


def rows_of(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each word's row of the table: its own, or its hash class."""
    rare = len(words) + (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    if not len(words):
        return rare
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, rare)


def tokens(texts: K.Texts) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words, their hashes (lower case) and the hashes of their shapes."""
    w = K.words(texts, _ABC)
    h = K.spans_hash(texts, _ABC.low, w.starts, w.ends)
    kind = np.zeros(256, np.uint8)  # letters 0 and 1 by case, digits 2, else the character itself
    kind[:128] = np.arange(128)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    if not len(h):
        return w, h, h
    size = w.ends - w.starts
    d = texts.data
    shape = np.minimum(size, 15).astype(np.uint64)
    for at in (w.starts, np.minimum(w.starts + 1, w.ends - 1), np.maximum(w.ends - 2, w.starts), w.ends - 1):
        shape = shape * np.uint64(257) + kind[d[at]].astype(np.uint64)
    return w, h, K.mix(shape)


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """The hashes of the ``size`` words that most documents hold (ties: the smaller hash), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def send() -> pa.RecordBatch:
            words, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], names=["word", "n"])

        for batch in batches:
            for _, texts in K.chunks(batch, "text"):
                w, h, _ = tokens(texts)
                if len(h):
                    held.append(K.distinct_by_text(h, w.text, len(texts))[0])
                    n += len(held[-1])
                if n >= HELD_WORDS:
                    yield send()
                    held, n = [], 0
        if n:
            yield send()

    counts = documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counts.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column(0).to_numpy()
    return np.sort(chosen.astype(np.int64).view(np.uint64))


def context_counts(w: K.Words, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Summed neighbours' index vectors by row of the table."""
    rows = len(words) + BUCKETS
    out = np.zeros(rows * DIM, np.int64)
    place, sign = index_places(h)
    row = rows_of(h, words) * DIM
    for step in range(1, REACH + 1):
        near = w.text[:-step] == w.text[step:]
        for a, b in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
            for j in range(4):
                at = (row[a] + place[j][b])[near]
                np.add.at(out, at, sign[j][b][near])
    return out


def word_vectors(documents: DataFrame, words: np.ndarray) -> np.ndarray:
    """Context vectors over all documents. Each task sends the rows it used once, packed; the driver gets the table."""
    shared = documents.sparkSession.sparkContext.broadcast(words)
    rows = len(words) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * DIM, np.int64)
        for batch in batches:
            for _, texts in K.chunks(batch, "text"):
                w, h, _ = tokens(texts)
                if len(h) > REACH:
                    total += context_counts(w, h, shared.value)
        table = total.reshape(rows, DIM)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, j]) for j in range(DIM))], names=["row", *(f"v{j}" for j in range(DIM))])

    columns = [f"v{j}" for j in range(DIM)]
    parts = documents.select("text").mapInArrow(run, "row bigint, " + ", ".join(f"{c} bigint" for c in columns))
    got = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # at most VOCABULARY + BUCKETS rows
    out = np.zeros((rows, DIM))
    at = got.column("row").to_numpy()
    for j, c in enumerate(columns):
        out[at, j] = got.column(c).to_numpy()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts: K.Texts, words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    w, h, shape = tokens(texts)
    n = len(texts)
    out = np.zeros((n, INPUTS))
    if len(h):
        count = np.maximum(w.counts, 1)[:, None]
        # rows of the table per document instead of words: repeated words are summed as counts
        key, times = np.unique(w.text * len(vectors) + rows_of(h, words), return_counts=True)
        doc = key // len(vectors)
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        sums = np.add.reduceat(vectors[key % len(vectors)].astype(float) * times[:, None], heads, axis=0)
        out[doc[heads], :DIM] = sums
        place, sign = index_places(shape)
        marks = np.bincount((w.text * DIM + place).ravel(), weights=sign.ravel(), minlength=n * DIM).reshape(n, DIM)
        out[:, DIM : 2 * DIM] = marks / 2
        out[:, : 2 * DIM] /= count
    out[:, 2 * DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, 2 * DIM + 1] = np.linalg.norm(out[:, DIM : 2 * DIM], axis=1)
    out[:, 2 * DIM + 2] = np.log1p(w.counts)
    return out


def forward(x: np.ndarray, m: Model) -> np.ndarray:
    hidden = np.maximum((x - m.mean) / m.sd @ m.w1 + m.b1, 0)
    return hidden @ m.w2 + m.b2


def probability(x: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(forward(x, m) / m.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, words: np.ndarray, vectors: np.ndarray, seed: int = 7) -> Model:
    rnd = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    mean, sd = (x.mean(0), x.std(0) + 1e-6) if len(y) else (np.zeros(INPUTS), np.ones(INPUTS))
    flat = Model(words, vectors, mean, sd, np.zeros((INPUTS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1.0)
    if share in (0.0, 1.0) or len(y) < 20:
        return flat
    order = rnd.permutation(len(y))
    check, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / sd
    p = [rnd.normal(0, np.sqrt(2 / INPUTS), (INPUTS, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rnd.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            rows = learn[at : at + BATCH]
            a, b = z[rows], y[rows]
            pre = a @ p[0] + p[1]
            hid = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - b) / len(rows)
            back = np.outer(err, p[2]) * (pre > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), hid.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                p[i] = p[i] - STEP * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    made = Model(words, vectors, mean, sd, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits = forward(x[check], made)
    loss = lambda temp: float(np.logaddexp(0, np.where(y[check] > 0, -1, 1) * logits / temp).mean())
    return made._replace(temperature=float(min(np.geomspace(0.25, 8, 60), key=loss)))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    words = vocabulary(documents)
    vectors = word_vectors(documents, words)
    sample = labelled_sample(documents, labels, "quality", *HELD_OUT, rows)
    shared = documents.sparkSession.sparkContext.broadcast((words, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch, "text"):
                x = pooled(texts, *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sample.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, x array<double>").orderBy("doc_id").collect()  # at most ``rows`` rows
    drop_stored(sample)
    x = np.array([r["x"] for r in got]).reshape(len(got), INPUTS)
    return train(x, np.array([r["label"] for r in got], float), words, vectors)


def score_documents(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in K.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probability(pooled(texts, m.words, m.vectors), m))], names=["doc_id", "score"])

    scored = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")
    held = F.coalesce(crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
