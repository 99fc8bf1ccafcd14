"""Columnar byte kernels: words and their 64-bit hashes straight from Arrow string buffers.

Everything here works on one chunk of texts: the concatenated UTF-8 bytes and the offsets of the
texts in them. No Python string is made. Chunks are cut by bytes (``CHUNK_BYTES``), so memory is
bounded by the chunk or by the single longest text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_P = 0xDA942042E4DD58B5 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 65536)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        made = np.multiply.accumulate(out)
        if size > 8 * CHUNK_BYTES:
            return made
        have = _powers[name] = made
    return have[:n]


#: What operators keep in a worker for its next tasks: each adds a dict that forget() may empty.
KEPT: list[dict] = []


def forget() -> None:
    """Operators that need much memory call this in their tasks: workers that did another one's work before give back
    what they keep for it."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


class Alphabet(NamedTuple):
    """Which bytes belong to words, and what each byte counts as (lower case)."""

    is_word: np.ndarray
    low: np.ndarray


def alphabet(separators: str) -> Alphabet:
    """``separators``: 'ascii' keeps digits, letters and all bytes of non-ASCII characters; 'space' splits at
    blanks and the control characters 9 to 13 only. Both count A-Z as a-z."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.ones(256, dtype=bool)
    if separators == "ascii":
        word[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            word[a:b] = True
    else:
        word[[32, 9, 10, 11, 12, 13]] = False
    return Alphabet(word, low)


class Texts(NamedTuple):
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """Nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    whole = texts_of(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(whole)
    while at < n:
        to = int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at), Texts(whole.data[whole.offsets[at] : whole.offsets[to]], whole.offsets[at : to + 1] - whole.offsets[at])
        at = to


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # which text each word is of
    counts: np.ndarray  # words in each text


def words(texts: Texts, abc: Alphabet) -> Words:
    n = len(texts.data)
    if n == 0:
        z = np.empty(0, np.int64)
        return Words(z, z, z, np.zeros(len(texts), np.int64))
    inside = abc.is_word[texts.data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    heads = texts.offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    tails = texts.offsets[1:] - 1
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(texts.offsets, starts, side="right") - 1
    return Words(starts, ends, text, np.bincount(text, minlength=len(texts)).astype(np.int64))


def spans_hash(texts: Texts, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by differences of one running polynomial."""
    n = len(texts.data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low][texts.data] * _power("p", _P, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("i", _PINV, n + 1)[starts])


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes (equal lengths, one array for each place)."""
    out = np.zeros_like(hashes[0])
    for x in hashes:
        out = out * _U(_P) + x
    return mix(out)


def shingles(word_hash: np.ndarray, w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the text of each; a text of fewer words, but not none, has one: all its words."""
    out, where = [], []
    if len(word_hash) >= k:
        same = w.text[: len(w.text) - k + 1] == w.text[k - 1 :]
        at = np.flatnonzero(same)
        if len(at):
            out.append(chain([word_hash[at + i] for i in range(k)]))
            where.append(w.text[at])
    first = np.cumsum(w.counts) - w.counts
    for size in range(1, k):
        of = np.flatnonzero(w.counts == size)
        if len(of):
            out.append(mix(chain([word_hash[first[of] + i] for i in range(size)]) + _U(size)))
            where.append(of)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(where)


#: Texts with more hashes are sorted one by one, which is much faster than by two keys; of shorter ones there may be too many.
LONG = 64


def distinct_by_text(hashes: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted by text and hash, with the offsets of the texts."""
    if (where[1:] < where[:-1]).any():
        order = np.argsort(where, kind="stable")
        h, t = hashes[order], where[order]
    else:
        h, t = hashes.copy(), where
    size = np.bincount(t, minlength=n)
    ends = np.cumsum(size)
    for i in np.flatnonzero(size > LONG):
        h[ends[i] - size[i] : ends[i]].sort()
    short = np.flatnonzero((size <= LONG)[t])
    if len(short):
        h[short] = h[short[np.lexsort((h[short], t[short]))]]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[keep], t[keep]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(t, minlength=n), out=offsets[1:])
    return h, offsets
