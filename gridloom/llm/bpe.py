"""Byte-level BPE as a lazily determinised transducer, and a streaming UTF-8 decoder.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every neighbouring pair is
(each pair, merged afresh, comes out as itself). So a prefix has one last token: the one token that ends there
and fits the last token of the prefix before it. The nondeterministic transducer guesses where the token that covers the
next byte starts; the determinised one keeps all starts that are still possible: those from which the bytes read
are the beginning of some vocabulary entry. Tokens that all of them share are emitted, the rest waits with its
start, so lookahead never exceeds the longest vocabulary entry. States and transitions are made when first needed
and kept (up to ``MAX_STATES``); stretches of text seen before are answered from tables of at most ``MAX_PIECES``.

Decoding. Token bytes are joined in slices; a state machine over the last bytes of a slice tells whether a
character is unfinished, and holds it back for the next slice.

Defined results: null and empty texts have no tokens; texts of any length are read whole; repeated rows each get a
row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MAX_STATES = 250_000
MAX_PIECES = 120_000
MAX_PAIRS = 250_000
SLICE_IDS = 1 << 16


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """Encodes pieces of bytes by ranked merges.

    A determinised state is a number; its starts are the live starts of the next token, oldest first. A start is (tokens
    not yet emitted, the token before it, node of the trie reached since); the last one's tokens are left to emit if the
    piece ends there. One table holds all transitions.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int | None = None):
        self.most_states = most_states or MAX_STATES
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._child: dict[int, int] = {}
        self._token, self._inner = [-1], [True]
        for token, rank in ranks.items():
            self._plant(token, rank)
        self._pairs: dict[int, bool] = {}
        self._clear()

    def _plant(self, token: bytes, rank: int) -> None:
        node = 0
        for b in token:
            self._inner[node] = True
            to = self._child.get(node << 8 | b)
            if to is None:
                to = self._child[node << 8 | b] = len(self._token)
                self._token.append(-1)
                self._inner.append(False)
            node = to
        self._token[node] = rank

    def _clear(self) -> None:
        self.starts: list[tuple] = []
        self.states: dict[tuple, int] = {}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state and byte
        self._state((((), -1, 0),))

    def _state(self, starts: tuple) -> int:
        made = self.states.get(starts)
        if made is None:
            made = self.states[starts] = len(self.starts)
            self.starts.append(starts)
        return made

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none can be merged."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                return [self.ranks[p] for p in parts]
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], -1)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: nothing)."""
        pair = (a + 1) << 32 | b
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            want = [b] if a < 0 else [a, b]
            known = self._pairs[pair] = self.merged(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, token, inner = self._child.get, self._token, self._inner
        starts, found = [], None
        for waiting, before, node in self.starts[state]:
            to = child(node << 8 | byte)
            if to is None:
                continue
            t = token[to]
            if t >= 0 and found is None and self.fits(before, t):
                found = (*waiting, t)
            if inner[to]:
                starts.append((waiting, before, to))
        starts.append((found, found[-1], 0))
        first, k = starts[0][0], 0
        if first:
            k = len(first)
            for waiting, _, _ in starts[1:]:
                i = 0
                while i < k and i < len(waiting) and waiting[i] == first[i]:
                    i += 1
                k = i
        if k:
            starts = [(waiting[k:], before, node) for waiting, before, node in starts]
        got = self.next[state << 8 | byte] = (self._state(tuple(starts)), first[:k])
        return got

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > self.most_states:
            self._clear()
        state, out, known = 0, [], self.next.get
        for byte in piece:
            got = known(state << 8 | byte)
            state, emitted = got if got is not None else self._step(state, byte)
            if emitted:
                out += emitted
            if len(self.starts) > 2 * self.most_states:  # a very long piece: all states go, the present one begins anew
                starts = self.starts[state]
                self._clear()
                state, known = self._state(starts), self.next.get
        return (*out, *self.starts[state][-1][0])


#: Unicode's White_Space property (fixed values).
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Texts to ids: split by a pattern, each match through the transducer.

    With the default pattern a blank after a character that isn't white space always begins a new match, so such a
    text is looked up stretch by stretch; a stretch not seen before is split by the pattern itself.
    """

    def __init__(self, raw: bytes, pattern: str, cache: int | None = None):
        self.most = cache or MAX_PIECES
        self.transducer = Transducer(read_ranks(raw), 2 * cache if cache else None)
        self.split = regex.compile(pattern).findall
        self.by_blank = pattern == default_pattern()
        self._pairs = [w + " " for w in WHITE_SPACE]
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _pieces(self, stretch: str) -> tuple[int, ...]:
        out: list[int] = []
        known = self.pieces
        for piece in self.split(stretch):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= self.most:
                    known.clear()
                ids = self.transducer.encode(piece.encode())
                if len(piece) < 64 and len(piece) < len(stretch):  # a stretch that is one piece is kept as such
                    known[piece] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not self.by_blank or any(p in text for p in self._pairs):
            for piece in self.split(text):
                ids = self.pieces.get(piece)
                out += ids if ids is not None else self._pieces(piece)
            return out
        head, *rest = text.split(" ")
        out += self._pieces(head)
        for word in rest:
            ids = self.new.get(word)
            out += ids if ids is not None else self._missing_after_blank(word)
        return out

    def _missing_after_blank(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = self._pieces(" " + word)
        if len(word) < 64:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids


def _utf8_table() -> list[list[int]]:
    """The machine over bytes: 0 is between characters, 1 an error; the other states await continuation bytes."""
    wait1, wait2, wait3, after_e0, after_ed, after_f0, after_f4 = range(2, 9)
    cont = range(0x80, 0xC0)
    table = [[1] * 256 for _ in range(9)]
    for b in range(0x80):
        table[0][b] = 0
    for first, last, to in ((0xC2, 0xDF, wait1), (0xE0, 0xE0, after_e0), (0xE1, 0xEC, wait2), (0xED, 0xED, after_ed), (0xEE, 0xEF, wait2), (0xF0, 0xF0, after_f0), (0xF1, 0xF3, wait3), (0xF4, 0xF4, after_f4)):
        for b in range(first, last + 1):
            table[0][b] = to
    for state, allowed, to in ((wait1, cont, 0), (wait2, cont, wait1), (wait3, cont, wait2), (after_e0, range(0xA0, 0xC0), wait1), (after_ed, range(0x80, 0xA0), wait1), (after_f0, range(0x90, 0xC0), wait2), (after_f4, range(0x80, 0x90), wait2)):
        for b in allowed:
            table[state][b] = to
    return table


_UTF8 = _utf8_table()


class StreamDecoder:
    """Ids in slices to text in slices; characters cut by a slice come with the next."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.get = bytes_of.__getitem__
        self.held = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.get, ids))
        end = len(data)
        lead = end
        for i in range(end - 1, max(-1, end - 4), -1):
            if data[i] & 0xC0 != 0x80:
                lead = i
                break
        state = 0
        for b in data[lead:]:
            state = _UTF8[state][b]
        cut = lead if state > 1 else end
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_encoders: dict[bytes, Encoder] = {}
K.KEPT.append(_encoders)


def encoder(raw: bytes, pattern: str, cache: int | None = None) -> Encoder:
    key = hashlib.sha256(raw + f"{pattern} {cache}".encode()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw, pattern, cache)
    return _encoders[key]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _ranks_of(df: DataFrame, path: str | None):
    """The driver reads the file (its size is that of a vocabulary, at most a few MB) and shares it."""
    with open(path or default_ranks(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids array<int>`` for each row."""
    ranks, pat = _ranks_of(documents, path), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pat)
        for batch in batches:
            for rows, _ in K.chunks(batch, "text"):
                ids = [enc.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` for each row of ids, in slices of ``SLICE_IDS``."""
    ranks = _ranks_of(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(ranks.value, default_pattern()).transducer.bytes_of
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                texts.append("".join(_decoded(table, row or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(key).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def _decoded(table: dict[int, bytes], ids: list[int]) -> Iterator[str]:
    d = StreamDecoder(table)
    for i in range(0, len(ids), SLICE_IDS):
        yield d.feed(ids[i : i + SLICE_IDS])
    yield d.close()


def round_trip(documents: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id", with_ids: bool = False, cache: int | None = None) -> DataFrame:
    """Encode each text and decode its ids in one pass; ids and decoded bytes come back as digests (``with_ids``: the ids
    too). ``cache``: how many stretches (and twice as many states) a worker keeps, for jobs whose workers need the memory for
    other steps as well; it changes the speed, not the ids."""
    ranks, pat = _ranks_of(documents, path), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pat, cache)
        table = enc.transducer.bytes_of
        names = {i: str(i) for i in table}
        for batch in batches:
            for rows, _ in K.chunks(batch, "text"):
                n, sha_ids, sha_text, kept = [], [], [], []
                for t in rows.column(1).to_pylist():
                    ids = enc.encode(t or "")
                    back = hashlib.sha256()
                    for part in _decoded(table, ids):
                        back.update(part.encode())
                    n.append(len(ids))
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                    sha_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    sha_text.append(back.hexdigest())
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
                names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names_out.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
