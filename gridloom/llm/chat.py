"""Chat formatting by columnar byte assembly.

A turn becomes ``### role`` and a line end, the text, ``</turn>`` and a line end. Inside roles and texts a
backslash is written ``\\b``, the ``#`` of ``### `` is ``\\h``, the ``<`` of ``</turn>`` is ``\\l``, and a line end in
a role is ``\\n``; so control strings never occur inside, every backslash begins one of these pairs, and reading is
exact. The loss mask are the byte spans of the assistant's texts.

Assembly works on slices of about ``PART_BYTES``: numpy finds the bytes to escape, sums segment lengths to
offsets, and scatters headers, roles and texts into one preallocated buffer that becomes the Arrow column. Rows come
sorted by conversation and turn from Spark's spilling sort; a conversation longer than a slice comes out as several
parts in order, so memory doesn't grow with a conversation.

Defined results: turns are ordered by turn, role and text, nulls first; repeated rows are turns each; a null text
or role is empty; rows with a null conversation id form one conversation; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PART_BYTES = 1 << 20
HEAD, MID, TAIL = (np.frombuffer(x, np.uint8) for x in (b"### ", b"\n", b"</turn>\n"))
_CLOSE, _OPEN = b"</turn>", b"### "
PARTS = "conv_id bigint, part int, n_turns int, formatted string, mask array<struct<first:int,end:int>>"


def _at(data: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Where ``what`` begins, inside one text."""
    n = len(data) - len(what) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = data[:n] == what[0]
    for i, b in enumerate(what[1:], 1):
        hit &= data[i : n + i] == b
    at = np.flatnonzero(hit)
    return at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(what) - 1, side="right")]


def escape(texts: K.Texts, role: bool = False) -> K.Texts:
    """Each special byte becomes a backslash and a letter."""
    data, offsets = texts
    codes = np.zeros(len(data), np.uint8)
    codes[_at(data, offsets, _CLOSE)] = ord("l")
    codes[_at(data, offsets, _OPEN)] = ord("h")
    codes[data == 92] = ord("b")
    if role:
        codes[data == 10] = ord("n")
    special = codes > 0
    if not special.any():
        return texts
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(special, out=moved[1:])
    out = np.empty(len(data) + int(moved[-1]), np.uint8)
    to = np.arange(len(data)) + moved[:-1]
    out[to] = np.where(special, 92, data)
    out[to[special] + 1] = codes[special]
    return K.Texts(out, offsets + moved[offsets])


_PAIR = re.compile(rb"\\([blhn])")
_MEANS = {b"b": b"\\", b"l": b"<", b"h": b"#", b"n": b"\n"}


def unescape(data: bytes) -> bytes:
    return _PAIR.sub(lambda m: _MEANS[m[1]], data) if b"\\" in data else data


def assemble(roles: K.Texts, texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, where each turn starts in it (one more than turns), and where each text starts and ends."""
    r, t = escape(roles, role=True), escape(texts)
    role_len, text_len = np.diff(r.offsets), np.diff(t.offsets)
    starts = np.zeros(len(role_len) + 1, np.int64)
    np.cumsum(len(HEAD) + role_len + len(MID) + text_len + len(TAIL), out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    at_role = starts[:-1] + len(HEAD)
    at_mid = at_role + role_len
    at_text = at_mid + len(MID)
    at_tail = at_text + text_len
    for at, fixed in ((starts[:-1], HEAD), (at_mid, MID), (at_tail, TAIL)):
        out[at[:, None] + np.arange(len(fixed))] = fixed
    for at, piece, size in ((at_role, r, role_len), (at_text, t, text_len)):
        out[np.repeat(at - piece.offsets[:-1], size) + np.arange(len(piece.data))] = piece.data
    return out, starts, at_text, at_tail


#: What the offsets of a string array can count.
MOST_BYTES = (1 << 31) - 1


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: object = ()
    part = 0
    for batch in batches:
        for rows, texts in K.chunks(batch, "text", PART_BYTES):
            ids, role = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            out, starts, first, end = assemble(K.texts_of(rows.column(1)), texts)
            cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            parts, masks = [], []
            for a, b in zip(cuts, cuts[1:]):
                part = part + 1 if ids[a] == last else 0
                last = ids[a]
                parts.append(part)
                masks.append([{"first": int(first[i] - starts[a]), "end": int(end[i] - starts[a])} for i in range(a, b) if role[i] == "assistant"])
            if len(out) > MOST_BYTES:
                raise ValueError("a turn of more than 2 GiB once its control strings are escaped")
            offsets = starts[cuts].astype(np.int32)
            formatted = pa.Array.from_buffers(pa.utf8(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a in cuts[:-1]], pa.int64()),
                    pa.array(parts, pa.int32()),
                    pa.array(np.diff(cuts), pa.int32()),
                    formatted,
                    pa.array(masks, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "mask"],
            )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, formatted, mask``; the parts of a conversation are neighbours, in order."""
    chosen = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    ordered = chosen.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted part."""
    turns = []
    *each, rest = formatted.encode().split(b"</turn>\n")
    if rest:
        raise ValueError("a turn isn't closed")
    for turn in each:
        if not turn.startswith(b"### "):
            raise ValueError("a turn has no header")
        role, _, text = turn[4:].partition(b"\n")
        turns.append((unescape(role).decode(), unescape(text).decode()))
    return turns


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, mask: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        data = formatted.encode()
        for span in mask:
            said = unescape(data[span["first"] : span["end"]])
            self.loss.update(said)
            self.loss_chars += len(said.decode())
        self.chars += len(formatted)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(parts: DataFrame) -> DataFrame:
    """A row of digests for each conversation, from the formatted text and the mask alone. Takes what
    ``format_conversations`` returns; a stored copy must first be sorted by conv_id and part within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["part"] == 0:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(row["conv_id"])
                now.add(row["formatted"], row["mask"])
            if done:
                yield pa.RecordBatch.from_pylist(done, _READ)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], _READ)

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts hold a backslash and control strings."""
    rows = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
