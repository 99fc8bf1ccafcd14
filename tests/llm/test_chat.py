import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from gridloom.llm import chat as C
from gridloom.llm import kernels as K

SHARP = st.lists(st.sampled_from([*"a\\#<>/ \nturnblhé😀", "</turn>", "### ", "\\b", "</turn>\n"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(SHARP, SHARP), min_size=1, max_size=5))
def test_assembly_is_read_back(turns):
    texts = [K.texts_of(pa.array([t[i] for t in turns])) for i in (0, 1)]
    out, starts, first, end = C.assemble(*texts)
    assert C.parse(out.tobytes().decode()) == turns
    for i, (_, text) in enumerate(turns):
        assert C.unescape(out[first[i] : end[i]].tobytes()).decode() == text


def brute(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests(spark, monkeypatch):
    rnd = random.Random(1)
    say = lambda: "".join(rnd.choice(["a", "é", "\\", "</turn>", "### ", "\n", " "]) for _ in range(rnd.randint(0, 30)))
    rows = [(c, t, ["user", "assistant", "sys\ntem"][t % 3], say()) for c in range(30) for t in range(rnd.randint(1, 9))]
    rows += [(1, None, None, None), (None, 0, "assistant", "x"), (None, 1, "user", None), (2, 0, "user", "dup"), (2, 0, "user", "dup")]
    rows += [(99, t, "assistant", "long " * 40000) for t in range(30)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    parts = C.format_conversations(C.with_probe(df))
    got = {r.conv_id: r for r in C.read_back(parts).collect()}
    want = brute(rows + [(C.PROBE_ID, 0, "user", C.PROBE_TEXT), (C.PROBE_ID, 1, "assistant", C.PROBE_TEXT)])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    lengths = {}
    for r in parts.collect():
        lengths[r.conv_id] = lengths.get(r.conv_id, 0) + len(r.formatted)
    assert lengths == {c: r.formatted_chars for c, r in got.items()}
    assert max(r.part for r in parts.collect()) > 0


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.read_back(C.format_conversations(df)).count() == 0
