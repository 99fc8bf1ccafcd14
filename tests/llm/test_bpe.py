import base64
import hashlib
import random
import time

import pytest

from gridloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def raw():
    with open(bpe.default_ranks(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHA = list("abcdeéèßñ日本語한국 \n\t'!#123٣²Ⅷ\xa0​😀👍🏽\x1c_-") + ["the", "ing", " of", "    ", "aaaa", "'s", "　 "]


def test_equals_the_library(raw, library):
    enc, rnd = bpe.encoder(raw, P.PATTERN), random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, 40)))
        assert enc.encode(t) == library.encode_ordinary(t), t
    for t in ("a" * 3000, " " * 2000 + "x", "\n" * 999, "=-" * 2000, "<|endoftext|>"):
        assert enc.encode(t) == library.encode_ordinary(t)


def test_small_caches_change_nothing(raw, library, monkeypatch):
    for name in ("MAX_STATES", "MAX_PIECES", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, name, 20)
    enc, rnd = bpe.Encoder(raw, P.PATTERN), random.Random(4)
    for _ in range(300):
        t = " ".join("".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, 12))) for _ in range(9))
        assert enc.encode(t) == library.encode_ordinary(t)


def test_stream_decoder_cuts_anywhere():
    table = {i: bytes((i,)) for i in range(256)}
    for data in ("aé日😀z€".encode() * 3, b"\xff\xc3(\xe2\x82", bytes(range(256)), "😀".encode()[:3]):
        for size in (1, 2, 3, 5):
            d = bpe.StreamDecoder(table)
            got = "".join(d.feed(data[i : i + size]) for i in range(0, len(data), size)) + d.close()
            assert got == data.decode("utf-8", "replace")


def test_round_trip_query(spark, library):
    texts = ["Hello  world", None, "", "日本 été\n\n x " * 500, "Hello  world", "\\ </turn>"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert None in got
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "x"}
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_long_texts_without_blanks_take_linear_time(raw, library):
    rnd = random.Random(9)
    for kind in ("abcdefghijklmnopqrstuvwxyz", "ab-cd-ef", "日本語の文章"):
        enc, spent = bpe.Encoder(raw, P.PATTERN), []
        enc.encode("".join(rnd.choice(kind) for _ in range(50_000)))  # states are made
        for n in (50_000, 400_000):
            t = "".join(rnd.choice(kind) for _ in range(n))
            began = time.process_time()
            ids = enc.encode(t)
            spent.append(time.process_time() - began)
        assert spent[1] < 16 * spent[0] + 1, (kind, spent)
        assert bytes(b"".join(enc.transducer.bytes_of[i] for i in ids)).decode() == t
        t = t[:20_000]
        assert enc.encode(t) == library.encode_ordinary(t)
