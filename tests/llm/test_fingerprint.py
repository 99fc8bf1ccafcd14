import hashlib
import math
import random
import re
import struct
from collections import Counter

import xxhash

from gridloom.llm import fingerprint as P


def words(t):
    return Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)


def similarity(a, b):
    wa, wb = ({k: 1 + math.log(v) for k, v in words(t).items()} for t in (a, b))
    keys = wa.keys() | wb.keys()
    return sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys) if keys else 1.0


def brute_edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, follow = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), t[: len(t) - half] + follow[:half], follow)
    return out


def spark_hash(x, seed=42):
    raw = x if isinstance(x, bytes) else struct.pack("<q" if abs(x) >= 1 << 31 else "<i", x)
    return xxhash.xxh64_intdigest(raw, seed=seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_print(t):
    """The scheme in plain Python: the least price of each bin."""
    best = {}
    for w, n in words(t).items():
        term, weight = spark_hash(w.encode()), 1 + math.log(n)
        for u in range(math.ceil(weight)):
            part = spark_hash(struct.pack("<i", u), spark_hash(struct.pack("<Q", term))) if u else term
            g, k, b = (spark_hash(struct.pack("<i", i), spark_hash(struct.pack("<Q", part))) for i in (1, 2, 3))
            uni = lambda bits: (bits + 0.5) / 2**32
            r, c, beta = -math.log(uni(g & 0xFFFFFFFF) * uni(g >> 32)), -math.log(uni(k & 0xFFFFFFFF) * uni(k >> 32)), uni(b & 0xFFFFFFFF)
            at = math.floor(math.log(min(1.0, weight - u)) / r + beta)
            tag = spark_hash(struct.pack("<q", at), spark_hash(struct.pack("<Q", part))) & 0xFFFFFF
            offer = (math.log(c) - r * (at - beta) - r, tag)
            place = signed(part) % P.BINS
            best[place] = min(best.get(place, offer), offer)
    return "".join(f"{place << 24 | best[place][1]:08x}" for place in sorted(best))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, _range int")
    return P.fingerprint_documents(df).collect()


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)] + ["été", "日本", "x😀"]
    say = lambda n: " ".join(vocab[int(rnd.random() ** 2 * len(vocab))] for _ in range(n))
    rows = [(i * 5 - 20, say(rnd.choice([1, 5, 400, 900, 900]))) for i in range(60)]
    return rows + [(1000, None), (1001, ""), (1002, "..."), (1003, rows[4][1]), (1004, "word " * 4000)]


def test_edits_and_estimates(spark):
    rows = corpus()
    want, got = brute_edits(rows), run(spark, rows)
    assert len(got) == len(rows)
    texts, off = {d: t or "" for d, t in rows}, []
    for r in got:
        n, edited, follow = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(texts[r.doc_id]), brute_print(edited))
        for got_one, other in ((r.near_edited, edited), (r.near_next, follow)):
            filled = len({*re.findall("(..)......", brute_print(texts[r.doc_id])), *re.findall("(..)......", brute_print(other))})
            if filled >= 5:
                want_one = similarity(texts[r.doc_id], other)
                error = math.sqrt(max(want_one * (1 - want_one), 0.01) / filled)
                assert abs(got_one - want_one) < 4 * error + 0.02
                off.append(got_one - want_one)
    assert abs(sum(off) / len(off)) < 0.02
    by = {r.doc_id: r for r in got}
    assert by[1003].fingerprint == by[rows[4][0]].fingerprint != ""
    assert by[1000].fingerprint == by[1002].fingerprint == ""
    assert abs(by[1004].near_edited - similarity(texts[1004], want[1004][1])) < 0.1


def test_ranges_of_frequent_and_missing_ids(spark, monkeypatch):
    """The next row in the order (id descending, missing ones last, hash of the text) even where one id has most rows."""
    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(200)] + [(None, f"none {i}") for i in range(150)] + [(-5, "low")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranged = P.with_next(df, 16).collect()
    sizes = Counter(r._range for r in ranged if not r._halo)
    assert len(sizes) > 16 and max(sizes.values()) < 60
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(spark_hash(r[1].encode()))))
    follow = {order[i]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    got = P.fingerprint_documents(df).collect()
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + follow[d, t][: len(t) // 2]).encode()).hexdigest() for d, t in rows)
    assert Counter(r.edited_sha256 for r in got) == want


def test_single_repeated_and_empty(spark):
    (one,) = run(spark, [(3, "abcd efgh")])
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    got = run(spark, [(None, "x y"), (2, "same text"), (2, "same text"), (None, "x y")])
    assert len(got) == 4
    assert run(spark, []) == []
