import random
from collections import Counter

import duckdb

from gridloom.llm import linededup as L


def brute(rows, ratio, least):
    pages, has = Counter(), Counter()
    for h, t in {(h or "", t) for _, h, t in rows if t is not None}:
        pages[h or ""] += 1
        has.update({(h or "", x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in has.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for d, h, t in rows:
        ls = [] if t is None else t.split("\n")
        ks = [x for x in ls if (h or "", x.strip(" ")) not in bad]
        out.append((d, len(ls), len(ls) - len(ks), None if t is None else "\n".join(ks)))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(2)
    lines = [f"line {i}" for i in range(30)] + ["", "  ", "Menu ", "Menu", "é"]
    out = [(i, rnd.choice(["a", "a", "b", None, ""]), "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 8)))) for i in range(120)]
    out += [(600 + i, "b", "a copied line\nanother") for i in range(90)]  # copies count once
    return out + [(500, "a", None), (501, "b", ""), (3, "a", out[3][2]), (502, "a", "Menu\n" * 500)]


def run(spark, data, **kw):
    names = ["_x", "_bad", "_at", "_row", "_host", "_line", "_key", "_way", "_page", "_text", "n_lines"]
    df = spark.createDataFrame([(d, h, t, *[1] * len(names)) for d, h, t in data], "doc_id bigint, source string, text string, " + ", ".join(f"{c} int" for c in names))
    got = L.drop_boilerplate(df, **kw)
    assert set(got.columns) == {*df.columns, "n_dropped"}
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str)


def test_brute_force(spark):
    assert run(spark, rows(), ratio=0.2, min_pages=3) == brute(rows(), 0.2, 3)


def test_join_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    assert run(spark, rows(), ratio=0.2, min_pages=3) == brute(rows(), 0.2, 3)


def test_oracle_and_empty(spark):
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, source varchar, text varchar)")
    c.executemany("insert into documents values (?,?,?)", rows())
    want = sorted([(a, b, n, t) for a, b, n, t in c.execute("select doc_id, n_lines, n_dropped, text from (" + L.ORACLE + ")").fetchall()], key=str)
    assert run(spark, rows()) == want == brute(rows(), L.RATIO, L.MIN_PAGES)
    assert run(spark, []) == []
