import hashlib
import random
import re

from pyspark.sql import Row

from gridloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(10, len(w))
        wins += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    ids.add(i)
        joined = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([Row(doc_id=a, text=b, item_id=7) for a, b in docs], "doc_id bigint, text string, item_id bigint")
    i = spark.createDataFrame([Row(item_id=a, text=b, doc_id=1) for a, b in items], "item_id bigint, text string, doc_id bigint")
    got = D.decontaminate(d, i).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=str)


def case():
    rnd = random.Random(5)
    vocab = ["Ab", "cd", "é1", "zz", "Q", "日本", "x9"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, say(rnd.choice([12, 15, 10]))) for k in range(12)] + [(20, "zz cd zz cd é1"), (21, ""), (22, None), (3, "unique words only here")]
    docs = [(k, say(rnd.choice([0, 5, 40, 200])) + ", " + (rnd.choice(items)[1] or "") + "." + say(3)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "... !!"), (5, docs[5][1]), (None, items[0][1]), (103, (items[1][1] + " ") * 300)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_groups_of_items(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(D, "GROUP_WORDS", 60)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two big three four"), (2, "one two three four"), (3, "four x x x x x one two three")], "doc_id bigint, text string")
    i = spark.createDataFrame([(9, "one two three four")], "item_id bigint, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in D.search(D.build_index(d), i, slop=1).collect()}
    assert got == {1: ([], [9]), 2: ([9], []), 3: ([], [])}
