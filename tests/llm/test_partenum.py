import random
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import partenum as E
from gridloom.llm.components import components, salted, smallest


def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, num=80, den=100):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed, n=90, long=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    line = " ".join(rnd.choice(vocab) for _ in range(14))
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                if w:
                    i = rnd.randrange(len(w))
                    w[i : i + rnd.choice([0, 1, 1])] = [rnd.choice(vocab)]
            texts.append(" ".join(w))
        else:
            body = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([2, 6, 9, 15, long, long])))
            texts.append(f"{line} {body}" if rnd.random() < 0.5 else body)
    return texts


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, node int, n int")
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in E.link_components(df).collect()], key=str)


def test_against_brute_force(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(1))]
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (None, rows[3][1]), (1003, rows[3][1].upper()), (4, "another text of this id here"), (1004, "a B"), (1005, "A b"), (1006, "b")]
    assert run(spark, rows) == brute(rows)


def test_small_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_FEATURES", 300)
    monkeypatch.setattr(E, "FLUSH", 500)
    rows = list(enumerate(corpus(2, 60)))
    assert run(spark, rows) == brute(rows)


def test_group_of_copies_that_link_in_part(spark, monkeypatch):
    """Copies of one text with up to nine edits: some link with the original, some with each other, some with none."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(10)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert 10 < len({c for *_, c in want}) < 140
    assert run(spark, rows) == want
    monkeypatch.setattr(E, "BLOCK_FEATURES", 2000)
    assert run(spark, rows) == want


def test_forest_against_all_pairs(monkeypatch):
    rnd = np.random.default_rng(5)
    for cells in (1 << 22, 60):
        monkeypatch.setattr(E, "CELLS", cells)
        sets = [np.unique(rnd.integers(0, 60, 40)).astype(np.uint64) for _ in range(12)]
        sets += [np.unique(np.append(rnd.choice(s, len(s) - 3, replace=False), rnd.integers(60, 70, 2).astype(np.uint64))) for s in sets * 9]
        h, o = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        label = rnd.integers(0, 60, len(sets))
        left, right = np.arange(0, 90), np.arange(40, len(sets))
        a, b = E.forest(h, o, left, right, label, 80, 100)

        def parts(pairs):
            up = list(label)
            for i, j in pairs:
                x, y = up[i], up[j]
                up = [x if u == y else u for u in up]
            return {frozenset(i for i in range(len(up)) if up[i] == u) for u in up}

        linked = [(i, j) for i in left for j in right if 100 * len(x := set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
        assert parts(zip(a, b)) == parts(linked) and len(a) < len(set(label)) < len(linked)


def test_empty(spark):
    assert run(spark, []) == []


def test_linked_sets_share_a_signature():
    """Without Spark: every pair of linked sets, with any choice of frequent features."""
    rnd = np.random.default_rng(3)
    for size in [4, 5, 6, 7, 9, 11, 12, 13, 19, 20, 25, 33, 50, 60, 84, 90, 150]:
        for _ in range(60):
            base = rnd.integers(0, 1 << 63, 2 * size, dtype=np.int64).view(np.uint64) * np.uint64(2)
            a = base[:size]
            drop, add = rnd.integers(0, size // 5 + 1), rnd.integers(0, size // 4 + 2)
            b = np.concatenate([a[drop:], base[size : size + add]])
            common = size - drop
            if 100 * common < 80 * (size + add) or (drop == 0 and add == 0):
                continue
            frequent = np.sort(rnd.choice(base, rnd.integers(0, 2 * size), replace=False))
            signer = E.Signer(80, 100, frequent)
            h = np.concatenate([np.sort(a), np.sort(b)])
            sigs, sets = signer.sign(h, np.array([0, len(a), len(a) + len(b)]))
            assert set(sigs[sets == 0]) & set(sigs[sets == 1]), (size, drop, add)


def test_bands():
    table = E.bands(80, 100, 1000)
    assert table[0][0] == 4 and not table[0][4] and table[-1][4] and all(a[1] + 1 == b[0] for a, b in zip(table, table[1:]))


def test_rounds_of_components_have_as_many_tasks_as_links_need(spark):
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a bigint, b bigint")
        labels = components(links)
        assert labels.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert {r.node: r.label for r in labels.collect()} == {i: i // 10 * 10 for i in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_few_links_are_joined_by_one_task(spark):
    sc = spark.sparkContext
    rnd = random.Random(8)
    pairs = [(i, i + 1) for i in range(60)] + [(-5, i) for i in range(100, 140)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7), (999, 999)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(8).localCheckpoint()
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    slow = components(links, at_once=0)
    assert slow.rdd.getNumPartitions() <= 2 * sc.defaultParallelism
    rounds = {r.node: r.label for r in slow.collect()}
    sc.setJobGroup("few links", "")
    try:
        labels = components(links)
        told = sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("few links") for s in told.getJobInfo(j).stageIds}
        assert sum(told.getStageInfo(s).numTasks for s in stages) <= 20
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node: r.label for r in labels.collect()} == rounds and rounds[60] == 0 and rounds[139] == -5 and 999 not in rounds


def test_smallest():
    chain = np.random.default_rng(2).permutation(5000)
    nodes, label = smallest(chain[:-1], chain[1:])
    assert nodes.tolist() == list(range(5000)) and not label.any()
    assert [len(x) for x in smallest(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


def test_copies_of_a_salted_join_are_not_broadcast(spark):
    left, right = spark.range(100).selectExpr("id", "id % 3 AS k"), spark.range(3).selectExpr("id AS k", "id * 10 AS v")
    got = salted(left, right, "k", "id")
    assert {(r.id, r.v) for r in got.collect()} == {(i, i % 3 * 10) for i in range(100)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_task_gives_back_what_the_worker_kept_for_the_tokenizer():
    from gridloom.llm import bpe
    from gridloom.llm import kernels as K

    bpe._encoders[b"of another stage"] = object()
    assert len(E.sets_of(K.texts_of(pa.array(["one two three four five six"])))[0]) == 2
    assert not bpe._encoders


def test_a_set_is_listed_once_however_many_flushes_hold_it(spark):
    sigs, nodes = np.array([5, 5, 9, 9, 12], np.uint64), np.array([1, 2, 1, 3, 1], np.uint64)
    rows = [E._pack(0, sigs, nodes) for _ in range(12)] + [{"bucket": -1, "sigs": np.repeat(sigs, 3).tobytes(), "nodes": np.repeat(nodes, 3).tobytes(), "ids": b""}] * 2
    packed = spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("nodes", pa.binary()), ("ids", pa.binary())])).to_pandas(), E._PACKED)
    got = sorted((r.gid, r.node) for r in E._shared(packed, 1).collect())
    once = [(5, 1), (5, 2), (9, 1), (9, 3)]
    assert got == sorted(once * 3)  # once in the range, once in each flush


def test_groups_of_equal_sets_are_kept_once(spark):
    kinds = [(1, 2), (1, 3), (1, 2, 3), (1, 4, 3), (-7, 2, 3), (2, 9, 8, 7)]
    listed = [(100 * k + i, n) for k, kind in enumerate(kinds) for i in range(k + 1) for n in kind]
    got = {}
    for r in E._different(spark.createDataFrame(listed, "gid bigint, node bigint")).collect():
        got.setdefault((r.gid, r.times), set()).add(r.node)
    assert sorted((t, sorted(v)) for (_, t), v in got.items()) == [(k + 1, sorted(kind)) for k, kind in enumerate(kinds)]
