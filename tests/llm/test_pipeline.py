import hashlib

import corpus_pipeline as C
import test_decontaminate
import test_linededup
import test_partenum

from gridloom.llm import linededup, toxicity


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scored if r.predicted}
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect() if r.doc_id not in rejected]
    rows = [(d, t) for d, _, _, t in test_linededup.brute(rows, linededup.RATIO, linededup.MIN_PAGES)]
    texts = dict(rows)
    first = {d for d, _, c in test_partenum.brute(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    clean = {d for d, *_, hit in test_decontaminate.brute(rows, items) if not hit}
    got = C.run(spark, sf).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean) < docs.count()
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.n_tokens == len(r["ids"])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.createDataFrame([(1, "a b", None, None, 3), (None, "x", "en", "s", 1), (None, None, "en", "s", 1), (1, "a b", None, None, 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for data in (docs, docs.limit(0)):
        for _, stage in C.STAGES[:-1]:
            data = stage(spark, data, sf)
            assert data.columns == docs.columns
            data = spark.createDataFrame(data.collect(), docs.schema)
        assert C.tokens(spark, data, sf).count() == data.count()


def test_rows_that_share_an_id(spark, sf):
    long = lambda w: " ".join(f"{w}{i}" for i in range(60))
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    rows = [(7, long("x"), "en"), (7, long("y"), "en"), (7, long("y"), "de"), (3, long("z"), "en"), (7, long("z"), "en")]
    rows += [(7, "", "en"), (7, None, "en"), (7, "", "en"), (8, long("x") + " more", "en"), (9, item, "en"), (9, long("v"), "en"), (None, long("u"), "en"), (None, item, "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    known = lambda df: sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=str)
    want = [(7, long("x"), "en"), (7, long("y"), "de"), (3, long("z"), "en"), (7, "", "en"), (7, None, "en"), (9, item, "en"), (9, long("v"), "en"), (None, long("u"), "en"), (None, item, "en")]
    joined = C.ngram_join(spark, docs, sf)
    assert known(joined) == sorted(want, key=str)
    joined = spark.createDataFrame(joined.collect(), docs.schema)
    assert known(C.decontamination(spark, joined, sf)) == sorted([r for r in want if r[1] != item], key=str)
