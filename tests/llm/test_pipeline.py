"""Every stage on its own input against brute force, and awkward documents through all of them."""

import corpus_pipeline
from verdikt.llm.decontaminate import normal
from verdikt.llm.queries import op1, vocabulary
from verdikt.llm.secrets import scan
from verdikt.llm.simhash import fingerprint
from verdikt.llm.tokens import encoding, ids_of

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in op1(spark, FOLDER).where("kept").collect()}

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    single = stages["near_duplicates"](spark, kept, FOLDER)
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i in ids if find(i) == i}

    items = [normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = stages["decontamination"](spark, single, FOLDER)
    exact = {r.doc_id for r in single.collect() if any(item in normal(r.text) for item in items)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and exact and left == {r.doc_id for r in single.collect()} - exact

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    safe = stages["secrets"](spark, clean, FOLDER)
    before = {r.doc_id: r for r in clean.collect()}
    encode = encoding(*vocabulary()[1:]).encode_ordinary
    for r in safe.collect():
        assert r.n_chars == len(r.text) and not scan(r.text, encode)[1]
        assert (r.text == before[r.doc_id].text) == (not scan(before[r.doc_id].text, encode)[1])
    assert safe.columns == docs.columns and safe.count() == len(before)

    packed = stages["packing"](spark, safe, FOLDER)
    ids = ids_of(*vocabulary())
    want = sum(len(ids(r.text)) // 4 + 1 for r in safe.collect())
    assert sum(r.length for r in packed.collect()) == want


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == awkward.columns, name
        assert stage(spark, awkward.limit(0), "/root/testdata/sf0.001").count() == 0
    corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    # fewer than fifty words, or the same words all over: the base rule rejects them all
    assert docs.count() == 0
