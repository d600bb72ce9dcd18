from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from verdikt.llm.language_id import codewords, grams, identify
from verdikt.llm.queries import op2

FOLDER = "/root/testdata/sf0.01"


def test_codewords_differ_and_no_bit_is_constant():
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n).astype(int)
        assert len({tuple(row) for row in code}) == n
        assert np.all(np.abs(code.sum(axis=0)) < n)
    code = codewords(4).astype(int)
    assert code.shape == (4, 7) and min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4


def test_grams_do_not_cross_texts():
    apart, _ = grams(["abc"])
    together, owner = grams(["x", "abc", "", "é1"])
    assert list(together[owner == 1]) == list(apart) and len(apart) == 3
    assert (owner == 2).sum() == 0 and (owner == 3).sum() == 1


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = op2(spark, FOLDER).join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_lang_of_held_out_rows_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    blind = docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(identify(docs).collect()) == sorted(identify(blind).collect())


def test_awkward_rows(spark, awkward):
    got = identify(awkward)
    assert got.count() == awkward.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[6].lang_pred == "und"
    assert by[3].lang_pred in ("en", "fr")
    one = identify(awkward.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in one.where("doc_id = 3").collect()} == {"xx"}
    assert {r.lang_pred for r in identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(awkward.limit(0)).count() == 0
