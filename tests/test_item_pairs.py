from verdikt.plans.catalog import QUERIES


def test_every_rejected_line_is_paired(spark, tmp_path):
    text = "\n".join(f"line {i} of the text" for i in range(9))
    spark.createDataFrame([(1, text, "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    pairs = {n: [(r.chosen_index, r.rejected_index) for r in QUERIES[n](spark, str(tmp_path)).collect()] for n in ("item_pairs_all", "item_pairs")}
    assert sorted(pairs["item_pairs_all"]) == [(c, r) for c in range(2) for r in range(7)]
    assert sorted(pairs["item_pairs"]) == [(c, r) for c in range(2) for r in range(3)]
