"""Guided retrieval against the SQL that scores all pairs, on random records."""

import random

import pytest
from pyspark.sql import functions as F

from check_oracle import canonical
from verdikt.operators import guided as G
from verdikt.plans import retrieving as R


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(3)
    words = [f"word{i}" for i in range(60)] + ["input", "output", "prove", "a.", "(b)", "best guess", "def ", "constraint", "the"]
    rows = []
    for conv in [*range(0, 60), *range(100, 400, 50)]:
        for turn in range(3):
            text = draw.choice([" ", "\n"]).join(draw.choices(words, [1 / (i + 1) for i in range(len(words))], k=draw.choice([0, 3, 20, 80])))
            rows.append((conv, turn, draw.choice(["user", "assistant"]), text))
    rows += [(500, 0, "user", rows[4][3]), (550, 0, "user", rows[4][3]), (None, 1, "user", "x"), (7, 9, "user", None)]
    path = tmp_path_factory.mktemp("guided")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_same_as_all_pairs(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    cur = con.execute(R._SQL)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    found = R.guided_retrieval(spark, folder)
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == want
    assert len(want[1]) > 100


def test_share_of_scored_pairs(spark, folder):
    asked = F.expr("id div 10000") % 50 == 0
    for k, most in ((1, 0.5), (5, 0.8)):
        result, share = G.guided_top_k(R.records(spark, folder), asked, k)
        rows = share.collect()
        assert all(r.compared <= r.pool for r in rows)
        assert sum(r.compared for r in rows) < most * sum(r.pool for r in rows), (k, rows)
    counts = {r.query_id: r.n for r in result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(counts[r.query_id] == min(5, r.pool) for r in rows)


def test_no_queries_and_one_record(spark, folder):
    records = R.records(spark, folder)
    assert G.guided_top_k(records, F.lit(False), 3)[0].count() == 0
    assert G.guided_top_k(records.where("id = 50000"), F.lit(True), 3)[0].count() == 0


def test_queries_do_not_meet_each_profile_apart(spark, folder, monkeypatch):
    """What is kept of a query grows with k and the slices, not with the profiles; small cells give the same."""
    asked, kept = F.expr("id div 10000") % 50 == 0, []
    records = R.records(spark, folder)
    keep = G.durable
    monkeypatch.setattr(G, "durable", lambda df: kept.append(keep(df)) or kept[-1])
    result, share = G.guided_top_k(records, asked, 5)
    n = records.where(asked).count()
    assert kept[1].count() > 50  # profiles
    assert [t.columns for t in kept if "query_id" in t.columns and t.count() > 2 * 5 * n] == []
    compared = {r.query_id: r.compared for r in share.collect()}
    monkeypatch.setattr(G, "RECORD_ROWS", 9)
    monkeypatch.setattr(G, "QUERY_ROWS", 2)
    cut, cut_share = G.guided_top_k(records, asked, 5)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, result.collect()))
    # a cell is named by its slice and pool: no slice is counted twice
    assert {r.query_id: r.compared for r in cut_share.collect()} == compared
