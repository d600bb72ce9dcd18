"""The range-sliced path must equal the window path, also for one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import reports as R
from verdikt.operators import running as RT
from verdikt.operators import scoring as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(9)}", i, rng.randrange(6)) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, id bigint, v bigint").repartition(7)


def test_sliced_ranks_match(rows):
    data, df = rows
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {(r.g, r.id): r["rank"] for r in RT.ranked(df, ["g"], order, max_rows=1).collect()}
    want = {}
    for g in {r[0] for r in data}:
        for pos, r in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            want[(g, r[1])] = pos
    assert got == want


def test_sliced_totals_and_global_ordinal(rows):
    data, df = rows
    out = RT.running_totals(df, [], [F.col("id").asc()], {"t": F.col("v")}, max_rows=1).orderBy("id").collect()
    total = 0
    for r, (_, _, v) in zip(out, sorted(data, key=lambda r: r[1])):
        total += v
        assert r.t == total


@pytest.mark.parametrize("limit", [1, 10**9])
def test_exact_quantiles(rows, limit):
    import numpy as np

    data, df = rows
    got = {r.g: r for r in RT.exact_quantiles(df, ["g"], "v", (0.1, 0.5, 0.99), max_rows=limit).collect()}
    for g in got:
        vals = [r[2] for r in data if r[0] == g]
        assert got[g].n == len(vals)
        for q, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
            assert got[g][name] == pytest.approx(float(np.quantile(vals, q)))


@pytest.mark.parametrize("limit", [1, 10**9])
def test_pair_reports_match_enumeration(spark, limit):
    rng = random.Random(3)
    buckets = ["gold_like", "open_generated", "synthetically_degraded", "other"]
    data = [(f"e{rng.randrange(4)}", i, rng.randrange(5) / 4.0, rng.choice(buckets)) for i in range(160)]
    df = spark.createDataFrame(data, "example_id string, candidate_id bigint, score double, quality_bucket string")
    ranks = S.rank_candidates(df.withColumn("satisfied_count", F.lit(0).cast("bigint")), max_rows=limit)
    table = {(r.example_id, r.candidate_id): r for r in ranks.collect()}
    svw = {r.example_id: r for r in R.strong_vs_weak(ranks, max_rows=limit).collect()}
    early = {r.example_id: r for r in R.earlier_preferred(df, ["example_id"], [i / 4.0 for i in range(5)], limit).collect()}
    for e in svw:
        mine = [r for k, r in table.items() if k[0] == e]
        strong = [r for r in mine if r.quality_bucket in S.REPORT_STRONG]
        weak = [r for r in mine if r.quality_bucket in S.WEAK]
        pairs = [(s, w) for s in strong for w in weak]
        assert svw[e].total == len(pairs)
        assert svw[e].correct == sum(s["rank"] < w["rank"] for s, w in pairs)
        assert svw[e].margin == pytest.approx(sum(s.score - w.score for s, w in pairs) / len(pairs))
        mine.sort(key=lambda r: r.candidate_id)
        combos = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1:]]
        assert early[e].pair_count == len(combos)
        assert early[e].pairwise_accuracy == pytest.approx(sum(a.score > b.score for a, b in combos) / len(combos))
        assert early[e].mean_margin == pytest.approx(sum(a.score - b.score for a, b in combos) / len(combos))
