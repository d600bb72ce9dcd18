"""Operators without SQL against brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.operators import experts as E
from verdikt.operators import greedy as G
from verdikt.operators import merge as M
from verdikt.operators import retrieval as V
from verdikt.operators import scoring as S


def brute_whitening(matrix, ridge):
    cov = np.cov(matrix, rowvar=False, bias=True) + ridge * np.eye(matrix.shape[1])
    values, vectors = np.linalg.eigh(cov)
    raw = vectors @ np.diag(np.clip(values, ridge, None) ** -0.5) @ vectors.T @ np.ones(matrix.shape[1])
    clipped = np.clip(raw, 0, None)
    clipped = clipped if clipped.sum() > 0 else np.ones_like(clipped)
    return clipped / clipped.sum()


def test_whitening_matches_covariance(spark):
    rng = np.random.default_rng(2)
    names = ["x", "y", "z", "w"]
    rows = [(f"e{k}", *map(int, r)) for k in range(6) for r in (rng.random((9, 4)) < 0.3 + 0.1 * k)]
    df = spark.createDataFrame(rows, "example_id string, x int, y int, z int, w int")
    got = S.whitened_weights(S.gram(df, names), names).collect()
    for k in range(6):
        want = brute_whitening(np.array([r[1:] for r in rows if r[0] == f"e{k}"], dtype=float), 1e-3)
        have = {r.rubric_id: r.weight for r in got if r.example_id == f"e{k}"}
        assert [have[n] for n in names] == pytest.approx(list(want), abs=1e-9)
        assert sum(have.values()) == pytest.approx(1.0)


def test_closed_form_equals_batched(spark):
    rows = [("e", i % 2, int(i % 3 == 0)) for i in range(7)] + [("f", 1, i % 2) for i in range(4)]
    grams = S.gram(spark.createDataFrame(rows, "example_id string, x int, y int"), ["x", "y"])
    pair = {r.example_id: (r.weight_a, r.weight_b) for r in S.two_rubric_whitening(grams).collect()}
    for r in S.whitened_weights(grams, ["x", "y"]).collect():
        assert r.weight == pytest.approx(pair[r.example_id]["xy".index(r.rubric_id)], abs=1e-9)


def brute_collapse(tokens, severities, counts, threshold):
    kept = []
    for i, raw in enumerate(tokens):
        t = set(raw)
        hit = next((k for k in kept if t and len(t & k["t"]) / (len(t | k["t"]) or 1) >= threshold), None)
        if hit is None:
            kept.append({"t": t, "pos": i, "n": counts[i]})
            continue
        new, old = G.SEVERITY.get(severities[i], 2), G.SEVERITY.get(severities[hit["pos"]], 2)
        if new < old or (new == old and counts[i] > hit["n"]):
            hit.update(t=t, pos=i)
        hit["n"] += counts[i]
    return [k["pos"] for k in kept], [k["n"] for k in kept]


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.9])
def test_redundancy_matches_brute_force(threshold):
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(1, 30)
        tokens = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 5))] for _ in range(n)]
        sev = [rng.choice(["hard_gate", "high", "medium", "low", "odd"]) for _ in range(n)]
        cnt = [rng.randrange(1, 4) for _ in range(n)]
        assert G.collapse(tokens, sev, cnt, threshold) == brute_collapse(tokens, sev, cnt, threshold)


def test_mean_overlap_matches_pairs():
    bank = [["a", "b"], ["b", "c"], [], ["a", "b", "c"]]
    sets = [set(b) for b in bank]
    want = [len(p & q) / max(1, len(p | q)) for i, p in enumerate(sets) for q in sets[i + 1:]]
    assert G.mean_overlap(bank) == pytest.approx(sum(want) / len(want))
    assert G.mean_overlap([["a"]]) == 0.0


def test_budget_prefilter_is_exact(spark):
    rng = random.Random(4)
    rows = [
        (f"c{i:03d}", f"d{rng.randrange(4)}", rng.choice([["f1"], ["f2"], ["generic", "f1"], ["generic"]]),
         rng.choice(["hard_gate", "high"]), rng.randrange(5))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "criterion_id string, dimension string, applicable_families array<string>, "
                                     "severity_tier string, direction_evidence int")
    got = {r.criterion_id: r.cluster_id for r in M.budgeted(df, 6, 9, 20).collect()}
    dims, fams, want = {}, {}, {}
    for cid, d, f, s, e in sorted(rows, key=lambda r: (r[3] != "hard_gate", -r[4], r[1], r[0])):
        if len(want) >= 20 or dims.get(d, 0) >= 6 or any(fams.get(x, 0) >= 9 for x in f if x != "generic"):
            continue
        want[cid] = f"cluster_{len(want):03d}"
        dims[d] = dims.get(d, 0) + 1
        for x in f:
            fams[x] = fams.get(x, 0) + 1
    assert got == want


@pytest.mark.parametrize("blocks", [(4096, 50_000), (7, 5)])
def test_cosine_grid_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(8)
    q = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(12)] + [(99, [0.0] * 4)]
    x = [(f"i{i:02d}", [float(v) for v in rng.integers(-2, 3, size=4)]) for i in range(40)]
    qs = spark.createDataFrame(q, "query_id bigint, embedding array<double>")
    xs = spark.createDataFrame(x, "item_id string, embedding array<double>")
    got = {}
    for r in V.cosine_top_k(qs, xs, 3, block_rows=blocks[0], query_rows=blocks[1]).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    assert 99 not in got
    for ident, v in q[:-1]:
        scored = []
        for name, w in x:
            norm = np.linalg.norm(v) * np.linalg.norm(w)
            if norm:
                scored.append((-round(float(np.dot(v, w) / norm), 12), name))
        assert [got[ident][i] for i in (1, 2, 3)] == [n for _, n in sorted(scored)[:3]]


@pytest.mark.parametrize("cells", [(512, 20_000), (2, 6)])
def test_tfidf_grid_matches_brute_force(spark, cells):
    import math

    rng = random.Random(6)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]) for i in range(30)]
    asked = [(i, [rng.choice("abcdxyz") for _ in range(rng.randrange(1, 5))]) for i in range(5)]
    d = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>")
    q = spark.createDataFrame(asked, "query_id bigint, tokens array<string>")
    got = {}
    for r in V.tfidf_top_k(q, d, 4, *cells).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    df = {t: sum(t in set(toks) for _, toks in docs) for t in "abcdefghxyz"}
    idf = lambda t: math.log((len(docs) + 1) / (df[t] + 1)) + 1
    vec = lambda toks: {t: toks.count(t) * idf(t) for t in set(toks)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for ident, toks in asked:
        qv = vec(toks)
        sims = []
        for did, dt in docs:
            dv = vec(dt)
            s = sum(qv[t] * dv.get(t, 0.0) for t in qv) / (norm(qv) * norm(dv))
            if s > 0:
                sims.append((-round(s, 9), did))
        assert [x for _, x in sorted(got.get(ident, []))] == [x for _, x in sorted(sims)[:4]]


def test_best_match_first_index_wins():
    got = E.match_lists([["alpha", "beta"], []], ["other", "x"], [["gamma"], ["alpha", "beta"], ["alpha", "beta"]],
                        ["y", "z", "other"])
    assert got == [(1.0, 1), (0.0, -1)]


def test_words_are_taken_in_one_pass(spark):
    """Splitting, filtering and thinning out the words of a line took most of rubric_conflicts and expert_recall."""
    import re

    from verdikt.functions import rubrics as X
    from verdikt.functions import text as T

    texts = ["", " ", "Note: the The note's 12 abc-abcd ABCD efgh_ijkl éte été x1y2", "a b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", X.content_tokens(F.col("t")).alias("c"), X.family_tokens(F.col("t")).alias("f"), T.alnum_tokens(F.col("t")).alias("a"))
    for r in found.collect():
        if r.t is None:
            assert r.c is r.f is r.a is None
            continue
        words = re.findall("[a-z0-9]+", r.t.lower())
        assert r.a == words
        assert r.c == [w for w in dict.fromkeys(words) if len(w) > 2 and w not in X.RUBRIC_STOPWORDS]
        assert r.f == [w for w in dict.fromkeys(words) if len(w) > 3 and w not in X.FAMILY_STOPWORDS]
    for plan in (X.content_tokens(F.col("t")), X.family_tokens(F.col("t")), T.alnum_tokens(F.col("t"))):
        assert "split" not in str(plan) and "filter" not in str(plan)


def test_prompts_split_a_text_once(spark, tmp_path):
    """A filter on the lines was pushed below them and split every text again."""
    from verdikt.plans import evaluation

    spark.createDataFrame([(1, "en", "one\ntwo"), (2, "en", " \n  "), (3, "en", None), (4, "en", "")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = evaluation.prompts(spark, str(tmp_path))
    assert [r.prompt_id for r in rows.collect()] == [1]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert all("split" not in line for line in plan.splitlines() if "Filter" in line)


def test_cosine_cells_are_scored_in_small_slices(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(2).integers(-3, 4, size=(700, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw)], "id long, embedding array<double>")
    qs, xs = rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "item_id")
    assert 0 < V.SCORED_ROWS * V.BLOCK_ROWS * 8 <= 8.5e6 and V.QUERY_ROWS <= V.BLOCK_ROWS
    got = {}
    for r in V.cosine_top_k(qs, xs, 1).collect():
        got[r.query_id] = r.cosine
    live = {i for i, v in enumerate(draw) if v.any()}
    assert got.keys() == live and all(abs(c - 1) < 1e-9 for c in got.values())


def test_cells_of_tfidf_hold_few_products():
    """2,000 documents of 150 words against 512 queries: products of 256 documents and fixed-width words took over 500 MB."""
    import tracemalloc

    import pandas as pd

    words = [f"w{i:03}" for i in range(300)]
    docs = pd.DataFrame([(d, words[(d * 7 + j * 2) % 300], 0.1) for d in range(2000) for j in range(150)], columns=["doc_id", "term", "w"])
    asked = pd.DataFrame([(q, words[(q + j) % 300], 0.5) for q in range(512) for j in range(3)], columns=["query_id", "term", "w"])
    tracemalloc.start()
    got = V._score_cell(docs, asked, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    held = {d: set(g) for d, g in docs.groupby("doc_id")["term"]}
    for q in (0, 100, 511):
        mine = [words[(q + j) % 300] for j in range(3)]
        best = sorted(((-round(sum(0.05 * (w in held[d]) for w in mine), 9), d) for d in held))[:3]
        rows = got[got["query_id"] == q]
        assert [(-round(s, 9), d) for s, d in zip(rows["similarity"], rows["doc_id"])] == best
