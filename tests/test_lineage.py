"""Ancestor closure against a walk, and grounding by definition."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import lineage as L


def walk(parents):
    out = {}
    for key in parents:
        at, seen = key, {key}
        while parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.add(at)
        if parents[at] in seen:
            out[key] = (None, None, "ring")
        else:
            out[key] = (at, len(seen) - 1, "whole" if parents[at] is None else "orphan")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lineage_matches_a_walk(spark, seed):
    draw = random.Random(seed)
    n = 120
    parents = {i: draw.choice([None, draw.randrange(n), max(0, i - 1), draw.randrange(n), n + 5]) for i in range(n)}
    parents |= {200 + i: 199 + i if i else None for i in range(40)} | {300: 300, 301: 300}
    df = spark.createDataFrame(list(parents.items()), "criterion_id long, parent_id long").repartition(3)
    got = {r.criterion_id: (r.root, r.depth, r.state) for r in L.lineage(df).collect()}
    assert got == walk(parents)
    assert {s for _, _, s in got.values()} == {"whole", "orphan", "ring"}
    assert L.lineage(df.limit(0)).count() == 0


def test_ids_follow_every_part(spark):
    rows = [("p", 1, None, 0, "d", "l", "r"), ("p", 1, "", 0, "d", "l", "r"), ("p", 2, "", 0, "d", "l", "r"), ("p", 1, "x", 0, "d", "l", "r"), ("p", 1, "", 1, "d", "l", "r")]
    df = spark.createDataFrame(rows, "a string, b int, c string, d int, e string, f string, g string")
    ids = [r[0] for r in df.select(L.criterion_id(*map(F.col, "abcdefg"))).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4 and all(i.startswith("p__criterion_") for i in ids)


def test_grounding(spark):
    rows = [
        ("note the ct scan result", ["ct scan result"], "the ct scan result was clear"), ("note the weather", ["weather today"], "ct scan"),
        ("imaging is named", [], "ct scan"), ("imaging and cost", [], "ct scan"), ("the plan", ["ct scan"], "ct scan"),
    ]
    df = spark.createDataFrame(rows, "blob string, terms array<string>, delta string")
    gate = L.grounded(F.col("blob"), F.col("terms"), F.col("delta"), ("imaging",), ("CT scan", "imaging"), ("cost",))
    assert [r[0] for r in df.select(gate["keep"]).collect()] == [True, False, True, False, False]
    free = L.grounded(F.col("blob"), F.col("terms"), F.col("delta"), ("imaging",))
    assert [r[0] for r in df.select(free["keep"]).collect()] == [True, False, True, True, True]
    fallback = L.grounded(F.col("blob"), F.col("terms"), F.col("delta"), ("imaging",), (), ("cost",))
    assert [r[0] for r in df.select(fallback["keep"]).collect()] == [False, False, True, False, False]


def test_terms_of_long_texts_are_found_as_in_short_ones():
    words = [f"w{i * i % 977}x{i % 13}" for i in range(3000)]
    text = " ".join(words)
    terms = [text[i : i + n] for i in range(0, len(text) - 80, 997) for n in (1, 7, 32, 33, 70)]
    terms += [t + "?" for t in terms] + ["absent", "", text, text + " "]
    assert L.held_terms([terms, [], ["absent", None]], text) == [[t for t in terms if t in text], [], []]
    assert L.held_terms([["a", "b", None]], "xay") == [["a"]] and L.held_terms([["a"], []], None) == [[], []] and L.held_terms(None, "a") is None


def test_grounding_reads_an_edit_once_per_document(spark, monkeypatch, tmp_path):
    """The edit's words are looked up per document, not searched through for every line (the query took 76 s on sf0.1)."""
    from verdikt.plans import lines

    text = "\n".join(f"of item{i} some{i * 7} longer words stand here{i}" if i % 2 else f"kept thing{i} line{i}" for i in range(400))
    spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "of x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = []
    real = L.grounded
    monkeypatch.setattr(L, "grounded", lambda blob, terms, delta, *edit: calls.append(delta) or real(blob, terms, delta, *edit))
    rows = {r.doc_id: r for r in lines.grounded_proposals(spark, str(tmp_path)).collect()}
    assert calls == [None] * 3
    assert rows.keys() == {1} and rows[1].proposals == 400 and rows[1].accepted == 200
