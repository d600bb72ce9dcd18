import random

import numpy as np
import pytest

from verdikt.llm.simhash import fingerprint, forest, masks, near_duplicates, one_of_each


def groups(values, links):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def all_pairs(values, radius=4):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius]


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(1)
    for level in range(3):
        cover = [int(m) for m in masks(4, level)]
        assert len(cover) == 31
        for _ in range(3000):
            bits = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(m & bits == 0 for m in cover)


@pytest.mark.parametrize("tile", [8192, 16])
def test_forest_has_the_components_of_all_pairs(monkeypatch, tile):
    monkeypatch.setattr("verdikt.llm.simhash.TILE", tile)
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:20]:
        for _ in range(30):
            b ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            values.add(b)
    values = sorted(values)
    found = forest(np.array(values, dtype=np.uint64), np.uint64(2**64 - 1), 4)
    assert len(found) < len(values)
    assert groups(values, [(values[i], values[j]) for i, j in found]) == groups(values, all_pairs(values))


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: fingerprint(t or "") for i, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(sorted(prints), links)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.bits & (2**64 - 1) == prints[r.doc_id] for r in got)


def test_fingerprint_from_the_definition():
    from xxhash import xxh64_intdigest

    text = "One two\x0bTHREE four x five É Six"
    words = ["one", "two", "three", "four x", "five", "É", "six"]
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)
    assert fingerprint(text) == want
    assert fingerprint("Only THREE words") == xxh64_intdigest(b"only three words", 42)
    assert fingerprint(" \n") == 0


def test_awkward_rows(spark, awkward):
    got = {(r.doc_id, r.bits): r.component_id for r in near_duplicates(awkward).collect()}
    assert near_duplicates(awkward).count() == awkward.count()
    assert got[(5, [b for d, b in got if d == 4][0])] == 4
    assert got[(2, 0)] == got[(1, 0)] == got[(6, 0)] == got[(None, 0)] == 1
    kept = one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 4, 7]
    assert near_duplicates(awkward.limit(0)).count() == 0


def test_one_of_each_judges_every_row(spark):
    same, other, third = "a b c d e f g h", "one two three four five six seven", "red green blue black white grey"
    rows = [
        (None, "An id is missing here but the words are not."), (None, same), (None, third), (None, third),
        (3, same), (3, "quite another text under the same id as before"), (2, same),
        (7, same), (7, other), (8, other), (9, other),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({fingerprint(t) for _, t in rows}) == 5
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], rows[5], rows[6], rows[8]], key=str)


def test_null_ids_of_the_awkward_rows(awkward):
    kept = [r.text for r in one_of_each(awkward).collect() if r.doc_id is None]
    assert kept == ["An id is missing here but the words are not."]
