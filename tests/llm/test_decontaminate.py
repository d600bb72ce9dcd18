import random

import numpy as np
import pytest

from verdikt.llm.decontaminate import Index, align, budget, codes_of, find_leaks, leaks, normal, without_leaks


def distance(text, item):
    """Least edits between ``item`` and any region of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, draw):
    out = list(text)
    for _ in range(n):
        at = draw.randrange(len(out))
        kind = draw.choice("sid")
        if kind == "s":
            out[at] = draw.choice("abcxyz ")
        elif kind == "i":
            out.insert(at, draw.choice("abcxyz"))
        else:
            del out[at]
    return "".join(out)


def prose(n, draw):
    return " ".join("".join(draw.choice(("er", "th", "on", "an", "re", "ing")) for _ in range(draw.randint(1, 4))) for _ in range(n))


def test_every_region_within_the_budget_is_found_and_no_other():
    draw = random.Random(5)
    items = [prose(draw.randint(6, 40), draw) for _ in range(30)]
    index = Index.of(list(enumerate(items)), 0.1)
    for k in range(120):
        i = draw.randrange(30)
        allowed = budget(len(normal(items[i])))[0]
        text = normal(prose(30, draw) + " " + edited(items[i], draw.randint(0, 2 * allowed + 1), draw) + " " + prose(20, draw))
        got = {index.ids[r[1]]: r for r in leaks([text], index)}
        for key, item in enumerate(items):
            near = distance(text, normal(item)) if key in got or key == i else 99
            assert (key in got) == (near <= budget(len(normal(item)))[0]), (key, near)
        if i in got:
            _, at, edits, start, end = got[i]
            assert distance(text[start:end], normal(items[i])) <= edits <= allowed


def test_alignment_equals_the_full_table():
    draw = random.Random(6)
    for _ in range(60):
        item, text = prose(8, draw), prose(6, draw)
        item = edited(item, 3, draw)
        text = text + edited(item, draw.randint(0, 5), draw) + text
        low, high = -len(item), len(text)
        edits, start, end = align(codes_of(text), codes_of(item), low, high)
        assert edits == distance(text, item) == distance(text[start:end], item)


@pytest.mark.parametrize("block_chars", [1_000_000, 150])
def test_planted_rows(spark, block_chars):
    draw = random.Random(7)
    items = [prose(20, draw) for _ in range(6)]
    docs = [prose(60, draw) for _ in range(40)]
    want = set()
    for k in range(12):
        i = k % 6
        docs[k] = docs[k] + "\n " + edited(items[i], k // 2, draw).upper() + " " + docs[k]
        if distance(normal(docs[k]), normal(items[i])) <= budget(len(normal(items[i])))[0]:
            want.add((k, i))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = find_leaks(table, bench, block_chars=block_chars)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 8
    kept = without_leaks(table, bench, block_chars=block_chars)
    assert {r.doc_id for r in kept.collect()} == set(range(40)) - {d for d, _ in want}


def test_awkward_rows(spark, awkward):
    bench = spark.createDataFrame(
        [(1, "the same TEXT twice,\nword for word"), (1, None), (2, ""), (None, "\U0001f600 <|endoftext|>"), (3, "emoji"), (4, "id is")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in find_leaks(awkward, bench).collect()}
    assert got == {(4, 1), (5, 1), (7, None), (None, 4)}
    kept = without_leaks(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 5
    assert find_leaks(awkward.limit(0), bench).count() == 0
    assert find_leaks(awkward, bench.limit(0)).count() == 0
    assert without_leaks(awkward, bench.limit(0)).count() == awkward.count()
