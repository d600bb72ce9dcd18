import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from verdikt.llm import spelling as sp


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(beside[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(draw, word):
    i, c = draw.randrange(len(word) + 1), draw.choice("abcé÷")
    return draw.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(4, 16))) for _ in range(60)] + ["aaaaa", "ababab", "ß" * 300]
    pool = [w for b in base for w in [b] * 6 + [misspelt(draw, b) for _ in range(12)] + [misspelt(draw, misspelt(draw, b))]]
    made = [(i, draw.choice([" ", "-", "Ā", "1"]).join(draw.choices(pool, k=60))) for i in range(250)]
    made += [(None, "Straße straße STRASSE straßen " * 3), (250, None), (251, ""), made[0], (None, "퟿ ÀÿÀÿÀ × a"), (252, "X" * 40 + " ")]
    return made


@pytest.mark.parametrize(("block", "rare"), [(2000, 8), (7, 8), (2000, 1), (2000, 10**9)])
def test_matches_brute_force(spark, rows, monkeypatch, block, rare):
    monkeypatch.setattr(sp, "RARE", rare)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = sp.spelling_variants(docs, block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bound_on_affected_grams():
    """All grams but the bounded number outlast any edit, and so two near words share a list."""
    draw = random.Random(4)
    for _ in range(400):
        word = "".join(draw.choice("abc") for _ in range(draw.randrange(5, 15)))
        frequent = {g: draw.randrange(9, 99) for g in {"".join(draw.choice("abc") for _ in range(draw.choice([2, 2, 3, 4]))) for _ in range(25)}}
        other = misspelt(draw, word)
        if other == word or len(other) < 5:
            continue
        most = sp.longest_gram(min(len(word), len(other)))
        mine, affected = sp.decompose(word, most, frequent)
        theirs = {(g, p + d) for _, g, p in sp.decompose(other, most, frequent)[0] for d in (-1, 0, 1)}
        assert sum((g, p) in theirs for _, g, p in mine) >= len(mine) - affected
        shorter, longer = sorted((word, other), key=len)
        lists = {k for k, far in sp.listings(shorter, frequent) if not far}
        assert lists & {k for k, far in sp.listings(longer, frequent) if far == (len(longer) > len(shorter))}


def test_near_pairs_from_the_definition():
    draw = random.Random(8)
    one = sorted({"".join(draw.choice("ab") for _ in range(6)) for _ in range(60)})
    for size in (6, 7):
        other = sorted({"".join(draw.choice("ab") for _ in range(size)) for _ in range(60)})
        chars = [np.frombuffer("".join(x).encode(), dtype=np.uint8).reshape(len(x), -1) for x in (one, other)]
        got = {(one[i], other[j]) for a, b in sp.near_pairs(*chars) for i, j in zip(a, b, strict=True)}
        assert got == {(a, b) for a in one for b in other if near(a, b)}


def test_awkward_rows(spark, awkward):
    got = sorted(map(tuple, sp.spelling_variants(awkward).collect()))
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sp.spelling_variants(awkward.limit(0)).count() == 0
