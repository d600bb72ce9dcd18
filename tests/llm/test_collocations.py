import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from verdikt.llm import collocations as co


def brute(rows, least, covered, most):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 and f[q] >= least and 100 * f[q] >= covered * a and p in (q[:2], q[1:]) for q in f if len(q) > len(p)):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Über", "Of", "of", "\x00", "😀"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = []
    for i in range(400):
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in draw.choices(words, weights, k=draw.randrange(60)))
        made.append((draw.choice(["en", "en", "de", None]), text))
    return made + [("en", None), (None, ""), ("fr", " . "), ("en", "new york city " * 300), ("en", made[0][1])]


@pytest.mark.parametrize("hot", [1, 20, 256])
@pytest.mark.parametrize("size", [50, 2_000_000])
def test_matches_brute_force(spark, rows, monkeypatch, hot, size):
    monkeypatch.setattr(co, "HOT", hot)
    monkeypatch.setattr(co, "SLICE_WORDS", size)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = co.collocations(docs, 10, 50, 60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 50, 60)
    assert sorted(map(tuple, co.collocations(docs, 3, 50, None).collect())) == brute(rows, 3, 50, None)


def test_partitions_are_counts():
    draw = random.Random(6)
    strings = [[draw.choice("aabcdefg") for _ in range(draw.randrange(1, 5))] for _ in range(5000)]
    keys = np.zeros((4, len(strings)), dtype=np.int64)
    for i, s in enumerate(strings):
        keys[: len(s), i] = [ord(c) for c in s]
    weight = np.array([draw.randrange(1, 4) for _ in strings])
    start = np.zeros(len(strings), dtype=bool)
    start[0] = True
    got = {}
    for depth, at, total in co.equal_partitions(keys, weight, start, 12):
        for x, n in zip(at.tolist(), total.tolist(), strict=True):
            got["".join(strings[x][: depth + 1])] = n
    want = Counter()
    for s, w in zip(strings, weight.tolist(), strict=True):
        for d in range(len(s)):
            want["".join(s[: d + 1])] += w
    assert got == {k: v for k, v in want.items() if v >= 12}


def test_products_beyond_64_bits(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b " * 20)], "lang string, text string")
    real = co.word_counts
    monkeypatch.setattr(co, "word_counts", lambda d: real(d).selectExpr("lang", "word", "n * 300000000 as n"))
    monkeypatch.setattr(co, "frequent_phrases", lambda d, c, least: spark.createDataFrame([("en", "a b", 5_999_999_999)], "lang string, phrase string, a long"))
    row = co.collocations(docs).first()
    assert row.score == int(Decimal(10**6) * 5_999_999_999**2 // (Decimal(6_000_000_000) ** 2))


def test_awkward_rows(spark, awkward):
    got = {(r.lang, r.phrase): r.a for r in co.collocations(awkward).collect()}
    assert got == {("en", "word word word"): 59_998}
    assert co.collocations(awkward.limit(0)).count() == 0
    assert co.collocations(awkward, least=1).where("lang = 'und'").count() > 0
