import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from verdikt.llm import repeats as rp


def brute(rows, window=35):
    split = [re.findall("[^\x20\x09-\x0d]+", text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(13)

    def prose(n, words=300):
        return [f"w{draw.randrange(words)}" for _ in range(n)]

    passages = [prose(draw.randrange(30, 90)) for _ in range(12)] + [["x"] * 50, ["a", "b"] * 30, ["é"] * 34]
    made = []
    for i in range(150):
        parts = [prose(draw.randrange(80))]
        for _ in range(draw.randrange(4)):
            p = draw.choice(passages)
            cut = draw.randrange(3)
            parts += [p[cut : len(p) - draw.randrange(3)], prose(draw.randrange(60), draw.choice([2, 300]))]
        made.append((i, draw.choice([" ", "\n", "\t "]).join(w for part in parts for w in part)))
    made += [(150, None), (151, ""), (152, " \n"), (None, made[3][1]), (3, made[3][1]), (None, made[4][1] + " end")]
    made += [(160, " ".join(prose(35))), (161, " ".join(prose(34))), (162, "word " * 5000), (163, "\x1c \x85 " * 40)]
    return made


@pytest.mark.parametrize("segment", [20, 4])
def test_matches_brute_force(spark, rows, monkeypatch, segment):
    monkeypatch.setattr(rp, "SEGMENT", segment)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_words long").repartition(4)
    got = rp.without_repeats(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_symbol_stands_wherever_its_stretch_stands():
    draw = np.random.default_rng(3)
    for alphabet in (2, 3, 50):
        core = draw.integers(1, alphabet + 1, 60).astype(np.uint64)
        ends = [draw.integers(1, alphabet + 1, (2, 20)).astype(np.uint64) for _ in range(30)]
        texts = [np.concatenate([a, core, b]) for a, b in ends]
        found = []
        for text in texts:
            name, low, high, _ = rp.symbols(text * np.uint64(0x9E3779B97F4A7C15), np.zeros(len(text), dtype=int))
            inside = (low >= 20) & (high <= 80)
            found.append(set(zip(name[inside].tolist(), low[inside].tolist(), strict=True)))
        assert all(x == found[0] for x in found)
        assert alphabet < 50 or found[0]


def test_runs_and_pairs_shrink_texts():
    text = np.repeat(np.uint64(7), 100_000)
    assert len(rp.symbols(text, np.zeros(len(text), dtype=int))[0]) == 1
    text = np.tile(np.array([7, 1 << 40], dtype=np.uint64), 50_000)
    assert len(rp.symbols(text, np.zeros(len(text), dtype=int), 10)[0]) < 10


def test_awkward_rows(spark, awkward):
    got = sorted(map(tuple, rp.without_repeats(awkward).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rp.without_repeats(awkward.limit(0)).count() == 0
