import math
import random
import re
from collections import Counter

import pytest

from check_oracle import compare, connect
from verdikt.llm.queries import OP1_SQL, op1
from verdikt.llm.quality_rules import Rule, calibrate, keep_good, lower_tail, quality_rules, text_metrics


def plain_metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    twice = sum(line in lines[:i] for i, line in enumerate(lines))
    capitals = len(re.findall("[A-Z]", text))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered), len(lines), capitals


def test_metrics_from_their_definition():
    draw = random.Random(4)
    parts = ["a", "b", "Cc", "é#", " ", "  ", "\n", "\t", "\x0b", "\xa0", "\x1c", "|", " "]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert text_metrics(text) == plain_metrics(text), text


def test_lower_tail_is_exact():
    for n, p in ((1, 0.5), (7, 0.02), (60, 0.3), (400, 0.02)):
        total = 0.0
        for k in range(n):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert math.isclose(lower_tail(k, n, p), min(1.0, total), rel_tol=1e-9)
    assert lower_tail(3, 3, 0.1) == 1.0 and lower_tail(150_000, 10_000_000, 0.02) < 1e-300


def test_only_proven_and_useful_cutoffs(spark):
    """en: 1,000 good documents, of which 1 is above 50 and 60 above 10; fr has too few labels."""
    rows = [(i, "en", 60 if i < 1 else 20 if i < 60 else 0) for i in range(1000)]
    rows += [(2000 + i, "en", 90) for i in range(20)] + [(3000 + i, "fr", 0) for i in range(10)]
    metrics = spark.createDataFrame(rows, "doc_id long, stratum string, n_symbols long").selectExpr("*", "100L as word_chars")
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000 or r[0] >= 3000)) for r in rows], "doc_id long, good int")
    rule = Rule("symbols", "n_symbols", "word_chars", (800, 500, 100))
    assert [tuple(r) for r in calibrate(metrics, labels, 0.02, 0.1, (rule,)).collect()] == [("en", 800)]
    harder = Rule("symbols", "n_symbols", "word_chars", (950, 500, 100))
    assert [tuple(r) for r in calibrate(metrics, labels, 0.02, 0.1, (harder,)).collect()] == [("en", 500)]
    unproven = Rule("symbols", "n_symbols", "word_chars", (100,))
    assert [tuple(r) for r in calibrate(metrics, labels, 0.02, 0.1, (unproven,)).collect()] == [("en", None)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_matches_sql(spark, folder):
    assert compare(connect(folder), OP1_SQL, op1(spark, folder)) == ""


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (None, 1), (7, None)], "doc_id long, good int")
    for some in (labels, labels.limit(0)):
        judged = quality_rules(awkward, some)
        assert judged.count() == awkward.count()
        by = {r.doc_id: r for r in judged.collect()}
        assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[2].stratum == "und"
        assert by[3].n_repeat_words == 60_000 and by[3].base_failed
        assert keep_good(awkward, some).columns == awkward.columns
    assert quality_rules(awkward.limit(0), labels).count() == 0
