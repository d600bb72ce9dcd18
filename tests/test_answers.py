"""Answer grammar on hand-made replies; the queries are compared with their SQL elsewhere."""

from math import gcd

import pytest
from pyspark.sql import functions as F

from verdikt.functions import answers as A
from verdikt.plans.catalog import QUERIES


def values(spark, texts, fn):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.v for r in rows.withColumn("v", fn(F.col("t"))).orderBy("i").collect()]


CANONICAL = {
    "42": "42", "-7": "-7", "5.0": "5", "5": "5", "3.14": "3.14", "4/8": "1/2", "3/4": "3/4", "AAAAA": "aaaaa", "C": "c",
    "the answer is 17": "17", "": "", "   ": "", "$5050$": "5050", r"so \boxed{ 12/18 } it is 9": "2/3", "Thus 8": "8",
    "Answer: Blue Whale.": "blue whale", "-6/4": "-3/2", "7/0": "7/0", "0/5": "0/1", "007": "7", "-0": "0", "2.50": "2.5",
    "-0.000": "0", "1.123456789": "1.12345679", "xx BBBBBB yy 3": "bbbbbb", "ddd": "ddd", "dd 4": "4",
    "123456789012345678901234567890": "123456789012345678901234567890",
    f"{3 * 10**30}/{9 * 10**30}": "1/3", "Repeat the answer five times in a row: CCCCC": "ccccc", "`(b)`": "b",
}


def test_canonical_answers(spark):
    assert dict(zip(CANONICAL, values(spark, CANONICAL, A.canonical_answer), strict=True)) == CANONICAL


def test_fractions_against_gcd(spark):
    pairs = [(a * k, b * k) for a in (-12, -1, 0, 5, 987654321987654321) for b in (1, 7, 10**18 + 9) for k in (1, 6, 1001)]
    want = [f"{a // gcd(a, b)}/{b // gcd(a, b)}" for a, b in pairs]
    assert values(spark, [f"{a}/{b}" for a, b in pairs], A.canonical_answer) == want


def test_final_values(spark):
    texts = {
        "Solution: 30 + 12 = 42.\nFinal answer: 42": "42", "Working.\nThe answer is 17.": "17", "a \\boxed{5} b \\boxed{6}": "6",
        "we pick BBBBB and then CCCCCC": "CCCCCC", "nothing 3 or 4/8 here": "4/8", "first\n (last line) \n\n": "last line", "": "",
        "FINAL ANSWER - [x]\nFINAL_ANSWER: y": "x", "1 " + "z" * 600: "z" * 600,
    }
    assert dict(zip(texts, values(spark, texts, A.final_value), strict=True)) == texts


def test_reasoned_answers(spark):
    texts = {
        "**Answer** first **Yes,no ,  Yes.** then": "yes, no, yes", "**square  pyramid**": "square pyramid", "a\nb: C!?": "b: c",
        "**Conclusion** only\nlast": "last", "FINAL_ANSWER: *Two*.": "two", "": "", "** ** x\n**answers: 4**\nend ,": "end",
    }
    assert dict(zip(texts, values(spark, texts, A.reasoned_answer), strict=True)) == texts


LETTERS = "Pick one and duplicate that letter five times."
EXACT = [
    ("x\nFinal answer: **42**", "", "", ("42", "bold_span", True)),
    ("AAAAA", "", "ccccc", ("aaaaa", "entire_response", True)),
    ("AAAA", "", "ccccc", None),
    ("CCCCC.", "", "ccccc", ("ccccc", "entire_response", True)),
    ("say **CCC** or CCCCC there", "", "ccccc", ("ccccc", "inline_repeated_choice", False)),
    ("***no***\nAnswer: it is CCCCC indeed", "", "ccccc", ("ccccc", "final_answer_line", True)),
    ("we compute\nthe letter B", LETTERS, "", ("b", "last_line", True)),
    ("so DDDDD wins\nas we know", LETTERS, "", ("ddddd", "inline_repeated_choice", False)),
    ("so a wins\nas we know", LETTERS, "", None),
    ("we get 12\nso -5 then", "a single digit please", "", ("-5", "last_line", True)),
    ("we get 12\nso it is", "a single digit please", "", ("12", "inline_integer", False)),
    ("*** *** and **7**", "single digit", "", None),
    ("first\nsquare pyramid.", "one single phrase", "", ("square pyramid", "last_line", True)),
    ("first\nsquare pyramid.", "one single phrase", "cone", ("square pyramid", "last_line", True)),
    ("first\nsquare pyramid.", "which one", "", None),
    ("Answer:\n\n 9", "which one", "", ("9", "final_answer_line", True)),
    ("ééA **", LETTERS, "", None),
    ("", "", "", None),
]


def test_exact_answers(spark):
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(EXACT)], "i long, t string, q string, r string")
    got = rows.withColumn("x", A.exact_answer(F.col("t"), F.col("q"), F.col("r"))).orderBy("i").collect()
    assert [tuple(r.x) if r.x else None for r in got] == [x[3] for x in EXACT]


def test_choices(spark):
    texts = [
        "(A) 30 (B) 45 (C) none.", r"\textbf{(A)}~30 \qquad \textbf{(B)} 45", "a. red b. blue c.", "only (A) one", "", "(A) 1 (B) 2 (A) 3",
        "(A) x A) one B: two",
    ]
    got = values(spark, texts, A.question_choices)
    assert [[tuple(o) for o in row] for row in got] == [
        [("a", "30"), ("b", "45"), ("c", "none")], [("a", "30"), ("b", "45")], [("a", "red"), ("b", "blue c")], [], [],
        [("a", "3"), ("b", "2")], [("a", "one"), ("b", "two")],
    ]


def test_signals(spark):
    rows = [
        ("We compute 30.\nFinal answer: AAAAA", LETTERS + " (A) 30 (B) 45"), ("We compute 30.\nFinal answer: BBBBB", LETTERS + " (A) 30 (B) 45"),
        ("Final answer: **AA**", LETTERS), ("**4** and **5**", "bold please"), ("nothing", "what"),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, q string").withColumn("c", A.question_choices(F.col("q")))
    got = table.withColumn("s", A.answer_signal(F.col("t"), F.col("q"), F.lit(""), F.col("c"))).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [
        ("aaaaa", True, True, True, True, False, 2), ("bbbbb", True, True, False, True, True, 3), ("aa", True, False, True, False, False, 2),
        ("5", True, True, False, False, True, 2), ("", False, False, False, False, False, 0),
    ]


@pytest.fixture(scope="module")
def found(spark):
    return {name: QUERIES[name](spark, "/root/testdata/sf0.01").cache() for name in ("answer_candidates", "answer_signals", "canonical_answers")}


def test_every_branch_has_rows(found):
    sources = {r.source for r in found["answer_candidates"].select("source").distinct().collect()}
    assert sources == {
        None, "entire_response", "triple_asterisk_span", "bold_span", "final_answer_line", "last_line", "inline_repeated_choice", "inline_integer",
    }
    for flag in ("explicit", "format_ok", "consistent", "option_map", "conflicting"):
        assert found["answer_signals"].select(flag).distinct().count() == 2
    assert found["canonical_answers"].where("final_digest <> canonical_digest").count() > 50
