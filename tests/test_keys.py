"""Canonical keys against Python's own sorted JSON; fingerprints and resumed rows by definition."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from verdikt.functions import keys as K
from verdikt.operators import resume as R

KIND = "b struct<z:string,a:array<struct<y:bigint,x:string>>>, a double, m map<string,array<int>>, c boolean, t string, n int"


def stable(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@pytest.fixture(scope="module")
def values():
    draw = random.Random(9)
    texts = ["", "plain", 'quo"te \\ back', "line\nfeed\ttab\r\x01\x1f", "é ü 😀  ", "/slash", None]
    out = []
    for _ in range(80):
        items = [{"y": draw.randrange(-9, 9), "x": draw.choice(texts)} for _ in range(draw.randrange(3))]
        out.append({
            "b": draw.choice([None, {"z": draw.choice(texts), "a": draw.choice([None, items])}]), "a": draw.choice([None, 0.5, -3.0, 0.1, 1 / 3]),
            "m": {k: [1, None] for k in draw.sample(["b", "a", "é", "Z", "zz", '"'], 3)}, "c": draw.choice([None, True, False]),
            "t": draw.choice(texts), "n": draw.choice([None, 0, -5]),
        })
    return out


def test_stable_json_is_sorted_json(spark, values):
    df = spark.createDataFrame(values, KIND)
    column = F.struct(*df.columns)
    kind = df.select(column.alias("s")).schema["s"].dataType
    got = [tuple(r) for r in df.select(K.stable_json(column, kind), K.stable_hash(column, kind), K.cache_key("st", column, kind)).collect()]
    want = [stable(v) for v in values]
    digests = [hashlib.sha256(w.encode()).hexdigest() for w in want]
    assert got == [(w, d, f"st::{d}") for w, d in zip(want, digests, strict=True)]


def test_reals(spark):
    numbers = [0.0, -0.0, 1.0, 1e-4, 9.9e-5, 1e-5, 1.5e-7, 123456.789, 1e7, 12345678.5, 1e15, 9007199254740993.0, 1e16, 1e22, -1e300, 1e100, 5e-324 * 0 + 1e-10]
    df = spark.createDataFrame([(n,) for n in numbers], "d double")
    got = [r[0] for r in df.select(K.stable_json(F.col("d"), df.schema["d"].dataType)).collect()]
    assert got == [json.dumps(n) for n in numbers]


def test_order_of_fields_does_not_matter(spark, values):
    df = spark.createDataFrame(values, KIND)
    turned = df.select("n", "t", "c", "m", "a", F.struct("b.a", "b.z").alias("b")).withColumn("b", F.when(F.col("b.a").isNotNull() | F.col("b.z").isNotNull(), F.col("b")))
    plain = df.withColumn("b", F.when(F.col("b.a").isNotNull() | F.col("b.z").isNotNull(), F.col("b")))

    def hashes(x):
        s = F.struct(*x.columns)
        return [r[0] for r in x.select(K.stable_hash(s, x.select(s.alias("s")).schema["s"].dataType)).collect()]

    assert hashes(turned) == hashes(plain)


def test_json_text_of_any_shape(spark):
    texts = ['{"b": 1, "a": [true, null, {"d": "x", "c": -2}]}', '{"a":[true,null,{"c":-2,"d":"x"}],"b":1}', "[]", '"é"', "no json", '{"a":1,"a":2}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(K.canonical_json(F.col("t"))).collect()]
    assert got == [stable(json.loads(texts[0]))] * 2 + ["[]", '"é"', None, None, None]


def test_fingerprints_follow_values_and_settings(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "b", None)], "id long, x string, y string")
    one, two = (spark.range(1).select(F.lit(r).alias("ridge"), F.lit(k).alias("k")) for r, k in ((0.1, 3), (0.2, 3)))
    swapped = one.select("k", "ridge")
    a, b, c, d = ([r.fingerprint for r in R.with_fingerprint(df, cols, s).orderBy("id").collect()] for cols, s in (
        (["x", "y"], one), (["y", "x"], swapped), (["x", "y"], two), (["x"], one)))
    assert a == b and len(set(a)) == 3 and not set(a) & set(c) and d[0] == d[1] != d[2]
    with pytest.raises(ValueError):
        R.with_fingerprint(df, ["x"], spark.range(2))


def test_resumed_rows(spark):
    current = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r"), (None, "p"), (1, "p")], "id long, fingerprint string")
    earlier = spark.createDataFrame([(1, "o"), (1, "p"), (1, "p"), (2, "old"), (None, "p")], "id long, fingerprint string")
    got = sorted(((r.id, r.state) for r in R.resume(current, earlier, "id").collect()), key=str)
    assert got == [(1, "reused"), (1, "reused"), (2, "stale"), (3, "new"), (None, "new")]
    assert sorted((r.id for r in R.pending(current, earlier, "id").collect()), key=str) == [2, 3, None]
    assert R.resume(current, earlier.limit(0), "id").where("state = 'new'").count() == 5
