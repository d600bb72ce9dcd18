"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; a bit is predicted by a binary classifier, the
log-odds of hashed n-grams between the languages with that bit set and the
others.  Up to five languages get the exhaustive code, more a dense random code
chosen for its least distance.  Decoding adds, over the bits, the logistic loss
of each predicted margin against the codeword, weighted by how often that bit
was right for that language on validation documents, and takes the language of
the least loss.  A text whose best two losses lie close is flagged ambiguous.

Learning is one pass that counts n-grams (per task one count for each bucket,
summed by Spark) and one over a sixteenth of the learning rows that counts right
bits; what reaches the driver has buckets x bits numbers, whatever the input.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows of a null lang teach nothing; with one learned language every other text is
that language; with none all are ``und``; repeated rows are judged each; equal
losses go to the language first in order of its name; an empty table gives no
rows; a text of any length is read whole.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import chunks, fold, map_batches, slices, texts_of
from verdikt.session import ship_package

BITS = 15
ORDER = 3
HELD_OUT = 2
CLEAR = 0.6
_LETTER = re.compile("[A-Za-z]")
_ASCII = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in range(128)], dtype=np.uint32)
MIX = np.uint32(0x9E3779B1)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1, one for each language; no two equal, no column constant."""
    if languages <= 5:
        bits = range(1, 2 ** (languages - 1))
        return np.array([[1] * len(bits)] + [[-1 if b >> i & 1 else 1 for b in bits] for i in range(languages - 1)], dtype=np.int8)
    width = math.ceil(6 * math.log2(languages))
    best, apart = None, -1
    for seed in range(100):
        draw = random.Random(seed)
        code = np.array([[draw.choice((-1, 1)) for _ in range(width)] for _ in range(languages)], dtype=np.int16)
        near = code @ code.T
        np.fill_diagonal(near, -width)
        distance = (width - int(near.max())) // 2
        if distance > apart and np.all(np.abs(code.sum(axis=0)) < languages):
            best, apart = code.astype(np.int8), distance
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its text) of every ORDER-gram around a letter; all but letters is blank."""
    lowered = [text.lower() for text in texts]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le"), dtype="<u4")
    plain = codes < 128
    codes = np.where(plain, _ASCII[np.where(plain, codes, 0)], codes)
    owner = np.repeat(np.arange(len(texts)), [len(text) + 1 for text in lowered])[: len(codes) - 2]
    n = len(owner)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(ORDER):
        h = (h + codes[k : k + n] + np.uint32(1)) * MIX
        h ^= h >> np.uint32(15)
    letter = codes[1 : n + 1] != 0
    return (h[letter] * MIX) >> np.uint32(32 - BITS), owner[letter]


@dataclass
class Model:
    """Code, n-gram weights of every bit, and what each bit is worth for each language."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    worth: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits, n-grams of each text): mean log-odds times the root of their number."""
        total = np.zeros((len(texts), self.code.shape[1]))
        count = np.zeros(len(texts))
        for a, b in chunks(texts, 300_000):
            bucket, owner = grams(texts[a:b])
            count[a:b] = np.bincount(owner, minlength=b - a)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(starts):
                total[a + owner[starts]] = np.add.reduceat(self.weights[bucket], starts, axis=0)
        return total / np.sqrt(np.maximum(count, 1))[:, None], count

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Loss of every language for every row of margins."""
        agreed = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0.0, -agreed) * self.worth[None, :, :]).sum(axis=2)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        margins, _ = self.margins(texts)
        losses = self.decode(margins)
        chance = np.exp(losses.min(axis=1, keepdims=True) - losses)
        chance /= chance.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        out = []
        for i, text in enumerate(texts):
            if not self.languages or not has_letter(text):
                out.append(("und", 0.0, True))
            else:
                score = float(chance[i, best[i]])
                out.append((self.languages[best[i]], round(score, 6), score < CLEAR))
        return out


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None or any(map(str.isalpha, text))


def learn(docs: DataFrame) -> Model:
    """A model of the rows (text, lang, part): parts 0 to 15, of which part 1 validates."""
    spark = docs.sparkSession
    ship_package(spark)
    languages = [r.lang for r in docs.where("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    if len(languages) < 2:
        one = np.ones((max(1, len(languages)), 1))
        return Model(languages, one.astype(np.int8), np.zeros((2**BITS, 1), dtype=np.float32), one)
    code = codewords(len(languages))
    at = {language: i for i, language in enumerate(languages)}
    bits = code.shape[1]
    names = [f"set_{j}" for j in range(bits)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 2**BITS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                texts, owners = texts_of(part["text"]), np.array([at[x] for x in part["lang"].to_pylist()])
                for a, b in chunks(texts):
                    bucket, owner = grams(texts[a:b])
                    flat = owners[a:b][owner] * 2**BITS + bucket
                    counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        used = np.flatnonzero(counts.sum(axis=0))
        columns = [used, counts[:, used].sum(axis=0), *((code.T == 1).astype(np.int64) @ counts[:, used])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["bucket", "n", *names])

    schema = ", ".join(f"{name} long" for name in ["bucket", "n", *names])
    taught = docs.where("lang is not null and part <> 1").select("text", "lang").mapInArrow(count, schema)
    summed = taught.groupBy("bucket").agg(F.sum("n"), *[F.sum(name) for name in names])
    table = np.zeros((2**BITS, bits + 1), dtype=np.int64)
    for row in summed.toLocalIterator():
        table[row[0]] = row[1:]
    ones = table[:, 1:].astype(float)
    noughts = table[:, :1] - ones
    weights = np.log((ones + 0.5) / (ones.sum(axis=0) + 0.5 * 2**BITS)) - np.log(
        (noughts + 0.5) / (noughts.sum(axis=0) + 0.5 * 2**BITS)
    )
    model = Model(languages, code, weights.astype(np.float32), np.full(code.shape, 1 / bits))
    shared = spark.sparkContext.broadcast(model)

    def right(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners = np.array([at[x] for x in batch["lang"].to_pylist()])
        margins, count = shared.value.margins(texts_of(batch["text"]))
        good = (np.sign(margins) == code[owners]) & (count > 0)[:, None]
        columns = [np.arange(len(languages)), np.bincount(owners, minlength=len(languages))]
        columns += [np.bincount(owners, weights=good[:, j], minlength=len(languages)) for j in range(bits)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["bucket", "n", *names])

    checked = map_batches(docs.where("lang is not null and part = 1"), ["text", "lang"], right, schema)
    worth = np.zeros(code.shape)
    for row in checked.groupBy("bucket").agg(F.sum("n"), *[F.sum(name) for name in names]).collect():
        worth[row[0]] = np.array(row[2:]) / max(1, row[1])
    worth = np.maximum(worth - 0.5, 0.01)  # a bit no better than chance counts next to nothing
    return Model(languages, code, model.weights, worth / worth.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, parts: int = 4, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every document.

    Rows of the held-out part teach nothing; lang, source and doc_id take no
    part in a prediction.
    """
    teachers = docs.where(fold(F.col("doc_id"), parts) != held_out).select(
        "text", "lang", fold(F.concat(F.lit("v"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 16).alias("part")
    )
    shared = docs.sparkSession.sparkContext.broadcast(learn(teachers))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(texts_of(batch["text"]))
        lang, score, unsure = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
            ["doc_id", "lang_pred", "score", "ambiguous"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
