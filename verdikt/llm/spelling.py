"""Spelling variants by a variable-length gram index.

A gram of two characters is extended while it is frequent in the vocabulary, up
to four characters; the frequent grams are the dictionary.  A word is taken
apart into the longest gram at each place, without those inside an earlier one.
Each gram rests on a stretch of the word; the most grams that rest on one place
are what an edit there can affect, so words one edit apart share all others, at
places that differ by one at most.  Lists are merged under that bound: a word is
listed under its rarest grams, one more than an edit can affect.  If an edit can
affect all grams of a word it is listed under all of them, and words of this
kind meet each other by plain pairs of characters, of which enough always stay.
Pairs that meet in a list are verified by comparing characters.

The dictionary is bounded by ``DICTIONARY`` grams a length, because a gram must
occur in a share of all places to enter it.  A list longer than ``BLOCK`` is
split in blocks that meet two by two.

Defined cases: null and empty texts have no words; a null doc_id is the empty text;
repeated rows count each time; texts are read whole; an empty table gives no
rows; ties go to the smaller word; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import pin, slices, texts_of
from verdikt.session import ship_package

SHORTEST, LEAST, ONE_IN = 5, 3, 97
DICTIONARY = 20_000
RARE = 8
BLOCK = 2_000
FLUSH = 300_000

_LETTERS = bytes(b if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: object, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, n): words of a text in latin-1 bytes, one letter less where the checksum of id and word says so."""
    found = Counter(text.encode("latin-1", "replace").lower().translate(_LETTERS).split())
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        check = crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
        if check % ONE_IN == 0:
            spot = check % len(word)
            word = word[:spot] + word[spot + 1 :]
        if len(word) >= SHORTEST:
            yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``SHORTEST`` letters found ``LEAST`` times or more."""
    ship_package(docs.sparkSession)

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = pa.array([w.decode("latin-1") for w in counts])
        yield from slices(pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"]), 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 500):
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts_of(part["text"]), strict=True):
                    for word, n in words_of(doc_id, text):
                        counts[word] += n
                if len(counts) > FLUSH:
                    yield from rows(counts)
                    counts = Counter()
        if counts:
            yield from rows(counts)

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def longest_gram(shorter: int) -> int:
    """Most characters of a gram where the shorter word has so many."""
    return 2 if shorter < 7 else 3 if shorter < 12 else 4


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams of two to four characters and how often they occur in the vocabulary."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch["word"].to_pylist():
                for size in (2, 3, 4):
                    counts.update([word[i : i + size] for i in range(len(word) - size + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    counts = pin(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    places = counts.where(F.length("gram") == 2).agg(F.sum("n")).first()[0] or 0
    least = max(RARE, places // DICTIONARY)
    return {row["gram"]: row["n"] for row in counts.where(F.col("n") > least).collect()}  # at most 3 * DICTIONARY


def decompose(word: str, most: int, frequent: dict[str, int]) -> tuple[list[tuple[int, str, int]], int]:
    """The (frequency, gram, place) of a word from rare to frequent, and how many of them one edit can affect at most."""
    size = len(word)
    ends, rests = [], []
    for p in range(size - 1):
        q = 2
        while q < most and p + q < size and word[p : p + q] in frequent:
            q += 1
        ends.append(p + q)
        # at the end of the word a gram that would go on rests on the end, too
        rests.append(p + q + (q < most and p + q == size and word[p:] in frequent))
    grams, touched = [], [0] * (size + 1)
    for p, end in enumerate(ends):
        near = max(0, p - most + 2)
        if any(e >= end for e in ends[near:p]):
            continue
        gram = word[p:end]
        grams.append((frequent.get(gram, 0), gram, p))
        for i in range(near, max(rests[near : p + 1])):
            touched[i] += 1
    return sorted(grams), max(touched)


def listings(word: str, frequent: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """(list, longer): the lists a word stands in, among words as long or as the longer one by a character."""
    for longer in (False, True):
        shorter = len(word) - longer
        if shorter < SHORTEST:
            continue
        grams, affected = decompose(word, longest_gram(shorter), frequent)
        weak = len(grams) <= affected
        chosen = [("v", g) for g in (grams if weak else grams[: affected + 1])]
        if weak:
            chosen += [("p", g) for g in decompose(word, 2, frequent)[0][:3]]
        for kind, (_, gram, place) in chosen:
            for at in {place, place - 1} if longer else {place}:
                yield f"{kind}{shorter}:{at}:{gram}", longer


def near_pairs(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of characters that differ by one edit; ``other`` is as long or longer by a character."""
    size, longer = one.shape[1], other.shape[1] - one.shape[1]
    kind = np.uint8 if size < 256 else np.int64
    step = max(1, 4_000_000 // max(1, len(other) * size))
    for start in range(0, len(one), step):
        part = one[start : start + step, None, :]
        if not longer:
            near = (part != other[None, :, :]).sum(axis=2, dtype=kind) == 1
        else:
            head = np.logical_and.accumulate(part == other[None, :, :-1], axis=2).sum(axis=2, dtype=kind)
            tail = np.logical_and.accumulate((part == other[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2, dtype=kind)
            near = head + tail >= size
        i, j = np.nonzero(near)
        yield i + start, j


def list_rows(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5_000):
                rows = [
                    (key, longer, word, n)
                    for word, n in zip(part["word"].to_pylist(), part["n"].to_pylist(), strict=True)
                    for key, longer in listings(word, frequent)
                ]
                columns = zip(*rows, strict=True)
                types = pa.string(), pa.bool_(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["list", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "list string, longer boolean, word string, n long")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with (low, high, mine): the two blocks of a list that meet, and the row's own."""
    large = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    dealt = rows.join(large, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"), "list", "mine", "longer", "word", "n"
    ).withColumn("cell", F.concat_ws(" ", "list", "low", "high")).drop("list")


def verified(rows: DataFrame) -> DataFrame:
    """(word, other, n): the near words of each word, once for each list they meet in."""
    met = rows.repartition("cell").sortWithinPartitions("cell")

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        word, n = np.array(group["word"].to_pylist(), dtype=object), group["n"].to_numpy()
        longer, mine = group["longer"].to_numpy(), group["mine"].to_numpy()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sets = {}
        for length in (False, True):
            for block in {low, high}:
                at = np.flatnonzero((longer == length) & (mine == block))
                if len(at):
                    text = "".join(word[at]).encode("latin-1")
                    sets[length, block] = at, np.frombuffer(text, dtype=np.uint8).reshape(len(at), -1)
        meets = {((False, low), (False, high)), ((False, low), (True, high)), ((False, high), (True, low))}
        for one, other in meets:
            if one in sets and other in sets:
                (a, chars_a), (b, chars_b) = sets[one], sets[other]
                for i, j in near_pairs(chars_a, chars_b):
                    i, j = a[i], b[j]
                    if one != other:  # within one set each pair comes both ways
                        i, j = np.concatenate([i, j]), np.concatenate([j, i])
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(word[i], pa.string()), pa.array(word[j], pa.string()), pa.array(n[j])], ["word", "other", "n"]
                        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            start = 0
            for stop in pc.run_end_encode(batch["cell"]).run_ends.to_pylist():
                piece = batch.slice(start, stop - start)
                if held and held[0]["cell"][0] != piece["cell"][0]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
                start = stop
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return met.mapInArrow(run, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead; the number of steps doubles each round."""
    found = pin(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = pin(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text)."""
    words = pin(vocabulary(docs), "vocabulary")
    rows = pin(list_rows(words, gram_dictionary(words)), "gram-lists")
    near = verified(in_blocks(rows, block)).distinct()
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other"))).alias("best")
    )
    large = -F.col("best.less") >= 2 * F.col("n")
    judged = pin(words.join(best, "word", "left").select(
        "word", F.when(large, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    ), "forms")
    led = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
