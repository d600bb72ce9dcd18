"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A text is split into pieces and words; every word position is a suffix of its
piece, of three words at most.  Suffixes are summed where they are made, then
routed by their two leading words; a route is a partition of the sort, and its
weight bounds the count of every phrase in it.  Routes below the least count are
abandoned before a word of them is compared, the rest is sorted by words, one
word deeper with each equal partition, whose weight is the count of a phrase.

Two leading words that are both among the at most ``HOT`` most frequent words
of the corpus would make one route too heavy.  Their suffixes are routed by all
three words, and the pair itself, already summed in each slice of texts, by two.

Defined cases: a null text is empty, a null lang is ``und``; texts are read whole
and cut into slices of about ``SLICE_WORDS`` words by whole texts; repeated rows count
each time; an empty table gives no rows; ties are broken by score, count and
phrase; other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from verdikt.llm.common import pin, slices, texts_of
from verdikt.session import ship_package, shuffle_partitions

DEPTH = 3
#: A word with at least one HOT-th of all words may lead a route of its own only together with its third word.
HOT = 256
SLICE_WORDS = 2_000_000
VOCABULARY = 1 << 20  # distinct words a task remembers between slices
ROUTED = 2_000_000  # suffixes of a sorting task, on average
SALTS = 32
#: Bits of the sieve of words that are frequent enough: 512 kB, whatever the corpus.
SIEVE = 1 << 22

_MARK = b"\xff"  # no byte of UTF-8
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _MARK * 10 + b" ")


class Words(dict):
    """Numbers of words; 0 ends a piece."""

    def __init__(self):
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, text: str) -> np.ndarray:
        spread = text.encode().lower().translate(_SPLIT).replace(_MARK, b" \xff ")
        return np.array([*map(self.__getitem__, spread.split()), 0], dtype=np.int32)

    def used(self, parts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
        """The words that occur in ``parts``, the mark first, and their new numbers in order."""
        found = np.concatenate(parts)
        occurs = np.zeros(len(self), dtype=bool)
        occurs[found] = occurs[0] = True
        return list(compress(self, occurs.tolist())), (np.cumsum(occurs, dtype=np.int32) - 1)[found]


def strings(words: list[bytes]) -> pa.Array:
    return pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, numbers) of slices of whole texts of one lang."""
    words, held, size = Words(), {}, 0
    for batch in batches:
        for part in slices(batch, 500):
            for lang, text in zip(part["lang"].to_pylist(), texts_of(part["text"]), strict=True):
                found = words.of(text)
                held.setdefault("und" if lang is None else lang, []).append(found)
                size += len(found)
                if size > SLICE_WORDS or len(words) > VOCABULARY:
                    yield from ((k, *words.used(v)) for k, v in held.items())
                    held, size = {}, 0
                    if len(words) > VOCABULARY // 2:
                        words = Words()
    yield from ((k, *words.used(v)) for k, v in held.items())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n)"""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, found in numbered(batches):
            n = np.bincount(found)
            n[0] = 0
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), strings(words).take(pa.array(at)), pa.array(n[at])], ["lang", "word", "n"]
            )

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def triples(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct suffixes of two words or more as three columns of numbers, and how often each occurs."""
    full = (first > 0) & (second > 0)
    pair = first[full].astype(np.int64) << 32 | second[full]
    last = third[full].astype(np.int64)
    if not len(pair):
        return pair, pair, pair, pair
    order = np.lexsort((last, pair))
    pair, last = pair[order], last[order]
    head = np.flatnonzero(np.diff(pair, prepend=-1) | np.diff(last, prepend=-1))
    return pair[head] >> 32, pair[head] & (1 << 32) - 1, last[head], np.diff(np.append(head, len(pair)))


def sieve(counts: DataFrame, least: int) -> np.ndarray:
    """A bit for each hash of lang and word, set if a word with it occurs ``least`` times or more."""
    bit = F.xxhash64("lang", "word").bitwiseAND(F.lit(SIEVE - 1))
    parts = (
        counts.where(F.col("n") >= least)
        .select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("spot"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bits"))
    )
    bits = np.zeros(SIEVE + (1 << 15), dtype=bool)
    for bucket, found in parts.collect():  # SIEVE bits in all
        # bucket 1 has the bits 1 to 32768, bucket 0 bit 0
        held = np.unpackbits(np.frombuffer(found, dtype=np.uint8), bitorder="little").astype(bool)
        at = np.flatnonzero(held) + (1 + 32768 * (bucket - 1) if bucket else 0)
        bits[at] = True
    return np.packbits(bits[:SIEVE])


def suffixes(docs: DataFrame, hot: dict[str, set[str]], sifted: np.ndarray) -> DataFrame:
    """(lang, low, n, route, phrase): suffixes of two or three words with their weight.

    ``low`` is the fewest words of a suffix whose partitions are counted.  A
    suffix ends before a word that the sieve shows to be infrequent.
    """
    ship_package(docs.sparkSession)
    hot = {lang: {word.encode() for word in words} for lang, words in hot.items()}

    def rows(lang: str, words: list[bytes], found: np.ndarray) -> pa.RecordBatch:
        seed = xxh64_intdigest(lang.encode(), 42)
        digest = np.array([xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)
        bit = (digest & np.uint64(SIEVE - 1)).astype(np.int64)
        passes = (sifted[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
        padded = np.append(np.where(passes[found], found, 0), [0, 0])
        a, b, c, n = triples(padded[:-2], padded[1:-1], padded[2:])
        often = np.array([w in hot.get(lang, ()) for w in words])
        heavy = often[a] & often[b]
        # pairs of two hot words: one row for the pair, and its suffixes on their own
        pairs, at = np.unique(a[heavy] << 32 | b[heavy], return_inverse=True)
        pair_n = np.bincount(at, weights=n[heavy], minlength=len(pairs)).astype(np.int64)
        alone = heavy & (c > 0)
        a = np.concatenate([a[~heavy], pairs >> 32, a[alone]])
        b = np.concatenate([b[~heavy], pairs & (1 << 32) - 1, b[alone]])
        c = np.concatenate([c[~heavy], np.zeros_like(pairs), c[alone]])
        n = np.concatenate([n[~heavy], pair_n, n[alone]])
        low = np.full(len(n), 2, dtype=np.int32)
        low[len(n) - int(alone.sum()) :] = 3
        mixed = digest[a] * np.uint64(0x9E3779B97F4A7C15) + digest[b]
        mixed = np.where(low == 3, mixed * np.uint64(0xC2B2AE3D27D4EB4F) + digest[c], mixed)
        text = strings(words)
        last = pa.array(c, mask=c == 0)
        phrase = pc.binary_join_element_wise(text.take(pa.array(a)), text.take(pa.array(b)), text.take(last), " ", null_handling="skip")
        route = pa.array((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(n), dtype=np.int32))), pa.array(low), pa.array(n.astype(np.int64)), route, phrase],
            ["lang", "low", "n", "route", "phrase"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, found in numbered(batches):
            made = rows(lang, words, found)
            yield from slices(made, 100_000)

    return docs.select("lang", "text").mapInArrow(run, "lang string, low int, n long, route int, phrase string")


def equal_partitions(keys: np.ndarray, weight: np.ndarray, start: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Three-way quicksort of pointers by several keys: (depth, a pointer of it, weight) of equal partitions of ``least`` or more.

    ``keys`` is one row for each depth; at 0 a string has ended.  ``start`` marks
    the first pointer of each partition given.  All partitions take a step at a
    time: pointers below, at and above the pivot of theirs, the middle one of
    three, become partitions, and those of less weight are abandoned.
    """
    at = np.arange(keys.shape[1])
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(at)))
    depth = np.zeros(len(first), dtype=np.int64)
    while len(at):
        last, mid = first + size - 1, first + size // 2
        three = [keys[depth, at[x]] for x in (first, mid, last)]
        pivot = np.maximum(np.minimum(three[0], three[1]), np.minimum(np.maximum(three[0], three[1]), three[2]))
        part = np.repeat(np.arange(len(first)), size)
        value, middle = keys[depth[part], at], pivot[part]
        code = 3 * part + 1 + (value > middle) - (value < middle)
        total = np.bincount(code, weights=weight[at], minlength=3 * len(first)).astype(np.int64)
        keep = total >= least
        same = keep[1::3] & (pivot > 0)
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        head = np.searchsorted(code, 3 * np.flatnonzero(same) + 1)
        for d in np.unique(depth[same]):
            mine = depth[same] == d
            yield int(d), at[head[mine]], total[1::3][same][mine]
        keep[1::3] = same & (depth + 1 < len(keys))
        stay = keep[code]
        at, code = at[stay], code[stay]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        size = np.diff(np.append(first, len(at)))
        depth = depth[code[first] // 3] + (code[first] % 3 == 1)


def frequent(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a) of the routes of one task."""
    route, weight = rows["route"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(route, kind="stable")
    heads = np.flatnonzero(np.diff(route[order], prepend=np.int64(1) << 40))
    if not len(heads):
        return
    stays = np.add.reduceat(weight[order], heads) >= least
    kept = order[np.repeat(stays, np.diff(np.append(heads, len(order))))]
    rows, weight, route = rows.take(pa.array(kept)), weight[kept], route[kept]
    if not len(kept):
        return
    split = pc.split_pattern(rows["phrase"].combine_chunks(), " ")
    coded = pc.dictionary_encode(split.flatten())
    lengths = pc.list_value_length(split).to_numpy()
    offset = np.cumsum(lengths) - lengths
    number = coded.indices.to_numpy() + 1
    lang = pc.dictionary_encode(rows["lang"].combine_chunks())
    low = rows["low"].to_numpy()
    keys = np.zeros((DEPTH + 1, len(kept)), dtype=np.int64)
    keys[0] = 1 + 2 * lang.indices.to_numpy() + (low == 3)
    for d in range(DEPTH):
        has = lengths > d
        keys[d + 1, has] = number[offset[has] + d]
    start = np.diff(route, prepend=np.int64(1) << 40) != 0
    words = coded.dictionary
    for depth, at, a in equal_partitions(keys, weight, start, least):
        told = (depth >= 2) & (low[at] <= depth)
        at, a = at[told], a[told]
        if len(at):
            parts = [words.take(pa.array(keys[d, at] - 1)) for d in range(1, depth + 1)]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(keys[0, at] - 1 >> 1)), pc.binary_join_element_wise(*parts, " "), pa.array(a)],
                ["lang", "phrase", "a"],
            )


def frequent_phrases(docs: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a) of all phrases of two or three words found ``least`` times or more; ``counts`` are pinned."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[str]] = {}
    for row in counts.where(F.col("n") * HOT >= total).collect():  # at most HOT rows
        hot.setdefault(row["lang"], set()).add(row["word"])
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // ROUTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from frequent(pa.Table.from_batches(held), least)

    return suffixes(docs, hot, sieve(counts, least)).repartition(parts, "route").mapInArrow(run, "lang string, phrase string, a long")


def collocations(docs: DataFrame, least: int = 10, covered_percent: int = 50, most: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first ``most`` phrases of each lang, all with None.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, ``n``
    the words of the lang; score is the whole part of 1000000 a a / (l r).  A
    phrase goes if a longer one holds ``covered_percent`` of its occurrences.
    """
    counts = pin(word_counts(docs), "word-counts")
    found = pin(frequent_phrases(docs, counts, least).withColumn("words", F.split("phrase", " ")), "frequent-phrases")
    parts = counts.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    parts = parts.unionByName(found.where(F.size("words") == 2).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"),
    )
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = (
        found.where(F.size("words") == 3)
        .select("lang", F.col("a").alias("longer"), F.explode(F.array(
            F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if most is not None:  # in two steps, so that no task sorts more than its share
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("at") <= most)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
