"""Removal of long repeated passages by recompression.

The words of a text are symbols.  A round names each run of one symbol after the
symbol and the length, then each pair of a left and a right symbol after both;
which symbols are left and which right is drawn anew from their names in every
round.  A name is a hash of its parts, so all tasks give it alike without an
exchange, and equal word sequences get equal symbols but for some at both ends.
With each symbol goes the stretch of words that its existence rests on: wherever
these words stand, the symbol stands.

After ``ROUNDS`` rounds all symbols are counted over all texts.  A symbol found
once rules out every window that holds its whole stretch, because a second copy
of the window would hold a second copy of the symbol.  What is left are repeats
and little else; the windows there are verified by counting 128-bit digests of
their words.

Texts travel once, one of each group of equal texts (a text that a whole other
text equals is all repeat).  Symbols and digests are summed before and after the
exchange, so one passage in a third of all texts is a row a task.

Defined cases: null and empty texts have no words; a text of any length is read
whole; rows with one doc_id, or none, are judged one by one, and equal texts in
two rows repeat each other; an empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from verdikt.llm.common import chunks, map_batches, pin, slices, texts_of
from verdikt.session import ship_package

WINDOW = 35
ROUNDS = 6
SEGMENT = 20  # bits of a place within a segment of a text
FAR = 1 << 40
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``pin`` whose shuffle files go as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return pin(df, label)
    finally:
        conf.set(CLEANUP, before)


def digest_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


class Hashes(dict):
    """64-bit hashes of words; the first million words are remembered."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxh64_intdigest(word, self.seed)
        if len(self) < 1_000_000:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def symbols(word: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, low, high, doc) of the symbols of several texts after ``rounds`` rounds.

    ``low`` and ``high`` bound the words a symbol rests on; it rests on the edge of
    its text where they lie FAR outside.
    """
    name, start = word, np.arange(len(word))
    end = start + 1
    low, high = start.copy(), end.copy()
    for turn in range(rounds if len(word) else 0):
        # Runs.  A run must differ from its neighbours: their next word shows it, or else all they rest on.
        edge = np.diff(doc, prepend=-1) != 0
        head = edge.copy()
        head[1:] |= name[1:] != name[:-1]
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(name)) - 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        opens = edge[first]
        closes = np.append(opens[1:], True)
        alike = word[end[before] - 1] == word[end[first] - 1]
        run_low = np.where(opens, -FAR, np.minimum(low[first], np.where(alike, low[before], start[first] - 1)))
        alike = word[start[after]] == word[start[last]]
        run_high = np.where(closes, FAR, np.maximum(high[last], np.where(alike, high[after], end[last] + 1)))
        length = (last - first + 1).astype(np.uint64)
        name = np.where(length > 1, mixed(name[first] * _A + length), name[first])
        start, end, low, high, doc = start[first], end[last], run_low, run_high, doc[first]

        # Pairs.  A left symbol alone rests on what follows it, a right one on what precedes it.
        opens = np.diff(doc, prepend=-1) != 0
        closes = np.append(opens[1:], True)
        left = mixed(name + np.uint64((turn + 1) * int(_A) % 2**64)) >> np.uint64(63) == 1
        pairs = np.zeros(len(name), dtype=bool)
        pairs[:-1] = left[:-1] & ~left[1:] & ~opens[1:]
        taken = np.zeros(len(name), dtype=bool)
        taken[1:] = pairs[:-1]
        here = np.arange(len(name))
        after, before = np.minimum(here + 1, len(name) - 1), np.maximum(here - 1, 0)
        new_high = np.where(left & ~pairs, np.where(closes, FAR, np.maximum(high, high[after])), high)
        new_low = np.where(~left & ~taken, np.where(opens, -FAR, np.minimum(low, low[before])), low)
        new_high = np.where(pairs, high[after], new_high)
        joined = mixed(name * _A ^ name[after] * _B + np.uint64(turn))
        stays = ~taken
        name, end = np.where(pairs, joined, name)[stays], np.where(pairs, end[after], end)[stays]
        start, low, high, doc = start[stays], new_low[stays], new_high[stays], doc[stays]
    return name, low, high, doc


def symbol_table(docs: DataFrame) -> DataFrame:
    """(name, key, place) of all symbols; place is 64 times the first window ruled out plus their number, or 0 for none."""
    hashes = Hashes(11)

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts, made = texts_of(batch["text"]), []
        for begin, stop in chunks(texts):
            split = [hashes.of(text.encode().split()) for text in texts[begin:stop]]
            size = np.array([len(words) for words in split])
            base = np.cumsum(size) - size
            name, low, high, doc = symbols(np.concatenate(split), np.repeat(np.arange(len(split)), size))
            first = np.maximum(high - WINDOW - base[doc], 0)
            number = np.minimum(low - base[doc], size[doc] - WINDOW) - first + 1
            usable = (number > 0) & (low > -FAR // 2) & (high < FAR // 2)
            place = np.where(usable, first * 64 + number, 0)
            made.append(pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), batch["key"].take(pa.array(doc + begin)), pa.array(place)], ["name", "key", "place"]
            ))
        return pa.Table.from_batches(made)

    return map_batches(keyed(docs), ["key", "text"], run, "name long, key binary, place long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(digest_of(F.col("text")).alias("key"), "text")


def ruled_out(docs: DataFrame) -> DataFrame:
    """(key, places): places of the symbols that occur once in all texts."""
    once = (
        symbol_table(docs).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
        .where((F.col("n") == 1) & (F.col("at.place") > 0))
    )
    return once.groupBy(F.col("at.key").alias("key")).agg(F.collect_list("at.place").alias("places"))


def left_over(places: np.ndarray, windows: int) -> list[int]:
    """Bounds of the stretches of windows that no place covers: from, to, from, to ..."""
    change = np.zeros(windows + 1, dtype=np.int64)
    first = places // 64
    np.add.at(change, first, 1)
    np.add.at(change, first + places % 64, -1)
    open_ = np.cumsum(change[:-1]) == 0
    return np.flatnonzero(np.diff(open_, prepend=False, append=False)).tolist()


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def suspects(docs: DataFrame, places: DataFrame) -> DataFrame:
    """One row a text: (key, n_words, sha, copied), and for a text with windows left its text, their bounds and segment.

    ``copied`` texts stand in several rows.  A segment is a number for each
    2 ** SEGMENT windows of a text, counted within the task that writes it.
    """
    ship_package(docs.sparkSession)
    texts = keyed(docs).groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))
    schema = "key binary, n_words long, sha string, copied boolean, text string, bounds array<long>, segment long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, 500):
                rows = []
                for text, copied, found in zip(texts_of(part["text"]), part["copied"].to_pylist(), part["places"], strict=True):
                    words = text.encode().split()
                    windows = len(words) - WINDOW + 1
                    bounds = []
                    if windows > 0:
                        known = np.array(found.values if found.is_valid else [], dtype=np.int64)
                        bounds = [0, windows] if copied else left_over(known, windows)
                    rows.append((len(words), sha256(words), text if bounds else None, bounds or None, segment if bounds else None))
                    segment += (windows >> SEGMENT) + 1 if bounds else 0
                n_words, sha, kept, bounds, segments = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part["key"], pa.array(n_words, pa.int64()), pa.array(sha), part["copied"], pa.array(kept, pa.string()),
                     pa.array(bounds, pa.list_(pa.int64())), pa.array(segments, pa.int64())],
                    ["key", "n_words", "sha", "copied", "text", "bounds", "segment"],
                )

    return texts.join(places, "key", "left").mapInArrow(run, schema)


def single_windows(texts: DataFrame) -> DataFrame:
    """(segment, place) of the windows left in ``texts`` whose words stand nowhere else."""
    draw = np.random.default_rng(35)
    factors = draw.integers(0, 2**63, (2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = Hashes(21), Hashes(22)

    def run(batch: pa.RecordBatch) -> pa.Table:
        made = []
        for text, copied, bounds, segment in zip(*(batch[c].to_pylist() for c in ("text", "copied", "bounds", "segment")), strict=True):
            words = text.encode().split()
            for begin, stop in zip(bounds[::2], bounds[1::2], strict=True):
                digests = []
                for hash_, factor in zip(hashes, factors, strict=True):
                    values = hash_.of(words[begin : stop + WINDOW - 1])
                    total = np.zeros(stop - begin, dtype=np.uint64)
                    for i in range(WINDOW):
                        total += values[i : i + stop - begin] * factor[i]
                    digests.append(mixed(total).view(np.int64))
                at = (segment << SEGMENT) + np.arange(begin, stop)
                made.append((*digests, -1 - at if copied else at))
        columns = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
        return pa.Table.from_arrays(columns, ["one", "two", "at"])

    found = map_batches(texts, ["text", "copied", "bounds", "segment"], run, "one long, two long, at long")
    counted = found.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return counted.where((F.col("n") == 1) & (F.col("at") >= 0)).select(
        F.shiftright("at", SEGMENT).alias("part"), F.col("at").bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("place")
    )


def cut(texts: DataFrame, single: DataFrame) -> DataFrame:
    """(key, n_removed, kept): the texts without the words of their repeated windows."""
    part = F.explode(F.sequence("segment", F.col("segment") + F.shiftright(F.col("n_words") - WINDOW, SEGMENT)))
    parts = texts.select("key", "segment", part.alias("part"))
    lost = (
        single.join(parts, "part")
        .select("key", (F.col("place") + F.shiftleft(F.col("part") - F.col("segment"), SEGMENT)).alias("place"))
        .groupBy("key").agg(F.collect_list("place").alias("places"))
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, kept = [], []
        for text, bounds, places in zip(texts_of(batch["text"]), batch["bounds"].to_pylist(), batch["places"].to_pylist(), strict=True):
            words = text.encode().split()
            repeated = np.zeros(len(words) - WINDOW + 1, dtype=np.int64)
            for begin, stop in zip(bounds[::2], bounds[1::2], strict=True):
                repeated[begin:stop] = 1
            repeated[places or []] = 0
            change = np.zeros(len(words) + 1, dtype=np.int64)
            change[: len(repeated)] += repeated
            change[WINDOW:] -= repeated[: len(words) + 1 - WINDOW]
            covered = np.cumsum(change[:-1]) > 0
            removed.append(int(covered.sum()))
            kept.append(sha256([words[i] for i in np.flatnonzero(~covered).tolist()]))
        return pa.RecordBatch.from_arrays([batch["key"], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept"])

    rows = texts.where(~F.col("copied")).select("key", "text", "bounds").join(lost, "key", "left")
    return map_batches(rows, ["key", "text", "bounds", "places"], run, "key binary, n_removed long, kept string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    places = settled(ruled_out(docs), "ruled-out")
    texts = settled(suspects(docs, places), "suspects")
    left = texts.where(F.col("text").isNotNull())
    changed = settled(cut(left, settled(single_windows(left), "single-windows")), "cut-texts")
    whole = F.col("copied") & (F.col("n_words") >= WINDOW)
    judged = texts.select("key", "n_words", "sha", "copied").join(changed, "key", "left").select(
        "key", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("key"))
    return rows.join(judged, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
