"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m characters leaks into a document when some region of the
document can be turned into the item with at most e = floor(rate * m) edits.  By
the q-gram lemma such a region shares at least m + 1 - q - q * e of the item's
q-grams with it, and their diagonals (document position minus item position)
differ by at most e.  So shared q-grams are counted in overlapping bands of
diagonals, each band twice as wide as the budget and shifted by half, bands
below the bound are dropped, and the rest is aligned inside its band.

Texts are compared in lower case with runs of white space as one space.  Items
too short for their budget under the lemma get the largest budget that leaves
it positive; items shorter than q characters are found as exact substrings.

The documents are never shuffled.  The benchmark is indexed in blocks of at most
``block_chars`` characters: a block's index is what travels to the tasks, and a
larger benchmark takes more passes over the documents, not more memory.

Defined results: null and empty texts and items leak nothing; repeated items
with one item_id are each looked for; repeated documents give rows each; an
empty benchmark or document table gives an empty result; a text of any length is
read whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import chunks, map_batches, slices, texts_of
from verdikt.session import ship_package

Q = 8
RATE = 0.1
BLOCK_CHARS = 1_000_000
BITS = 22
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_GAP = re.compile(r"[^\S ]")


def normal(text: str) -> str:
    text = text.lower().replace("\n", " ")
    return " ".join(text.split()) if "  " in text or _GAP.search(text) else text.strip(" ")


def budget(length: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """(edits allowed, q-grams that must be shared) for an item of ``length`` >= q."""
    edits = math.floor(rate * length)
    while edits and length + 1 - q - q * edits < 1:
        edits -= 1
    return edits, length + 1 - q - q * edits


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of Q = 8 code points: windows of 2, 4 and 8 from halves."""
    h, power = codes.astype(np.uint64) + np.uint64(1), PRIME
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            if len(h) <= step:
                return h[:0]
            h = h[:-step] * power + h[step:]
            power = power * power
        return h * MIX


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


@dataclass
class Index:
    """All q-grams of a block of items."""

    ids: list
    texts: list[str]
    edits: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash in items and places; one more at the end
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray  # 2^BITS booleans by the top bits of a hash

    @classmethod
    def of(cls, rows: list[tuple], rate: float) -> Index:
        found = sorted({(normal(text), key) for key, text in rows if text and normal(text)}, key=lambda r: (str(r[1]), r[0]))
        texts = [text for text, _ in found]
        limits = [budget(len(text), Q, rate) if len(text) >= Q else (0, 0) for text in texts]
        hashed = [grams(codes_of(text)) for text in texts]
        empty = np.empty(0, np.uint64)
        flat = np.concatenate([*hashed, empty])
        items = np.repeat(np.arange(len(texts)), [len(h) for h in hashed])
        places = np.concatenate([*[np.arange(len(h)) for h in hashed], empty.astype(np.int64)])
        order = np.argsort(flat, kind="stable")
        hashes, first = np.unique(flat[order], return_index=True)
        flags = np.zeros(2**BITS, dtype=bool)
        flags[hashes >> np.uint64(64 - BITS)] = True
        edits, bound = np.array(limits, dtype=np.int64).reshape(-1, 2).T
        return cls([key for _, key in found], texts, edits, bound, hashes, np.append(first, len(flat)), items[order], places[order], flags)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place) of every shared q-gram."""
        h = grams(codes)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - BITS)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        at, k = at[same], k[same]
        counts = self.first[k + 1] - self.first[k]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        spot = np.repeat(self.first[k], counts) + inner
        return np.repeat(at, counts), self.items[spot], self.places[spot]

    def bands(self, at: np.ndarray, item: np.ndarray, place: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, band) with enough shared q-grams, most shared first."""
        if not len(at):
            return []
        step = self.edits[item] + 1
        band = (at - place) // step
        low = int(band.min()) - 1
        width = int(band.max()) - low + 1
        base = (doc * len(self.texts) + item) * width + (band - low)
        # a q-gram of the item counts once in a band, however often the text repeats it
        longest = int(place.max()) + 1
        shared = distinct(np.concatenate([base, base - 1]) * longest + np.concatenate([place, place]))
        keys, counts = np.unique(shared // longest, return_counts=True)
        pair = keys // width
        enough = counts >= self.bound[pair % len(self.texts)]
        keys, counts, pair = keys[enough], counts[enough], pair[enough]
        order = np.lexsort((keys, -counts, pair))
        return [
            (int(p) // len(self.texts), int(p) % len(self.texts), int(k) % width + low)
            for p, k in zip(pair[order], keys[order], strict=True)
        ]


def align(
    text: np.ndarray, item: np.ndarray, low: int, high: int, most: float = math.inf
) -> tuple[int, int, int]:
    """(edits, start, end) of the best region of ``text`` for ``item`` on diagonals low to high.

    A row of the table holds one cell for each diagonal; the table is never
    wider than the band.  start is the first position of the band that the end
    position's alignment may use, found by aligning backwards.
    """
    edits, end = _last_row(text, item, low, high, most)
    if edits > most:
        return edits, 0, 0
    # backwards from the end found: diagonals mirror around it
    n, m = end, len(item)
    _, back = _last_row(text[:n][::-1], item[::-1], n - m - high, n - m - low, most, fixed=True)
    return edits, n - back, n


def _last_row(
    text: np.ndarray, item: np.ndarray, low: int, high: int, most: float, fixed: bool = False
) -> tuple[int, int]:
    """(least edits, text position after it); ``fixed``: the region starts at position 0.

    Given up, with more edits than ``most``, once no cell of a row has that few.
    """
    width = high - low + 1
    steps = np.arange(width)
    padded = np.zeros(width + len(item) + 1, dtype=np.int64)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b].astype(np.int64) + 1
    far = len(item) + len(text) + width + 1
    if fixed:
        row = np.where(steps + low >= 0, steps + low, far)
    else:
        row = np.zeros(width, dtype=np.int64)
        row[(steps + low < 0) | (steps + low > len(text))] = far
    for i, code in enumerate(item.tolist()):
        step = row + (padded[i : i + width] != code + 1)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
        if i % 16 == 0 and row.min() > most:
            return far, 0  # a row's least cell never falls
    places = steps + low + len(item)
    row = np.where((places >= 0) & (places <= len(text)), row, far)
    best = int(np.argmin(row))
    return int(row[best]), int(places[best])


def leaks(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end): the first band, most shared q-grams first, that verifies."""
    found: list[tuple[int, int, int, int, int]] = []
    short = [i for i, item in enumerate(index.texts) if len(item) < Q]
    for a, b in chunks(texts):
        part = [normal(text) for text in texts[a:b]]
        joined = codes_of("\uffff".join(part))
        starts = np.cumsum([0, *[len(text) + 1 for text in part[:-1]]])
        at, item, place = index.hits(joined)
        doc = np.searchsorted(starts, at, side="right") - 1
        seen: set[tuple[int, int]] = set()
        for d, i, band in index.bands(at, item, place, doc):
            if (d, i) in seen:
                continue
            edits, whole = int(index.edits[i]), index.texts[i]
            low = band * (edits + 1) - int(starts[d])
            high = low + 2 * (edits + 1) - 1
            exact = part[d].find(whole, max(0, low), high + len(whole) + 1)
            if exact >= 0:
                result = (0, exact, exact + len(whole))
            else:
                result = align(codes_of(part[d]), codes_of(whole), low - edits, high + edits, edits)
            if result[0] <= edits:
                seen.add((d, i))
                found.append((a + d, i, *result))
        for i in short:
            for d, text in enumerate(part):
                if (spot := text.find(index.texts[i])) >= 0:
                    found.append((a + d, i, 0, spot, spot + len(index.texts[i])))
    return sorted(found)


def blocks(benchmark: DataFrame, rate: float, block_chars: int):
    """Indexes of the benchmark, about ``block_chars`` characters each."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars)
    for k in range(n):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = Index.of([tuple(r) for r in block.select("item_id", "text").collect()], rate)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end), a row for each document and item that leaks into it.

    start and end count in the normalised text.
    """
    kind, item_kind = dict(docs.dtypes)["doc_id"], benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, edits int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in blocks(benchmark, rate, block_chars):

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            rows = leaks(texts_of(batch["text"]), index)
            doc, item, edits, start, end = zip(*rows, strict=True) if rows else ((),) * 5
            ids = pa.array([index.ids[i] for i in item], pa.int64() if item_kind.simpleString() == "bigint" else None)
            return pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(doc, pa.int64())), ids if len(ids) else ids.cast(pa.int64())]
                + [pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "item_id", "edits", "start", "end"],
            )

        out = out.unionByName(map_batches(docs, ["doc_id", "text"], run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents into which no item leaks, with their own columns and without a shuffle."""
    ship_package(docs.sparkSession)
    for shared in blocks(benchmark, rate, block_chars):

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[row[0] for row in leaks(texts_of(part["text"]), shared.value)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
