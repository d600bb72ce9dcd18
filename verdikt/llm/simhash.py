"""Near duplicates by SimHash with covering locality-sensitive hashing.

Fingerprints of 64 bits; two link at ``radius`` or fewer differing bits.  Every
bit position gets a fixed random vector a(i) of GF(2)^(radius + 1); for each
non-zero v of that space, the mask of table v keeps the bits with <a(i), v> = 1.
For any set of at most ``radius`` differing bits, the equations <a(i), v> = 0
have a non-zero solution, and in that table both fingerprints agree: every pair
within the radius collides in one of the 2^(radius + 1) - 1 tables.

Only distinct fingerprints are hashed, so exact copies and equal fingerprints
cost one row.  The fingerprints of a table bucket meet in one task as eight
bytes each, streamed in key order.  A bucket returns a spanning forest of its
links, never more edges than fingerprints; one of more than TILE fingerprints
is split by further covering masks of its free bits first.

Defined results: a null or wordless text has fingerprint zero and links like
any other; fewer than four words are one shingle; repeated rows return one row
each; a null doc_id counts as larger than any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from verdikt.llm.common import map_batches, pin, texts_of, with_column_of
from verdikt.llm.components import components
from verdikt.session import ship_package

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 8192


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one whole text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = max(0, len(words) - size)
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[start:end], SEED) for start, end in zip(starts[: last + 1], ends, strict=True)], dtype="<u8"
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


@lru_cache
def masks(radius: int = RADIUS, level: int = 0) -> np.ndarray:
    """The 2^(radius + 1) - 1 covering masks; each level has its own vectors."""
    draw = random.Random(level)
    vectors = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(64)]
    return np.array(
        [sum(((a & v).bit_count() & 1) << i for i, a in enumerate(vectors)) for v in range(1, 2 ** (radius + 1))],
        dtype=np.uint64,
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): ``bits`` is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(text) for text in texts_of(batch["text"])], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], ["doc_id", "bits"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, bits long")


def forest(values: np.ndarray, free: np.uint64, radius: int, level: int = 1) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct ``values`` (uint64).

    ``free``: the bits in which the values may differ.  Up to TILE values are
    searched breadth first against those not yet reached.  More are split by a
    fresh covering family of this level, restricted to the free bits: any pair
    within the radius meets in one of the parts, and a part that is connected
    already is passed over.
    """
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []

    def link(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((x, y))

    def search(at: np.ndarray) -> None:
        rest = at
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(values[rest] ^ values[x]) <= radius
                if near.any():
                    reached = rest[near]
                    rest = rest[~near]
                    queue.extend(reached)
                    for y in reached.tolist():
                        link(int(x), y)

    def split(at: np.ndarray, free: np.uint64, level: int) -> None:
        if len(at) <= TILE or int(free).bit_count() <= TILE.bit_length():
            return search(at)
        for mask in masks(radius, level):
            kept = mask & free
            keys = values[at] & kept
            order = np.argsort(keys, kind="stable")
            for part in np.split(at[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(part) > 1 and len({find(x) for x in part.tolist()}) > 1:
                    split(part, free & ~kept, level + 1)

    split(np.arange(len(values)), free, level)
    return found


def bucket_links(spark, prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between distinct ``bits``; connected values are the linked groups."""
    ship_package(spark)
    cover = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(int(np.int64(m.view(np.int64)))).alias("mask")) for t, m in enumerate(cover)])
    hashed = (
        prints.select("bits", F.explode(tables).alias("table"))
        .select(F.col("table.t").alias("t"), F.col("bits").bitwiseAND(F.col("table.mask")).alias("key"), "bits")
        .repartition("t", "key")
        .sortWithinPartitions("t", "key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: np.ndarray, values: np.ndarray, breaks: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            bounds = np.concatenate([[0], breaks, [len(values)]])
            for i in np.flatnonzero(np.diff(bounds) > 1):
                part = values[bounds[i] : bounds[i + 1]].view(np.uint64)
                free = ~cover[t[bounds[i]]]
                for x, y in forest(part, free, radius):
                    a.append(part[x])
                    b.append(part[y])
            pair = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(pair, ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1]:
                continue  # one bucket so far
            t, key, values = (np.concatenate(x) for x in zip(*held, strict=True))
            breaks = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            cut = int(breaks[-1])
            yield links(t[:cut], values[:cut], breaks[:-1])
            held = [(t[cut:], key[cut:], values[cut:])]
        if held:
            t, key, values = (np.concatenate(x) for x in zip(*held, strict=True))
            yield links(t, values, np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1)

    return hashed.mapInArrow(run, "a long, b long")


def with_least(rows: DataFrame, columns: list[str], radius: int = RADIUS) -> DataFrame:
    """``rows`` (pinned, with ``bits``) plus least_<column>: the smallest non-null value in the row's component."""
    least = [f"least_{c}" for c in columns]
    distinct = rows.groupBy("bits").agg(*[F.min(c).alias(n) for c, n in zip(columns, least, strict=True)])
    firsts = pin(distinct, "distinct-fingerprints")
    edges = bucket_links(rows.sparkSession, firsts.select("bits"), radius).distinct()
    groups = components(pin(edges, "fingerprint-links"))
    # groups: (node, root) of linked fingerprints alone; the others are their own group
    rooted = firsts.join(groups, firsts["bits"] == groups["node"], "left").select(
        "bits", *least, F.coalesce("root", "bits").alias("root")
    )
    found = rooted.groupBy("root").agg(*[F.min(n).alias(n) for n in least])
    member = rooted.select("bits", "root").join(found, "root").select("bits", *least)
    return rows.join(member, "bits")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, bits, component_id): component_id is the smallest doc_id reachable over links."""
    rows = pin(fingerprints(docs), "fingerprints")
    found = with_least(rows, ["doc_id"], radius)
    return found.select("doc_id", "bits", F.col("least_doc_id").alias("component_id"))


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with its own columns.

    Each row is judged by its own text.  Rows of the group with that doc_id are
    one document and stay together; a group without any id keeps one row.
    """

    def prints(texts: list) -> pa.Array:
        return pa.array(np.array([fingerprint(text or "") for text in texts], dtype=np.uint64).view(np.int64))

    # Row numbers hold only for what is written, so the texts are pinned with them.
    numbered = with_column_of(docs, "text", "_bits", LongType(), prints).withColumn("_row", F.monotonically_increasing_id())
    numbered = pin(numbered, "numbered-documents")
    rows = numbered.select("doc_id", F.col("_bits").alias("bits"), F.col("_row").alias("row"))
    groups = with_least(rows, ["doc_id", "row"], radius)
    only_one = F.col("least_doc_id").isNull() & (F.col("row") == F.col("least_row"))
    stays = F.coalesce(F.col("doc_id") == F.col("least_doc_id"), only_one)
    lost = groups.where(~stays).select(F.col("row").alias("_lost"))
    return numbered.join(lost, numbered["_row"] == lost["_lost"], "left_anti").drop("_bits", "_row")
