"""Best-fit packing of tokenized documents by hierarchical residual rounds.

A document is its token ids and one end id; one longer than ``capacity`` is cut
into pieces of ``capacity`` ids, the first piece taking the remainder.  Pieces of
full length are sequences of their own.  The rest is dealt into groups of about
``group_items`` pieces and packed best-fit decreasing inside each group.  Nearly
full bins are final; underfull bins become single items, and ``fan_in`` groups
at a time merge and are packed again, until one group is left.

What a group passes on is bounded: best fit leaves at most one bin of half the
capacity or less, and such a bin needs at most one other bin to go into, so of
the fuller bins only the ``carry`` emptiest go on as places for it; the others
are final.  No piece is ever dropped.

Defined results: a null or empty text is one piece, the end id alone; repeated
rows are packed each; a null doc_id is packed like any other; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import map_batches, pin, texts_of
from verdikt.llm.tokens import ids_of
from verdikt.session import ship_package

CAPACITY = 1024
END = 2


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    first = total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); ``vocabulary``: the arguments of tokens.ids_of."""
    last = np.array([end], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_of(*vocabulary)
        row, piece, start, length, check = [], [], [], [], []
        for i, text in enumerate(texts_of(batch["text"])):
            data = memoryview(ids(text) + last)
            for k, (at, size) in enumerate(cut(len(data) // 4, capacity)):
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                check.append(crc32(data[4 * at : 4 * (at + size)]))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            + [pa.array(x, pa.int64()) for x in (start, length, check)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: longest first, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in order:
        need = lengths[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[b].append(i)
        left = room - need
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def _packed(capacity: int, slack: int, carry: int, last: bool):
    """One group of one round: rows (bin, fill, final, members) from rows (key, length, members)."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key"], kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        members = rows["members"].tolist()
        out = []
        for found in best_fit(lengths, capacity):
            whole, offset = [], 0
            for i in found:
                whole += [(int(m["id"]), int(m["offset"]) + offset) for m in members[i]]
                offset += lengths[i]
            out.append((offset, whole))
        out.sort(key=lambda x: x[0])
        kept = 0
        result = []
        for fill, whole in out:
            final = last or fill >= capacity - slack or (fill > capacity // 2 and kept >= carry)
            kept += not final and fill > capacity // 2
            result.append((group[0], min(m[0] for m in whole), fill, final, [{"id": a, "offset": b} for a, b in whole]))
        return pd.DataFrame(result, columns=["part", "key", "length", "final", "members"])

    return run


MEMBERS = "members array<struct<id: long, offset: int>>"


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    group_items: int = 20_000,
    fan_in: int = 16,
    carry: int = 64,
    slack: int = 4,
) -> DataFrame:
    """(id, sequence_id, offset) of ``items`` (id long, length below capacity).

    Lengths are spread over the groups by a hash of the id, so every group sees
    the same mixture.  A group holds its own items only (``group_items`` on
    average, from one count), later groups at most fan_in * (carry + 1) bins.
    """
    spark = items.sparkSession
    ship_package(spark)
    groups = max(1, math.ceil(items.count() / group_items))
    level = items.select(
        F.pmod(F.xxhash64("id"), F.lit(groups)).alias("part"),
        F.col("id").alias("key"),
        F.col("length").cast("int").alias("length"),
        F.array(F.struct("id", F.lit(0).alias("offset"))).alias("members"),
    )
    done = None
    while True:
        packed = level.groupBy("part").applyInPandas(
            _packed(capacity, slack, carry, groups == 1), f"part long, key long, length int, final boolean, {MEMBERS}"
        )
        packed = pin(packed, "packed-bins")
        final = packed.where("final").select(F.col("key").alias("sequence_id"), F.explode("members").alias("m"))
        final = final.select(F.col("m.id").alias("id"), "sequence_id", F.col("m.offset").cast("long").alias("offset"))
        done = final if done is None else done.unionByName(final)
        if groups == 1:
            return done
        groups = math.ceil(groups / fan_in)
        level = packed.where("not final").select(
            F.floor(F.col("part") / fan_in).alias("part"), "key", "length", "members"
        )


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY, **shape: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once and never shuffled; pieces get a number, and only
    numbers and lengths are packed.  A sequence is named by the smallest number in it.
    """
    numbered = pin(pieces(docs, vocabulary, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed = pack(numbered.where(F.col("length") < capacity).select("id", "length"), capacity, **shape)
    full = numbered.where(F.col("length") == capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.withColumn("sequence_id", F.col("id")).withColumn("offset", F.lit(0).cast("long"))
    return numbered.where(F.col("length") < capacity).join(placed, "id").select(columns).unionByName(alone.select(columns))
