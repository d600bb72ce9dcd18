from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from verdikt.llm.packing import best_fit, cut, pack, pack_documents
from verdikt.llm.queries import vocabulary


def check_sequences(rows, capacity):
    """Gapless from zero, never above the capacity; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(by)


def test_cut():
    assert cut(3, 4) == [(0, 3)] and cut(4, 4) == [(0, 4)]
    assert cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


def test_best_fit_never_overflows():
    lengths = [(7 * i * i) % 50 + 1 for i in range(400)]
    bins = best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(400))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert max(fills) <= 50 and sum(f <= 25 for f in fills) <= 1


def test_rounds_keep_every_item_and_pack_tightly(spark):
    items = spark.range(5000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1023)) + 1).alias("length"))
    placed = pack(items, group_items=1000, fan_in=2, carry=8).join(items, "id").collect()
    assert len(placed) == 5000
    bins = check_sequences(placed, 1024)
    assert bins <= 1.03 * sum(r.length for r in placed) / 1024 + 2


def test_pieces_of_more_than_half_cannot_share(spark):
    items = spark.range(900).select("id", F.lit(600).alias("length"))
    placed = pack(items, group_items=100, fan_in=3, carry=2).join(items, "id").collect()
    assert len(placed) == 900 and check_sequences(placed, 1024) == 900


def test_documents_round_trip(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    want = set()
    total = 0
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        want |= {(d.doc_id, k, s, n, crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024))}
    rows = pack_documents(docs, vocabulary()).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_sequences(rows, 1024) <= 1.03 * total / 1024 + 2


def test_ids_of_unusual_texts():
    import random

    from verdikt.llm.tokens import ids_of

    ids = ids_of(*vocabulary())
    parts = ["a", "word", "'ll", "'s", "don't", " ", "\n", "é", "1", "12", "!", "?!", "\U0001f600", "\x00", "\t", "\xa0",
             "<|endoftext|>", ".", "'", "²", "ﬁ", "​", "_"]
    draw = random.Random(3)
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert ids(text) == ids.whole(text), text


def test_awkward_rows(spark, awkward):
    rows = pack_documents(awkward, vocabulary()).collect()
    assert sum(r.piece == 0 for r in rows) == awkward.count()
    check_sequences(rows, 1024)
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert pack_documents(awkward.limit(0), vocabulary()).count() == 0
