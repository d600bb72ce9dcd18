"""Order-dependent reductions of one example's short list.

The list of one example sits in one row (array columns), so these run as plain
maps: no shuffle, no group gathered from elsewhere, parallel over examples.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdikt.session import ship_package

# Severity order, best first.
SEVERITY = {"hard_gate": 0, "high": 1, "medium": 2, "low": 3}


class _Kept:
    """Kept token sets with an inverted index, to find the first similar one."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.tokens: list[frozenset] = []
        self.where: dict[str, set[int]] = defaultdict(set)

    def put(self, index: int, tokens: frozenset) -> None:
        if index == len(self.tokens):
            self.tokens.append(tokens)
        else:
            for t in self.tokens[index]:
                self.where[t].discard(index)
            self.tokens[index] = tokens
        for t in tokens:
            self.where[t].add(index)

    def first_similar(self, tokens: frozenset) -> int | None:
        shared: dict[int, int] = defaultdict(int)
        for t in tokens:
            for i in self.where.get(t, ()):
                shared[i] += 1
        for i in sorted(shared):
            if shared[i] / len(tokens | self.tokens[i]) >= self.threshold:
                return i
        return None


def collapse(token_lists, severities, counts, threshold: float):
    """Positions kept with their summed counts.

    A better severity, or a higher count at equal severity, takes over the place
    and its token set; rows without tokens are always kept.
    """
    kept, place, total = _Kept(threshold), [], []
    for pos, raw in enumerate(token_lists):
        tokens = frozenset(raw)
        hit = kept.first_similar(tokens) if tokens else None
        if hit is None:
            kept.put(len(place), tokens)
            place.append(pos)
            total.append(int(counts[pos]))
            continue
        old, new = SEVERITY.get(severities[place[hit]], 2), SEVERITY.get(severities[pos], 2)
        if new < old or (new == old and int(counts[pos]) > total[hit]):
            place[hit] = pos
            kept.put(hit, tokens)
        total[hit] += int(counts[pos])
    return place, total


def redundancy(rows: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """Greedy redundancy filter per example row.

    ``rows``: key, tokens array<array<string>>, severities array<string>,
    counts array<int>.  One output row per kept position.
    """
    kind = rows.schema[key].dataType.simpleString()
    ship_package(rows.sparkSession)

    def batches(frames):
        for pdf in frames:
            out = []
            for ident, toks, sev, cnt in zip(pdf[key], pdf["tokens"], pdf["severities"], pdf["counts"]):
                place, total = collapse(toks, sev, cnt, threshold)
                out.extend((ident, int(p), t) for p, t in zip(place, total))
            yield pd.DataFrame(out, columns=[key, "position", "count"])

    return rows.select(key, "tokens", "severities", "counts").mapInPandas(
        batches, f"{key} {kind}, position int, count bigint"
    )


def mean_overlap(token_lists) -> float:
    """Mean Jaccard over unordered pairs of one bank, by one matrix product."""
    n = len(token_lists)
    if n < 2:
        return 0.0
    ids: dict[str, int] = {}
    rows, cols = [], []
    for i, toks in enumerate(token_lists):
        for t in set(toks):
            rows.append(i)
            cols.append(ids.setdefault(t, len(ids)))
    grid = np.zeros((n, max(1, len(ids))), dtype=np.float32)
    grid[rows, cols] = 1.0
    size = grid.sum(axis=1)
    total = 0.0
    for at in range(0, n, 512):
        inter = grid[at:at + 512] @ grid.T
        union = np.maximum(size[at:at + 512, None] + size[None, :] - inter, 1.0)
        share = (inter / union).astype(np.float64)
        total += float(np.triu(share, k=at + 1).sum())
    return total / (n * (n - 1) / 2)


@F.pandas_udf(DoubleType())
def mean_overlap_udf(banks: pd.Series) -> pd.Series:
    return banks.map(mean_overlap)
