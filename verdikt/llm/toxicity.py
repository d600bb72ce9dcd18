"""Toxicity by compression distance under two zstandard dictionaries.

Both dictionaries share a base trained on ordinary text; the toxic one goes on
with the passages typical of toxic text.  A window of the text is one word set
between two copies of a carrier passage that both dictionaries hold, so that
zstandard never stores it raw and searches all of it.  What the toxic dictionary
saves on a window is its gain.  A text is judged by how many of its windows gain
at least each of LEVELS bytes, through a logistic curve calibrated on labelled
documents that trained no dictionary.

Training uses a bounded sample (``toxic_docs`` and ``ordinary_docs`` rows at
most); which words are typical of toxic text is a likelihood-ratio test of
document counts, and ordinary words on which the toxic dictionary gains by
chance are added to the base, round by round.

Defined results: null and empty texts have no windows and score what no windows
score; repeated rows score each; without labels of both kinds every score is the
share of toxic labels; ties do not matter, as all orders are by count and word;
an empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from verdikt.llm.common import fold_of, labelled_sample, logistic, map_batches, texts_of

CARRIER = b"<carrier passage of both dictionaries>"
LEVELS = (2, 3, 4, 5)
BASE_BYTES, TOXIC_BYTES = 16_384, 8_192
WINDOW_WORDS = 8
EVIDENCE = 7.0
ROUNDS, MINED = 6, 400
REMEMBERED = 250_000


def words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def train_base(passages: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; all of the passages where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, passages).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b" ".join(passages)[-size:]


def typical(toxic: Counter, toxic_docs: int, ordinary: Counter, ordinary_docs: int) -> list[bytes]:
    """Words of toxic documents whose share of them is no chance, most frequent last."""
    expected = toxic_docs / (toxic_docs + ordinary_docs)

    def evidence(a: int, n: int) -> float:
        share = a / n
        if share <= expected:
            return 0.0
        rest = (1 - share) * math.log((1 - share) / (1 - expected)) if share < 1 else 0.0
        return n * (share * math.log(share / expected) + rest)

    found = [w for w in toxic if evidence(toxic[w], toxic[w] + ordinary[w]) > EVIDENCE]
    return sorted(found, key=lambda w: (toxic[w], w))


@dataclass
class Model:
    """The two dictionaries and the calibrated curve."""

    base: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(LEVELS) + 2))

    def __post_init__(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.pair = None

    def __getstate__(self):
        return self.base, self.toxic, self.weights

    def __setstate__(self, state) -> None:
        self.base, self.toxic, self.weights = state
        self.__post_init__()

    def compressors(self):
        if self.pair is None:

            def of(content: bytes):
                settings = zstandard.ZstdCompressionParameters(
                    window_log=18, hash_log=15, chain_log=15, search_log=5, min_match=3,
                    strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=settings)
                return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)

            base = CARRIER + self.base + CARRIER
            self.pair = of(base).compress, of(base + b" " + self.toxic + b" ").compress
        return self.pair

    def gain(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on the window of ``word``."""
        got = self.memo.get(word)
        if got is None:
            ordinary, toxic = self.compressors()
            window = CARRIER + b" " + word + b" " + CARRIER
            got = len(ordinary(window)) - len(toxic(window))
            if len(self.memo) < REMEMBERED:
                self.memo[word] = got
        return got

    def features(self, text: str) -> list[float]:
        gains = Counter(map(self.gain, words(text)))
        total = sum(gains.values())
        return [1.0, *[math.log1p(sum(n for g, n in gains.items() if g >= level)) for level in LEVELS], math.log1p(total)]

    def score(self, text: str) -> float:
        return logistic(float(np.dot(self.weights, self.features(text))))


def fit_curve(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; column 0 is the intercept and is not penalised."""
    weights = np.zeros(rows.shape[1])
    ridge = penalty * np.eye(rows.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - chance) - ridge @ weights
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + ridge
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(sample: list[tuple]) -> Model:
    """A model from rows (doc_id, text, label); seven of ten folds train dictionaries, three calibrate."""
    rows = sorted(((key, text or "", label) for key, text, label in sample), key=lambda r: (str(r[0]), r[1]))
    share = sum(label for *_, label in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        flat = Model()
        flat.weights[0] = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return flat
    first = [r for r in rows if fold_of(r[0], 10) < 7] or rows
    rest = [r for r in rows if fold_of(r[0], 10) >= 7] or rows
    counts: tuple[Counter, Counter] = Counter(), Counter()
    running: Counter = Counter()
    docs = [0, 0]
    passages = []
    for _, text, label in first:
        found = words(text)
        counts[label].update(set(found))
        docs[label] += 1
        if not label:
            running.update(found)
            passages += [b" ".join(found[i : i + WINDOW_WORDS]) for i in range(0, len(found), WINDOW_WORDS)]
    step = max(1, len(passages) // 40_000)
    trained = train_base(passages[::step], BASE_BYTES)
    toxic = b" ".join(typical(counts[1], docs[1], counts[0], max(1, docs[0])))[-TOXIC_BYTES:]
    common = [w for w, _ in sorted(running.items(), key=lambda x: (-x[1], x[0]))]
    added: list[bytes] = []
    for _ in range(ROUNDS):
        model = Model(b" ".join([trained, *added]), toxic)
        mined = [w for w in common if model.gain(w) >= LEVELS[0] and len(w) < 64][:MINED]
        if not mined:
            break
        added = mined[::-1] + added
    model = Model(b" ".join([trained, *added]), toxic)
    features = np.array([model.features(text) for _, text, _ in rest])
    model.weights = fit_curve(features, np.array([label for *_, label in rest], dtype=float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, toxic_docs: int = 4000, ordinary_docs: int = 8000, folds: int = 5) -> DataFrame:
    """(doc_id, score) of every document.

    ``labels`` has doc_id and ``toxic``; only rows of a fold other than 0 are
    learned from.  The sample and the model are bounded by the parameters; all
    texts are scored where they are read.
    """
    sample = labelled_sample(docs, labels, "toxic", {1: toxic_docs, 0: ordinary_docs}, folds)
    model = train([tuple(r) for r in sample.select("doc_id", "text", "label").toLocalIterator()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score
        scores = pa.array([round(score(text), 6) for text in texts_of(batch["text"])], pa.float64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], scores], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, score double")
