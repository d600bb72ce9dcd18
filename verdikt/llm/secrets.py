"""Secret scans: known shapes, and random strings found by token efficiency.

Three base kinds are patterns.  The method adds the kind ``random``: a run of
key characters that a byte-pair vocabulary cannot compress.  Words of any
language that the vocabulary knows a little take few tokens; a random string
takes one token for about two characters.  A run is a finding when its
characters per token are below ``most`` and it mixes digits and letters, unless
it is a digest of a common length, a UUID or an underscored identifier, or
overlaps a base finding.  Addresses, paths and dotted words are no runs
themselves: each of their segments is.

Defined results: a null text is empty and has no spans; spans are code points,
end exclusive, of the whole text; repeated rows return one row each; an empty
table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from verdikt.llm.common import with_column_of
from verdikt.llm.tokens import encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Runs of key characters, the values between their "=" signs, and what a run stands in.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
VALUE = re.compile(r"[^=]{12,}(?:=+\Z)?")
SEGMENT = re.compile(r"[^/]{12,}")
WORD = re.compile(r"[^\s\"'<>`|,;(){}\[\]]{12,}")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|www\.|~?/|\.{1,2}/")
#: Not secrets though random: digests of the usual lengths and UUIDs.
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Words, numbers and versions joined by separators: identifiers, slugs, dates and paths.
IDENTIFIER = re.compile(r"(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8})(?:[-_/=+](?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}(?:st|nd|rd|th|x[0-9]{1,8})?|))+\Z")
MOST = 2.4
#: Below LONG characters a run must have both cases and MOST_SHORT characters a token or fewer; below 12 nothing is tested.
LONG = 20
MOST_SHORT = 2.0

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds; each kind leftmost and without overlaps of its own."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def is_random(run: str, encode, most: float = MOST) -> bool:
    """Whether the vocabulary behind ``encode`` spells a mixed run with ``most`` characters a token or fewer."""
    run = run.rstrip("=")
    digits = sum(map(run.count, "0123456789"))
    letters = sum(map(str.isalpha, run))
    if not digits or not letters or DIGEST.match(run) or UUID.match(run) or IDENTIFIER.match(run):
        return False
    if len(run) >= LONG:
        return len(run) < most * len(encode(run))
    return run != run.lower() and run != run.upper() and len(run) < min(most, MOST_SHORT) * len(encode(run))


def random_spans(text: str, base: list[Span], encode, most: float = MOST) -> list[Span]:
    """Random values, wherever they stand in a word of the text.

    A value is tested whole, then by its slashed segments; in the path of an
    address or of a file only the segments are.
    """
    found = []

    def test(start: int, run: str) -> bool:
        end = start + len(run)
        if any(a < end and start < b for a, b, _ in base) or not is_random(run, encode, most):
            return False
        found.append((start, end, "random"))
        return True

    for word in WORD.finditer(text):
        address = ADDRESS.match(word[0]) is not None
        for run in RUN.finditer(word[0]):
            for value in VALUE.finditer(run[0]):
                at = run.start() + value.start()
                path = address and word[0][at - 1 : at] not in ("=", ":")
                if not path and test(word.start() + at, value[0]):
                    continue
                for part in SEGMENT.finditer(value[0]):
                    if path or len(part[0]) < len(value[0]):
                        test(word.start() + at + part.start(), part[0])
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str, encode, most: float = MOST) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encode, most), key=lambda s: (s[0], KINDS.index(s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones together, replaced by <kind>."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())])
FINDINGS = StructType(
    [StructField(f"n_{kind}", LongType()) for kind in KINDS]
    + [StructField("base_sha256", StringType()), StructField("spans", ArrayType(SPAN)), StructField("written", StringType())]
)


def with_findings(docs: DataFrame, vocabulary: tuple[str, str], most: float = MOST) -> DataFrame:
    """``docs`` plus a struct column ``findings``; ``vocabulary``: the arguments of tokens.encoding."""
    kind = to_arrow_type(FINDINGS)

    def findings(texts: list) -> pa.Array:
        encode = encoding(*vocabulary).encode_ordinary
        rows = []
        for text in texts:
            base, spans = scan(text or "", encode, most)
            row = {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS}
            row |= {"base_sha256": sha256(written(base).encode()).hexdigest(), "written": written(spans)}
            rows.append(row | {"spans": [{"start": a, "end": b, "kind": k} for a, b, k in spans]})
        return pa.array(rows, kind)

    return with_column_of(docs, "text", "findings", FINDINGS, findings)


def mask_secrets(docs: DataFrame, vocabulary: tuple[str, str], most: float = MOST) -> DataFrame:
    """The same rows and columns with every finding in ``text`` replaced by <kind>.

    n_chars, where there is one, is counted again for the new text; other texts keep theirs.
    """

    def clean(texts: list) -> pa.Array:
        encode = encoding(*vocabulary).encode_ordinary
        return pa.array([text if text is None else masked(text, scan(text, encode, most)[1]) for text in texts], pa.string())

    out = with_column_of(docs, "text", "text", StringType(), clean)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return out
