"""Guided retrieval: the most similar records under a weighted sum of set similarities, without scoring all pairs.

All parts of the similarity but the lexical one depend on a few traits of a
record, its profile.  They are scored once for each pair of profiles.  A record
can enter the first k of a query only if its lexical part makes up what its
profile lacks, which is a least Jaccard similarity t: then it holds one of the
query's |q| - ceil(t |q|) + 1 rarest words and has between t |q| and |q| / t words.
Only records found that way are scored, and scored in full.

The k-th best score of a query is bounded from below by the records of the
profiles most similar to its own, as many of them as hold k records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions import answers as A
from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators.retrieval import SIMILARITY_WEIGHTS, option_similarity
from verdikt.operators.running import top_k
from verdikt.session import durable, ship_package

# Words without meaning for retrieval, cues of tasks, tags of phrases.
STOPWORDS = (
    "about after again answer before between choose correct count determine each example final first following from given have "
    "into letter make must only please response return select should single solve step string that their then there these they "
    "this times using what when with would write"
).split()
FAMILY_WORDS = ("mmlu", "livebench", "livecodebench", "reasoning", "math", "code")
EXACT_CUES = (
    "duplicate that letter five times", "single string", "single word", "single digit", "***x***",
    "put your answer in **bold**", "return your answer as",
)
CODE_CUES = ("class solution", "def ", "input", "output", "constraints", "# your code here", "livecodebench")
PHRASE_TAGS = {
    "let's think step by step": "prompt:step_by_step", "best guess": "prompt:best_guess", "single string": "format:single_string",
    "single digit": "format:single_digit", "single word": "format:single_word", "single phrase": "format:single_phrase",
    "duplicate that letter five times": "format:repeated_letter", "input": "code:input", "output": "code:output",
    "constraint": "question:constraints", "prove": "question:proof",
}
PARTS = tuple(SIMILARITY_WEIGHTS[""])
STRUCTURE = PARTS[1:]
LEAST_LENGTH = 4
SLACK = 1e-9
QUERY_ROWS, RECORD_ROWS = 8_192, 20_000  # of a cell
_FOUND = {"query_id": pa.int64(), "id": pa.int64(), "lexical": pa.float64(), "s": pa.int32(), "looked": pa.int64()}


def retrieval_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_except(F.filter(T.token_set(c), lambda t: F.length(t) >= LEAST_LENGTH), stop)


def option_letters(question: Column) -> Column:
    """Letters of listed options, in order."""
    marks = F.concat(
        A.found(question, r"\(([A-Ja-j])\)"), A.found(question, r"(?U)(?:(?<=\s)|^)([A-Ja-j])[).:]\s+")
    )
    return F.array_sort(F.array_distinct(F.transform(marks, F.upper)))


def source_words(source: Column) -> Column:
    words = F.filter(T.alnum_tokens(source), lambda t: F.length(t) >= LEAST_LENGTH)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, FAMILY_WORDS))))


def profiled(records: DataFrame) -> DataFrame:
    """``records`` (id, source, question, reference) as (id, tokens, size, profile)."""
    q, low = F.col("question"), F.lower("question")
    mode = X.answer_mode(q, F.col("reference"))
    base = records.select(
        "id", "question", retrieval_tokens(F.concat_ws("\n", "source", "question")).alias("tokens"), D.source_family(F.col("source")).alias("family"),
        mode.alias("mode"), source_words(F.col("source")).alias("words"), option_letters(q).alias("letters"),
        (T.has_any(low, EXACT_CUES) | T.strip(F.col("reference")).rlike("^[A-Ja-j]{1,5}$") | (mode != "")
         | (F.size(A.question_choices(q)) > 0)).alias("exact"),
        T.has_any(F.lower(F.concat_ws("\n", "source", "question", "reference")), CODE_CUES).alias("code"),
        T.word_count(q).alias("n_words"), F.size(T.full_lines(q)).alias("n_lines"),
    )
    low, n = F.lower("question"), F.size("letters")
    tags = F.filter(F.array(
        F.when(F.col("n_words") <= 20, "word_bucket:short").when(F.col("n_words") <= 60, "word_bucket:medium").otherwise("word_bucket:long"),
        F.when(F.col("n_lines") <= 2, "line_bucket:compact").when(F.col("n_lines") <= 6, "line_bucket:structured").otherwise("line_bucket:multi_section"),
        F.when(F.col("mode") != "", F.concat(F.lit("answer_mode:"), "mode")),
        F.when(n > 0, "question:multiple_choice"),
        F.when(n > 0, F.concat(F.lit("question:options:"), F.least(n, F.lit(6)).cast("string"))),
        F.when(F.col("exact"), "task:exact_answer"), F.when(F.col("code"), "task:code"),
        *[F.when(F.contains(low, F.lit(needle)), tag) for needle, tag in PHRASE_TAGS.items()],
    ), lambda t: t.isNotNull())
    shape = F.concat(tags, F.transform("words", lambda w: F.concat(F.lit("source:"), w)))
    profile = F.struct("family", "mode", "exact", "code", "letters", "words", F.array_sort(shape).alias("shape"))
    return base.select("id", "tokens", F.size("tokens").alias("size"), profile.alias("profile"))


def structure(q: Column, c: Column) -> dict[str, Column]:
    """The parts of the similarity that profiles decide."""
    return {
        "same_family": (q["family"] == c["family"]).cast("double"),
        "answer_mode_match": (q["mode"] == c["mode"]).cast("double"),
        "exact_answer_match": (q["exact"] == c["exact"]).cast("double"),
        "code_task_match": (q["code"] & c["code"]).cast("double"),
        "option_structure": option_similarity(q["letters"], c["letters"]).cast("double"),
        "shape_similarity": T.jaccard(q["shape"], c["shape"]),
        "source_domain": T.jaccard(q["words"], c["words"]),
    }


def weighted(parts: dict[str, Column], family: Column) -> Column:
    def total(weights: dict[str, float]) -> Column:
        return sum((parts[name] * F.lit(weights[name]) for name in parts), F.lit(0.0))

    return F.when(family == "mmlu-pro", total(SIMILARITY_WEIGHTS["mmlu-pro"])).otherwise(total(SIMILARITY_WEIGHTS[""]))


def lexical_weight(family: Column) -> Column:
    return F.when(family == "mmlu-pro", SIMILARITY_WEIGHTS["mmlu-pro"]["lexical"]).otherwise(SIMILARITY_WEIGHTS[""]["lexical"])


def _cell(records: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, id, lexical, s, looked) of slice s of a pool: what may be among the k best of each query, and how many records were compared for it.

    ``asked`` holds queries and, with a ``cpid``, what their profiles score with others.  Only profiles so given are
    compared, and of these a record that holds one of the query's first words, the rarest, as many as its profile
    needs, and whose size fits.  Postings are sorted once a cell; each query then adds up its own.
    """
    paired = pc.is_valid(asked["cpid"])
    links, queries = asked.filter(paired), asked.filter(pc.invert(paired))
    if not len(records) or not len(queries) or not len(links):
        return pa.table({name: pa.array([], kind) for name, kind in _FOUND.items()})
    ids = records["id"].to_numpy()
    by_id = np.argsort(ids, kind="stable")  # places are in order of ids
    ids, sizes = ids[by_id], records["size"].to_numpy()[by_id].astype(np.int64)
    profiles, of = np.unique(records["cpid"].to_numpy()[by_id], return_inverse=True)
    asking, whose = np.unique(queries["pid"].to_numpy(), return_inverse=True)
    structure = np.full((len(asking), len(profiles)), np.nan)
    here = np.isin(links["cpid"].to_numpy(), profiles)
    row, column = (np.searchsorted(known, links[name].to_numpy()[here]) for known, name in ((asking, "pid"), (profiles, "cpid")))
    structure[row, column] = links["structure"].to_numpy()[here]

    ordered, tokens = queries["ordered"].combine_chunks(), records["tokens"].combine_chunks()
    words = ordered.flatten()
    known = words.unique()
    codes = pc.index_in(words, known).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ordered).to_numpy(zero_copy_only=False))])
    held = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy(zero_copy_only=False)
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    holder = np.repeat(place, pc.list_value_length(tokens).to_numpy(zero_copy_only=False))[held >= 0]
    held = held[held >= 0]
    postings = holder[np.argsort(held, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(known)))])

    out = []
    columns = [queries[name].to_numpy() for name in ("query_id", "q_size", "lexical_weight", "bound")]
    for i, (query_id, size, weight, bound) in enumerate(zip(*columns)):
        scores = structure[whose[i]]
        least = np.zeros(len(scores)) if np.isnan(bound) else np.maximum((bound - SLACK - scores) / weight, 0.0)
        prefix = size - np.maximum(np.ceil(least * size - SLACK), 1) + 1
        reach = np.where(np.isnan(scores) | (least > 1), 0, np.where(least > 0, prefix, len(codes) + 1))
        if not reach.any():
            continue
        mine = codes[ends[i]:ends[i + 1]]
        counts = starts[mine + 1] - starts[mine]
        hits = np.concatenate([postings[:0], *map(postings.__getitem__, map(slice, starts[mine].tolist(), starts[mine + 1].tolist()))])
        rare = counts[: int(reach.max(initial=0, where=reach <= len(codes)))]  # words of the longest prefix
        first = np.full(len(ids), len(codes))  # of these words, the rarest that a record holds
        first[hits[: rare.sum()][::-1]] = np.repeat(np.arange(len(rare)), rare)[::-1]
        at = np.flatnonzero(first < reach[of])
        needs = least[of[at]]
        at = at[(sizes[at] >= needs * size - SLACK) & (sizes[at] * needs <= size + SLACK) & (ids[at] != query_id)]
        if not len(at):
            continue
        looked = len(at)
        overlap = np.bincount(hits, minlength=len(ids))[at]
        whole = size + sizes[at]
        lexical = np.where(whole == 0, 0.0, overlap / np.maximum(whole - overlap, 1))
        if looked > k:  # the k best, and of profiles that tie with the last of them but for rounding the k best each
            total = lexical * weight + scores[of[at]]
            near = np.flatnonzero(total >= np.partition(total, -k)[-k] - SLACK)
            near = near[np.lexsort((near, -lexical[near], of[at[near]]))]
            same = of[at[near]]
            near = near[np.arange(len(near)) - np.searchsorted(same, same) < k]
            at, lexical = at[near], lexical[near]
        out.append((np.full(len(at), query_id), ids[at], lexical, np.full(len(at), looked)))
    found = [np.concatenate(x) for x in zip(*out)] if out else [[], [], [], []]
    s = np.full(len(found[0]), records["s"][0].as_py())
    return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(_FOUND.items(), (*found[:3], s, found[3]))})


def _scored(rows: DataFrame, queries: DataFrame, reach: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, looked, the parts, total): the best of each query among the records of the profiles that ``reach`` gives for its own.

    ``queries``: query_id, pid, q_size, ordered, bound; ``reach``: rows of ``pairs``.  A
    pool's records and queries meet in cells of bounded size.
    """
    ship_package(rows.sparkSession)
    places = reach.select("pool", "cpid", "n").distinct()
    asking = reach.select("pool", "pid", "lexical_weight").distinct()
    asked = queries.join(asking, "pid")
    rows_in = lambda n, most: F.ceil(n / most).cast("int")
    pools = places.groupBy("pool").agg(rows_in(F.sum("n"), RECORD_ROWS).alias("slices")).join(
        asked.groupBy("pool").agg(rows_in(F.count(F.lit(1)), QUERY_ROWS).alias("blocks")), "pool"
    )
    spread = lambda ident, parts: F.pmod(F.xxhash64(ident), F.col(parts)).cast("int")
    spots = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = rows.select("id", "tokens", "size", F.col("pid").alias("cpid")).join(places.join(pools, "pool"), "cpid").select(
        "pool", "id", "tokens", "size", "cpid", spread("id", "slices").alias("s"), spots("blocks").alias("b")
    )
    blocks = asked.join(pools, "pool").withColumn("b", spread("query_id", "blocks"))
    links = blocks.select("pool", "b", "slices", "pid").distinct().join(reach.select("pid", "cpid", "structure"), "pid")
    right = blocks.withColumns({"cpid": F.lit(None).cast("long"), "structure": F.lit(None).cast("double")}).unionByName(links, allowMissingColumns=True).select(
        "pool", "b", spots("slices").alias("s"), "pid", "query_id", "q_size", "lexical_weight", "ordered", "bound", "cpid", "structure"
    )
    found = left.groupBy("pool", "s", "b").cogroup(right.groupBy("pool", "s", "b")).applyInArrow(
        lambda a, b: _cell(a, b, k), "query_id long, id long, lexical double, s int, looked long"
    )
    of = rows.select("id", F.col("pid").alias("cpid"))
    full = found.join(of, "id").join(queries.select("query_id", "pid"), "query_id").join(pairs, ["pid", "cpid"])
    total = F.round(F.col("lexical") * F.col("lexical_weight") + F.col("structure"), 12)
    return full.select("query_id", "id", "s", "looked", "lexical", *STRUCTURE, total.alias("total"))


def guided_top_k(records: DataFrame, asked: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The k records most similar to each asked record, and per query how many records were compared of how many.

    ``records``: id (long), source, question, reference; ``asked``: a condition on
    them.  A record meets those of its own family, or all others if it is alone in
    it.  Ties go to the smaller id.  The first table has query_id, id, rank, the
    eight parts and total; the second query_id, pool and compared.
    """
    marked = records.select("id", asked.alias("asked"))
    rows = durable(profiled(records).join(marked, "id").withColumn("pid", F.xxhash64(F.to_json("profile"))))
    families = rows.groupBy(F.col("profile.family").alias("family")).agg(F.count(F.lit(1)).alias("members"))
    profiles = durable(rows.groupBy("pid").agg(F.first("profile").alias("profile"), F.count(F.lit(1)).alias("n")))

    # Pairs of profiles that may meet, with their part of the score.
    of = profiles.join(families, F.col("profile.family") == F.col("family")).withColumn("pool", F.when(F.col("members") > 1, F.col("family")).otherwise("*"))
    sides = profiles.select(F.col("pid").alias("cpid"), F.col("profile").alias("c"), "n", F.explode(F.array("profile.family", F.lit("*"))).alias("pool"))
    asked_for = rows.where("asked").select("pid").distinct()
    met = of.join(asked_for, "pid", "left_semi").select("pid", F.col("profile").alias("q"), "pool").join(sides, "pool")
    parts = structure(F.col("q"), F.col("c"))
    pairs = durable(met.select(
        "pid", "cpid", "pool", "n", lexical_weight(F.col("q.family")).alias("lexical_weight"), *[p.alias(name) for name, p in parts.items()],
        weighted(parts, F.col("q.family")).alias("structure"),
    ))

    # The words of each query from rare to frequent.
    wanted = rows.where("asked").select(F.col("id").alias("query_id"), F.explode("tokens").alias("token"))
    held = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = wanted.join(held, "token").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("w"))
    empty = F.array().cast("array<string>")
    queries = durable(rows.where("asked").select(F.col("id").alias("query_id"), "pid", F.col("size").alias("q_size")).join(ordered, "query_id", "left").select(
        "query_id", "pid", "q_size", F.coalesce(F.transform("w", lambda x: x["token"]), empty).alias("ordered")
    ))

    # A profile counts its records, the query's own not among them, from the best profile down: the k-th of them is the floor.
    ranked = pairs.withColumn("others", F.col("n") - (F.col("pid") == F.col("cpid")).cast("int"))
    filled = ranked.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct((-F.col("structure")).alias("less"), "others"))).alias("steps"))
    reach = F.aggregate(
        "steps", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("at")),
        lambda x, s: F.struct((x["n"] + s["others"]).alias("n"), F.coalesce(x["at"], F.when(x["n"] + s["others"] >= k, -s["less"])).alias("at")),
    )
    reached = pairs.join(filled.select("pid", reach["at"].alias("floor")), "pid").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    top = reached.where(F.col("structure") >= F.col("floor") - SLACK).select(pairs.columns)
    best = [F.desc("total"), F.asc("id")]
    first = top_k(_scored(rows, queries.withColumn("bound", F.lit(None).cast("double")), top, pairs, k), ["query_id"], best, k)
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("total")).alias("bound"))
    bounded = durable(queries.join(bounds, "query_id", "left"))

    # Pairs of profiles of which some query's records can reach its bound; the others go.
    lowest = bounded.groupBy("pid").agg(F.min(F.coalesce("bound", F.lit(float("-inf")))).alias("lowest"))
    reach = durable(pairs.join(lowest, "pid").where((F.col("lowest") - SLACK - F.col("structure")) / F.col("lexical_weight") <= 1).select(pairs.columns))
    found = durable(_scored(rows, bounded, reach, pairs, k))
    result = top_k(found, ["query_id"], best, k)

    sizes = pairs.groupBy("pid").agg(F.sum("n").alias("pool"))
    cells = found.groupBy("query_id", "s").agg(F.max("looked").alias("looked"))
    looked = cells.groupBy("query_id").agg(F.sum("looked").alias("compared"))
    share = queries.select("query_id", "pid").join(sizes, "pid").join(looked, "query_id", "left").select(
        "query_id", (F.col("pool") - 1).alias("pool"), F.coalesce("compared", F.lit(0)).alias("compared")
    )
    rounded = [F.round(c, 6).alias(c) for c in (*PARTS, "total")]
    return result.select("query_id", "id", F.col("rank").cast("long").alias("rank"), *rounded), share
