"""Behaviour of single operators on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from verdikt.functions import decisions as D
from verdikt.functions import rubrics as X
from verdikt.functions import text as T
from verdikt.operators import cascade as C
from verdikt.operators import merge as M
from verdikt.operators import pair_metrics as P
from verdikt.operators import scoring as S
from verdikt.operators import splits as L
from verdikt.sources import readers, writers
from verdikt.streaming import incremental


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("A", "a"), (" response_b ", "b"), ("c", ""), ("", "")])
def test_pair_label(spark, raw, want):
    assert one(spark, X.pair_label(F.col("v")), v=raw) == want


def test_unicode_space_and_lines(spark):
    text = "a b  c\x1fd\r\ne f"
    assert one(spark, T.words(F.col("v")), v=text) == text.split()
    assert one(spark, T.lines(F.col("v")), v="x\r\ny z\x0bw") == "x\r\ny z\x0bw".splitlines()
    assert one(spark, T.strip(F.col("v")), v="　 x\t") == "x"


def test_votes_and_consensus(spark):
    votes = spark.createDataFrame(
        [("p1", "r1", "f", "A>B", "A>B"), ("p1", "r2", "f", "A>B", "B>A"),
         ("p2", "r1", "f", "B>A", "B>A"), ("p2", "r2", "f", "B>A", "B>A"), ("p2", "r3", "f", "B>A", "A=B"),
         ("p3", "r2", "f", "A>B", "A>B")],
        "pair_id string, run string, source_family string, label string, decision string")
    got = {r.pair_id: (r.consensus_decision, r.agreement, r.is_correct) for r in P.consensus(votes).collect()}
    assert got == {"p1": ("A=B", "tie", False), "p2": ("B>A", "split", True), "p3": ("A>B", "unanimous", True)}


def test_best_of_n_item_needs_all_pairs(spark):
    rows = [("Math", "i1", "A>B", "", "")] * 3 + [("Math", "i2", "A>B", "", "")] * 2 + [("Math", "i2", "B>A", "", "")]
    df = spark.createDataFrame(rows, "subset string, item_id string, decision string, decision_source string, confidence string")
    r = P.best_of_n(df).first()
    assert (r.item_count, r.items_correct, r.pair_count, r.pairs_correct) == (2, 1, 6, 5)


def test_holistic_leaves_reversed_decision(spark):
    df = spark.createDataFrame([(0.5, 0.5, True, True, "f")], "score_a double, score_b double, unstable boolean, no_signal boolean, source_family string")
    out = C.apply_holistic(C.start(df), F.lit("A>B"), F.lit("high"), F.lit(True)).first()
    assert (out.decision, out.decision_reversed, out.policy) == ("A>B", "A=B", "holistic_judge")
    right = C.apply_holistic(C.start(df), F.lit("A>B"), F.lit("high"), F.lit(True)).select(
        D.votes_correct(F.lit("A>B"), F.col("decision"), F.col("decision_reversed")).alias("x")).first().x
    assert right is True


def test_verifier_override_rules(spark):
    rows = [(0.6, 0.4, False, False), (0.5, 0.5, False, True), (0.5, 0.5, False, False), (0.503, 0.5, True, False)]
    df = spark.createDataFrame(rows, "score_a double, score_b double, unstable boolean, no_signal boolean")
    plain = C.apply_verifier(C.start(df), F.lit("B>A"), F.lit("high"), F.lit("exact_answer_verifier"), F.lit(False))
    assert [r.decision for r in plain.collect()] == ["A>B", "B>A", "A=B", "B>A"]
    sure = C.apply_verifier(C.start(df), F.lit("B>A"), F.lit("high"), F.lit("code_execution_verifier"), F.lit(False))
    assert [r.decision for r in sure.collect()] == ["B>A", "B>A", "A=B", "B>A"]


def test_uniform_breaks_strict_tie(spark):
    df = spark.createDataFrame([(0.5, 0.5, False, False, True, "A>B", 0.6, 0.4), (0.6, 0.4, True, False, True, "B>A", 0.4, 0.6)],
                               "score_a double, score_b double, unstable boolean, no_signal boolean, strict boolean, "
                               "uniform_decision string, uniform_score_a double, uniform_score_b double")
    got = [(r.decision, r.policy, r.score_a) for r in C.stabilize(C.start(df)).collect()]
    assert got == [("A>B", "uniform_breaks_strict_tie", 0.6), ("B>A", "uniform_overrides_unstable_whitening", 0.4)]


def test_discrimination_keeps_all_when_none_pass(spark):
    rows = [("e", "r1", c, True) for c in range(4)] + [("e", "r2", c, False) for c in range(4)]
    df = spark.createDataFrame(rows, "example_id string, rubric_id string, candidate_id int, satisfied boolean")
    assert [r.kept for r in S.discrimination_filter(df, 0.05).collect()] == [True, True]


def test_misalignment_needs_both_sides(spark):
    rows = [("e", "r", 1, True, "gold_like"), ("f", "r", 2, True, "synthetically_degraded"), ("f", "r", 3, False, "gold_like")]
    df = spark.createDataFrame(rows, "example_id string, rubric_id string, candidate_id int, satisfied boolean, quality_bucket string")
    assert {r.example_id: r.misaligned for r in S.misalignment(df).collect()} == {"e": False, "f": True}


def test_folds_are_balanced_and_bounded(spark):
    rows = [(f"p{i:02d}", "x" if i < 14 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "pair_id string, source_family string")
    for seed in (None, 7):
        out = L.balanced_folds(df, 9, seed).collect()
        assert {r.fold_index for r in out} == set(range(6))
        sizes = [sum(r.fold_index == f and r.source_family == "x" for r in out) for f in range(6)]
        assert max(sizes) - min(sizes) <= 1


def test_uneven_shards_and_leaks_are_errors(spark):
    rows = spark.range(10).withColumnRenamed("id", "ordinal")
    with pytest.raises(ValueError):
        L.split_and_shard(rows, "ordinal", num_shards=3)
    assert L.split_and_shard(rows, "ordinal", "train", train_size=6, num_shards=3, shard_index=1).count() == 2
    assert sorted(r.ordinal for r in L.split_and_shard(rows, "ordinal", "val", train_size=6, val_size=3).collect()) == [6, 7, 8]
    with pytest.raises(ValueError):
        L.ensure_disjoint(rows, rows.where("ordinal > 8"), "ordinal")
    L.ensure_disjoint(rows.where("ordinal < 3"), rows.where("ordinal > 3"), "ordinal")


def test_join_reports_missing_pairs(spark):
    local = spark.createDataFrame([("p1", "s", "q"), ("p2", "s", "q")], "pair_id string, source string, question string")
    official = spark.createDataFrame([("p1", "o", "q", "a", "b", "A>B")],
                                     "pair_id string, source string, question string, response_a string, response_b string, label string")
    with pytest.raises(ValueError, match="p2"):
        L.join_pairs(local, official, "train")
    assert L.join_pairs(local.where("pair_id = 'p1'"), official, "train").first().source == "o"


def test_tolerant_and_strict_scan(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    rows = [{"id": "7", "question": "q", "reference_answer_a": "x", "reference_answer_b": "y", "correct_answer": 1, "extra": 3},
            {"id": "8", "task_prompt": "rewrite it", "response": "same", "reference_note": "same"},
            {"id": "9", "response_a": "x", "response_b": "y", "label": True}]
    path.write_text("\n".join([json.dumps(rows[0]), "", "{broken", "[1, 2]", json.dumps(rows[1]), json.dumps(rows[2])]))
    ex = {r.source_id: r for r in readers.normalize(readers.read_rows(spark, str(path))).collect()}
    assert set(ex) == {"7", "8", "9"}
    assert (ex["7"].pair_correct_label, json.loads(ex["7"].extra_fields)) == ("b", {"extra": "3"})
    assert (ex["8"].task_profile_id, ex["8"].augmented_artifact, ex["8"].artifact_kind) == ("note_documentation", "", "note")
    assert ex["9"].pair_correct_label == ""
    with pytest.raises(Exception):
        readers.read_rows(spark, str(path), strict=True).collect()


def test_payload_shapes(spark, tmp_path):
    for name, payload in (("a", [{"id": "1"}]), ("b", {"rows": [{"id": "1"}]}), ("c", {"examples": [{"id": "1"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
        assert [r.fields["id"] for r in readers.read_payload(spark, str(tmp_path / f"{name}.json")).collect()] == ["1"]


def test_pair_anchors_replace_note_anchors(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (
        {"id": "1", "reference_note": "n", "response_a": "a", "response_b": "b", "label": "a"},
        {"id": "2", "reference_note": "n", "note_truncated": "t"})))
    got = readers.anchors(readers.normalize(readers.read_rows(spark, str(path)))).collect()
    assert sorted(r.source_label for r in got) == ["note_truncated", "pair_response_a", "pair_response_b", "reference_note"]


def test_cache_last_record_wins(spark, tmp_path):
    folder = str(tmp_path / "cache")
    for value in ("old", "new"):
        writers.append_cache(spark.createDataFrame([("k", value)], "key string, v string").coalesce(1), folder)
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "key string, o int, v string")
    assert {r.key: r.v for r in M.latest_per_key(rows, "key", "o", ["v"]).collect()} == {"k": "new", "j": "x"}
    for i in range(4):  # many files, whose order is not that of writing
        writers.append_cache(spark.createDataFrame([("k", f"new{i}"), (f"only{i}", "x")], "key string, v string"), folder)
    cached = {r.key: json.loads(r.raw)["v"] for r in readers.read_cache(spark, folder).collect()}
    assert cached == {"k": "new3", **{f"only{i}": "x" for i in range(4)}}


def test_row_keys_do_not_depend_on_files(spark, tmp_path):
    lines = [json.dumps({"question": f"q{i}"}) for i in range(40)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines))
    (tmp_path / "many").mkdir()
    for i, line in enumerate(reversed(lines)):
        (tmp_path / "many" / f"{i}.jsonl").write_text(line)
    ids = [
        {r.example_id for r in readers.normalize(readers.read_rows(spark, str(tmp_path / p))).collect()}
        for p in ("one.jsonl", "many")
    ]
    assert ids[0] == ids[1] and len(ids[0]) == 40


@pytest.mark.parametrize("value,want", [(0, "a"), (1, "b"), ("1", ""), ("0", ""), (True, ""), (2, ""), ("A", "a"), (None, "")])
def test_label_types(spark, tmp_path, value, want):
    row = {"id": "1", "response_a": "x", "response_b": "y", "label": value}
    (tmp_path / "r.jsonl").write_text(json.dumps(row))
    (tmp_path / "p.json").write_text(json.dumps({"rows": [row]}))
    for rows in (readers.read_rows(spark, str(tmp_path / "r.jsonl")), readers.read_payload(spark, str(tmp_path / "p.json"))):
        assert readers.normalize(rows).first().pair_correct_label == want


def test_preference_ids_see_whole_texts(spark, tmp_path):
    same = "x" * 300
    rows = [{"prompt": same + str(i), "chosen": "c", "rejected": "r"} for i in range(2)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = readers.read_preferences(spark, str(tmp_path / "p.jsonl"), {}, "s").collect()
    assert len({r.pair_id for r in got}) == 2


def test_reasoning_is_whole_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([("word " * 400,)], "r string")
    whole, cut = df.select(writers.clipped(F.col("r"), None), writers.clipped(F.col("r"), 600)).first()
    assert whole == "word " * 400 and len(cut) <= 603 and cut.endswith("...")


def test_uneven_shards_are_an_error():
    from verdikt.operators import splits

    with pytest.raises(ValueError):
        splits.shard_of(F.lit(1), 9_997 * 6 // 10, 3)


def test_cache_join_falls_back(spark):
    req = spark.createDataFrame([("k1",), ("k2",)], "key string")
    cache = spark.createDataFrame([("k1", True)], "key string, verdict boolean")
    got = {r.key: (r.satisfied, r.cache_hit) for r in readers.cached_votes(req, cache, F.lit(False)).collect()}
    assert got == {"k1": (True, True), "k2": (False, False)}


def test_run_artifacts_last_path_wins(spark, tmp_path):
    folder = tmp_path / "run" / "final" / "examples"
    folder.mkdir(parents=True)
    for name, decision in (("a", "A>B"), ("b", "B>A")):
        (folder / f"{name}.json").write_text(json.dumps({
            "pair": {"pair_id": "p", "label": "A>B", "source_family": "f"},
            "scoring": {"whitened_uniform": {"result": {"decision": decision}}}}))
    rows = readers.read_run_artifacts(spark, str(tmp_path / "run")).collect()
    assert [(r.pair_id, r.decision) for r in rows] == [("p", "B>A")]


def test_package_and_reports(spark, tmp_path):
    evals = spark.createDataFrame([("s__1", "r", "c", True, "x" * 700), ("s__1", "r", "ghost", False, None)],
                                  "example_id string, rubric_id string, candidate_id string, satisfied boolean, reasoning string")
    rub = spark.createDataFrame([("s__1", "r", "T")], "example_id string, rubric_id string, text string")
    cand = spark.createDataFrame([("s__1", "c", "pair_anchor", "pair_response_b", "body")],
                                 "example_id string, candidate_id string, origin_kind string, source_label string, text string")
    out = {r.candidate_id: r for r in writers.package_evaluations(evals, rub, cand).collect()}
    assert (out["c"].id, out["c"].candidate_role, len(out["c"].reasoning)) == ("1", "pair_anchor_b", 700)
    assert (out["ghost"].candidate_role, out["ghost"].reasoning) == ("unknown", "")
    assert writers.write_bundle({"t": rub, "none": rub.where("false")}, str(tmp_path)) == ["t"]
    assert "| example_id |" in writers.markdown_table(rub)


def test_incremental_fold_is_idempotent(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    schema = "rubric_id string, satisfied boolean"
    for n in range(2):
        (inbox / f"{n}.json").write_text('{"rubric_id": "r", "satisfied": true}\n')
        incremental.fold_new_files(spark, str(inbox), schema, store, str(tmp_path / "cp"))
        total = incremental.running_coverage(spark.read.parquet(store)).first()
        assert (total.total, total.coverage_count) == (n + 1, n + 1)
    done = spark.createDataFrame([("a",)], "example_id string")
    assert incremental.pending(spark.createDataFrame([("a",), ("b",)], "example_id string"), done).count() == 1


def test_no_driver_side_or_local_shortcuts():
    from pathlib import Path

    for path in Path(__file__).resolve().parent.parent.joinpath("verdikt").rglob("*.py"):
        source = path.read_text()
        for banned in ("localCheckpoint", "crossJoin", ".toPandas("):
            assert banned not in source, f"{banned} in {path.name}"
