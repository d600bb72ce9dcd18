"""Rounds of rubric refinement: every gate, a replacement, and what stays unfinished."""

from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.operators import refinement as RF

SCHEMA = "id bigint, texts array<string>, buckets array<string>, seeds array<string>"
POOL = (["chief complaint: pain, plan: aspirin 5 mg, return soon", "plan", "nothing at all", "follow up"],
        ["gold_like", "strong_anchor", "synthetically_degraded", "frontier_generated"])


def refine(spark, seeds, pool=POOL, **limits):
    df = spark.createDataFrame([(1, *pool, seeds)], SCHEMA)
    return RF.refined(df, "id", **limits).first()


def test_gates_in_order(spark):
    row = refine(spark, [
        "The note includes the first of all things here",
        "the NOTE includes the first of  all things here",           # the same text: once
        "The note includes the first of all things here today",     # overlap
        "The note avoids things first here",                         # opposite side, same tokens: conflict
        " ", None,
    ], most_depth=0)
    assert (row.overlap, row.conflict, row.misaligned, row.rejected_count) == (1, 1, 0, 2)
    assert row.final_count == 1 + len(RF.INITIAL_RUBRICS) and row.status == "complete"


def test_misaligned_when_weak_candidates_do_better(spark):
    pool = (["nothing", "aspirin 5 mg"], ["gold_like", "synthetically_degraded"])
    row = refine(spark, ["The note lists medication by name"], pool, most_depth=0)
    assert row.misaligned == 3  # the seed and the two default rubrics that name medications


def test_a_broad_rubric_gives_way_to_children_that_split_it(spark):
    parent, one, two = ([True] * 4 + [False], [True, True, True, False, False], [False, False, True, True, False])
    frame = spark.createDataFrame([(parent, one, two)], "p array<boolean>, a array<boolean>, b array<boolean>")
    assert frame.select(RF.splits_well(F.col("p"), F.col("a"), F.col("b"))).first()[0]
    assert not frame.select(RF.splits_well(F.col("p"), F.col("a"), F.col("p"))).first()[0]
    assert not frame.select(RF.splits_well(F.col("p"), F.col("a"), F.col("a"))).first()[0]
    # all five candidates have a structure; four of them medication, return and so on
    texts = ["plan 5 mg return", "plan 5 mg return", "plan 5 mg return", "plan return", "plan"]
    buckets = ["gold_like", "frontier_generated", "other", "other", "other"]
    rounds = refine(spark, [], (texts, buckets))
    assert rounds.superseded_count + rounds.no_gain + rounds.overlap > 0
    assert rounds.final_count == len(RF.INITIAL_RUBRICS) - rounds.misaligned + rounds.superseded_count


def test_unfinished_rows_say_so(spark):
    seeds = [f"The note includes one and two and three and four and five and six number{i}" for i in range(30)]
    row = refine(spark, seeds)
    assert row.status == "stopped" and row.unfinished_count > 0 and row.rejected_count > 15
    free = refine(spark, seeds, most_rejected=10_000)
    assert free.status == "complete" and free.unfinished_count == 0


def test_the_plan_is_a_map_of_expressions(spark):
    df = spark.createDataFrame([(i, *POOL, ["x"]) for i in range(5)], SCHEMA)
    out = RF.refined(df, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan.replace("PythonRDD", "")
    assert len({tuple(r)[1:] for r in out.collect()}) == 1


def test_candidates_are_read_once_for_all_rules(spark):
    """Each rule lower-cased and searched every candidate of its own; the facts are those of the rule function."""
    texts = ["Chief Complaint: 5 MG daily", "mgx Metformin", "no plan; FOLLOW up", "", "omg", "History", None]
    sides = ["gold_like", "synthetically_degraded", "strong_anchor", "note_truncated", "frontier_generated", "x", "gold_like"]
    facts = RF.rule_facts(F.col("texts"), F.col("buckets"))
    assert str(facts).count("lower(") == 1
    got = spark.createDataFrame([(texts, sides)], "texts array<string>, buckets array<string>").select(facts.alias("f")).first().f
    rows = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, sides))], "i int, t string, b string")
    for (wording, _), fact in zip(RF.RULES, got, strict=True):
        hit = F.coalesce(X.heuristic_satisfaction(F.col("t"), F.col("b"), F.lit(wording)), F.lit(False))
        assert fact.hits == [r.h for r in rows.orderBy("i").select(hit.alias("h")).collect()]
    assert got[1].hits == [True, True, False, False, False, False, False]
