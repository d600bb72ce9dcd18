import duckdb
import pytest

from check_oracle import canonical
from verdikt.llm.queries import OP4_SQL, op4
from verdikt.llm.quotations import links, own_text, reply_ordered

MESSAGES = [
    (1, 0, "user", "The first question.\nIt has two lines.\n\nAnd a second\nparagraph."),
    (1, 1, "assistant", "> the  FIRST question.\n> It has two lines.\nYes, it has."),
    (1, 2, "user", ">> The first question.\n>> It has two lines.\n> Yes, it has.\n\nI know."),
    (1, 3, "user", "Something else."),
    (1, 4, "assistant", ">And a second\n> paragraph.\n\nAnswer to the second.\n> I know.\nAnd to that."),
    (1, 5, "user", "> Something else.\n> > nowhere said\nOnly this."),
    (1, 6, "user", "> Only this.\n"),
    (2, 0, "user", "> Something else.\nQuoted from another conversation."),
    (2, 1, "assistant", ">\n>  \n> > > deep\n"),
    (2, 2, "user", "Same."), (2, 3, "user", "Same."), (2, 4, "assistant", "> same.\nwhich one?"),
    (2, 4, "assistant", "> same.\nwhich one?"), (2, 4, "user", "another text of the same turn"),
    (3, 0, "user", "> quotes what comes later"), (3, 1, "user", "quotes what comes later"),
    (3, 2, "user", None), (3, 3, "user", ""), (None, 4, "user", "> Same."), (3, None, "user", "> Same.\nlost"),
    (4, 0, "user", "a > b is no quote\n\t > this is"),
]


@pytest.fixture
def planted(spark, tmp_path):
    table = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def rows_of(df):
    return {(r.conv_id, r.turn, r.text): r for r in df.collect()}


def test_links_and_reply_order(spark, planted):
    ordered = reply_ordered(spark.read.parquet(f"{planted}/conversations.parquet")).collect()
    assert len(ordered) == len(MESSAGES)
    first = [r.turn for r in ordered if r.conv_id == 1]
    assert first == [0, 1, 2, 4, 3, 5, 6]
    by = {(r.conv_id, r.turn): r for r in ordered}
    assert by[1, 2].reply_path == [0, 1, 2] and by[1, 2].text == "I know." and by[1, 2].max_depth == 2 and by[1, 2].n_linked == 2
    assert by[1, 4].parent_turn == 2 and by[1, 4].n_quotes == 2 and by[1, 4].text == "Answer to the second.\nAnd to that."
    assert by[1, 5].n_quotes == 2 and by[1, 5].n_linked == 1 and by[1, 6].reply_path == [3, 5, 6] and by[1, 6].text == ""
    assert by[2, 0].n_linked == 1 and by[2, 0].parent_turn is None and by[2, 1].n_quotes == 1 and by[2, 1].n_linked == 0
    assert [r.parent_turn for r in ordered if (r.conv_id, r.turn) == (2, 4)].count(2) == 2
    assert by[3, 0].n_linked == 0 and by[3, 2].text is None and by[4, 0].text == "a > b is no quote"


def same_as_sql(spark, folder):
    df = op4(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    cur = con.execute(OP4_SQL)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_query_matches_sql_on_planted_quotes(spark, planted):
    same_as_sql(spark, planted)


def test_no_python_in_the_plan(spark, planted):
    df = reply_ordered(spark.read.parquet(f"{planted}/conversations.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_empty_and_clashing_columns(spark, planted):
    table = spark.read.parquet(f"{planted}/conversations.parquet").selectExpr("*", "1 as path", "'x' as hash", "2 as depth")
    assert reply_ordered(table).count() == len(MESSAGES)
    assert reply_ordered(table.limit(0)).count() == 0


def test_partial_quotes_and_originals_elsewhere(spark, tmp_path):
    three = "First paragraph here.\n\nSecond paragraph, which is longer.\n\nThird one."
    five = "line one\nline two is here\nline three\nline four\nline five"
    rows = [
        (1, 0, "user", three), (1, 1, "assistant", five), (1, 2, "user", "> First paragraph here.\n>\n> Second paragraph, which is longer.\nYes."),
        (1, 3, "user", "> line two is here\n> line three\nNo."), (1, 4, "user", "> line one\n> Second  paragraph, which is longer.\nBoth."),
        (1, 5, "user", "> words of nobody\n> and of nobody else\nWho?"), (1, 6, "user", "> said later here\nOnly elsewhere so far."),
        (1, 7, "user", "said later here"), (2, 0, "user", "nothing"), (2, 5, "user", "said later here"), (3, 0, "user", "said later here"),
        (4, 0, "user", "> said later here\nA fourth."), (2, 6, "user", "> said later here\nIts own."),
        (5, 0, "user", "Thanks."), (6, 0, "user", "> A long line of many words that nobody here ever wrote.\n> Thanks.\nWhat?"),
        (5, 1, "user", "> Thanks.\nWelcome."),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    same_as_sql(spark, str(tmp_path))
    got = {(r.conv_id, r.turn): (r.to_conv, r.to_turn) for r in links(table).collect()}
    assert got == {
        (1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (1, 0), (1, 5): (None, None), (1, 6): (2, 5), (4, 0): (1, 7), (2, 6): (2, 5), (6, 0): (None, None), (5, 1): (5, 0),
    }
    paths = {(r.conv_id, r.turn): (r.n_linked, r.reply_path) for r in reply_ordered(table).collect()}
    assert paths[1, 2] == (1, [0, 2]) and paths[1, 3] == (1, [1, 3]) and paths[1, 6] == (1, [6])
