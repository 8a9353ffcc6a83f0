"""Quotation links on a fixture, against expected rows and against the SQL twin."""

import duckdb
import pytest

from sunframe.llm import quoting
from sunframe.llm.queries import OP4_SQL

ROWS = [
    (1, 0, "user", "Hello there.\nHow are you today?"),
    (1, 1, "assistant", "> How are you today?\n\nI am fine."),
    (1, 2, "user", "On Monday somebody wrote:\n> i am   FINE.\nGood to hear"),
    (1, 3, "user", ">> Hello there.\n>> How are you today?\n> I am fine.\nBoth, then."),
    (2, 0, "user", "> Good to hear\nquoted from elsewhere"),
    (2, 1, "user", "> nobody said this\nok"),
    (2, 2, "user", "> own words\nown words"),
    (2, 3, "user", ">>>\n> !!\nno letters quoted"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (None, 0, "user", "> Hello there.\nno conversation"),
    (3, None, "user", "> Hello there.\nno turn"),
    (1, 1, "assistant", "> Hello there.\nthe same turn again"),
    (4, 0, "user", "a\n> Good to hear\nb\r\n> I am fine.\nc"),
]
SCHEMA = "conv_id long, turn long, role string, text string, root_turn string"


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)


def test_links_and_roots(spark, messages):
    got = {(r.conv_id, r.turn, r.clean_text): r for r in quoting.conversations_without_quotes(messages).collect()}
    assert len(got) == len(ROWS)
    reply = got[1, 1, "I am fine."]
    assert (reply.parent_conv, reply.parent_turn, reply.root_turn, reply.depth) == (1, 0, 0, 1)
    deep = got[1, 2, "Good to hear"]
    assert (deep.parent_turn, deep.root_turn, deep.depth) == (1, 0, 2)
    nested = got[1, 3, "Both, then."]
    assert nested.max_quote_level == 2 and nested.n_quotes == 2 and nested.n_linked == 2
    elsewhere = got[2, 0, "quoted from elsewhere"]
    assert (elsewhere.parent_conv, elsewhere.parent_turn, elsewhere.depth) == (1, 2, 0)
    assert got[2, 1, "ok"].parent_turn is None
    assert got[2, 2, "own words"].parent_turn is None
    assert got[3, 0, None].n_quotes == 0


def test_matches_sql(spark, messages, tmp_path):
    want_con = duckdb.connect()
    messages.toPandas().to_parquet(tmp_path / "m.parquet")
    want_con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/m.parquet'")
    res = want_con.execute(OP4_SQL)
    names = [d[0] for d in res.description]
    want = sorted((dict(zip(names, r)) for r in res.fetchall()), key=str)
    df = quoting.conversations_without_quotes(messages)
    got = sorted(({n: r[n] for n in names} for r in df.collect()), key=str)
    assert got == want


def test_empty(spark, messages):
    assert quoting.conversations_without_quotes(messages.limit(0)).count() == 0
