"""The SQL beside a query leaves nothing to chance: statements run on tables full of ties."""

import duckdb
import pytest

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def dialogues():
    """Very many short dialogues, whose two hits have the same window."""
    con = duckdb.connect()
    con.execute("""create table conversations as select c as conv_id, t as turn, case t when 1 then 'assistant' else 'user' end as role,
        concat('Well, ', c, ' or ', t) as text from range(200000) x(c), range(3) y(t)""")
    return con


def blocks(con, query):
    return con.execute(f"select block_no, count(distinct request_id) from ({contract.oracle_sql()[query]}) x group by 1 order by 1").fetchall()


@pytest.mark.parametrize("query", ["context_blocks", "context_blocks_qa", "rendered_blocks"])
def test_equal_windows_are_one_block(dialogues, query):
    assert blocks(dialogues, query) == [(1, 200_000)]


def test_last_score_of_an_ordinal_counts():
    con = duckdb.connect()
    con.execute("create table events as select range as event_id, 50.0 as value, 'view' as event_type from range(600000)")
    found = con.execute(f"select ordinal, score, count(*) from ({contract.oracle_sql()['parse_rerank']}) x group by 1, 2 order by 1, 2").fetchall()
    assert found == [(1, 0.4, 600_000), (4, 1.0, 600_000)]
