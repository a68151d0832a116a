"""Every catalogue query against its SQL."""

import pytest

from tessella.plans.oracles import SQL
from tessella.plans.queries import QUERIES
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


#: Queries without SQL: their operators have tests of their own.
OTHERS = {"rouge_l", "segment_extract", "slot_rewrite", "slot_template", "slot_rerank", "phrase_rerank", "learned_ranker"}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_all_others_have_sql():
    assert set(QUERIES) - set(SQL) == OTHERS
