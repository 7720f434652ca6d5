import contract
import pytest

from rainledger.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tiny, duck, name):
    contract.same(queries.QUERIES[name](spark, tiny), duck, queries.ORACLES[name])


COLUMNS = {"p1_found": "article_id_a article_id_b", "p2_found": "article_id line_no", "p3_found": "row_id field ref_id", "p4_found": "group_id article_id", "p5_found": "article_id line_no lang", "p8_ids": "doc_id ids", "p10_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.columns == COLUMNS[name].split() and df.count() > 0
