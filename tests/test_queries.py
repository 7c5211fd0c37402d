import pytest
from oracle import assert_same

from oreweave import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_literals_are_annotated(spark, sf_dir):
    for r in queries.QUERIES["annotate_fuzzy"](spark, sf_dir).collect():
        assert f"puts(STRx{r['addr']:x})" in r["annotated"]
