import duckdb
import pytest
from oracle import assert_same

from oreweave.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_language_held_out(spark, sf_dir):
    rows = queries.op3_language_id(spark, sf_dir).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf_dir}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_runs(spark, sf_dir):
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
