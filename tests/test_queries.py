"""Every registered query of the reference's operators against its SQL."""

import pytest

import __spark_entry__ as entry
from tessella.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_display_covers_every_document(spark, tmp_path):
    texts = ["éa", "日本語", "abc", "", "plain text", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["preview"] for r in QUERIES["display_text"](spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else t.encode()[:4].hex().upper() + "..." * (len(t.encode()) > 4) for i, t in enumerate(texts)}
