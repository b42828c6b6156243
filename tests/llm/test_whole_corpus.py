"""Corpus operators on inputs that an earlier form handled only in part."""

import pytest

from touchline.llm import mixing, queries


@pytest.mark.parametrize("batch", [59_999, 70_000])
def test_lm_chunk_of_many_empty_texts(spark, batch):
    """More rows than 16 bits number, in one slice or behind others, are each scored like the rest."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(batch))
    try:
        docs = spark.range(0, 70_000, 1, 1).selectExpr("id AS doc_id", "'' AS text", "false AS held_out")
        got = mixing.score_texts(docs).groupBy("n_tokens", "n_known", "base_score", "score").count().collect()
    finally:
        spark.conf.unset(key)
    assert [(r["n_tokens"], r["n_known"], r["count"]) for r in got] == [(1, 1, 70_000)]


def test_query_removes_passages_without_spaces_and_leaves_boilerplate(spark, tmp_path):
    block = "里山の朝は静かだ" * 300
    rows = [(k, f"own line number {k} of this text here\nAll rights reserved.\n{block}\nend {k}") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
    for k in (1, 2):
        assert got[k]["text"] == f"own line number {k} of this text here\nend {k}" and got[k]["n_removed"] == 1 and got[k]["chars_removed"] == len(block) + 22
