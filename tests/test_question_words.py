"""An ``or`` among the first words of a question is a word like others."""

from __future__ import annotations

from millrace.plans import services


def test_or_is_a_word(spark, tmp_path):
    spark.createDataFrame([(1, "red or blue?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "red", "src1"), (2, "blue", "src1"), (3, "blue or red", "src1")]
    spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in services.question_words(spark, str(tmp_path)).collect()] == [(1, 1)]
