"""Text queries see whole lines."""

from lodestrata.plans import text_queries as Q


def test_long_headers_are_searched_whole(spark, tmp_path):
    line = "x" * 50 + " the end of it"
    spark.createDataFrame([(1, f"{line}\nplain")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = Q.markdown_search(spark, str(tmp_path)).collect()
    assert [(r.title, r.match_type) for r in hits] == [(line, "header")]
    assert line in Q.markdown_answers(spark, str(tmp_path)).first().answer
