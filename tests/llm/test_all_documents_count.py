from loomtext.llm import queries


def test_texts_without_words_are_in_the_totals(spark, tmp_path):
    rows = [(1, "two words", "en", "a"), (2, "", "en", "a"), (3, None, "en", "b"), (4, " \n", "de", "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    assert {k: n for k, (n, _) in found.items()} == {(s, x, t): n for s, x, n in (("a", "en", 2), ("b", "en", 1), ("b", "de", 1)) for t in ("words", "word_bpe_49k")}
    assert found["a", "en", "words"] == (2, 2) and found["b", "en", "word_bpe_49k"][1] == 1
