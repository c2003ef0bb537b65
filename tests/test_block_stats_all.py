from loomtext import catalog
from loomtext.operators import blocks
from loomtext.plans import inputs


def test_documents_with_lists_are_counted(spark, tmp_path):
    rows = [(k, "some prose\n\n- one\n- two\n\nmore prose", "s", "en") for k in range(16)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {r.doc_id: sum(b["type"] == "list" for b in blocks.scan(r.text, False)) for r in inputs.decorated(spark, str(tmp_path)).collect()}
    found = {r.doc_id: r["list"] for r in catalog.queries()["block_stats"](spark, str(tmp_path)).collect()}
    assert found == expected and sum(found.values()) > 2
