from loomtext.llm import linededup


def test_short_lines_that_recur_go(spark):
    rows = [(k, f"All rights reserved.\nAnd ornd.\n\none two three {name}\nchapter {k} of nine") for k, name in enumerate(("red", "blue", "green"))]
    found = linededup.document_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.dropped) for r in found} == {0: [], 1: [0, 1, 4], 2: [0, 1, 4]}
