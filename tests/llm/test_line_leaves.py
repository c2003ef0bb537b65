from loomtext.llm import linededup


def name(k):
    return "".join(chr(97 + k // 26**p % 26) for p in range(3))


def test_templates_span_the_blocks_of_a_leaf(spark):
    """2 blocks and a line of one template: it stays in the first document only."""
    n = 2 * linededup.MOST + 1
    rows = [(k, f"own words of {name(k)}\nuser logged in from {name(k)} at the given time today") for k in range(n)]
    found = linededup.document_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: 1 in r.dropped for r in found} == {k: k > 0 for k in range(n)}
