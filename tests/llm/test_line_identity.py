"""Rows that share a doc_id, or have none, keep what is theirs."""

from loomtext.llm import linededup

SHARED = "this line is the same in many of the documents here"


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(7, f"{SHARED}\nfirst alone has these words in it"), (7, f"other words stand in the second one only\n{SHARED}"), (None, f"{SHARED}\nno id but a line that nobody else holds"), (None, f"nobody else says this sentence at all\n{SHARED}")]
    rows += [rows[0], (7, None), (None, None), (None, ""), (8, "")]
    docs = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], "doc_id bigint, text string, row string, own int, dropped int, kept int").repartition(3)
    found = linededup.drop_lines(docs)
    assert found.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r["row"], r.own, r.dropped, r.kept) for r in found.collect()), key=repr)
    assert len(got) == len(rows) and all(x[2:] == ("a", 1, 2, 3) for x in got)
    texts = [x[1] for x in got]
    assert texts.count(None) == 2 and texts.count("") == 2
    alone = [t.replace(SHARED, "").strip("\n") for _, t in rows if t]
    assert sorted(t.replace(SHARED, "").strip("\n") for t in texts if t) == sorted(alone)
    # The shared line stays in the first document, whose two equal rows both have it.
    holds = [x for x in got if x[1] and SHARED in x[1]]
    assert len({(x[0], x[1]) for x in holds}) == 1 and holds[0][0] == 7


def test_many_rows_without_an_id(spark):
    """Null ids are not one document: each keeps what it alone has."""
    docs = spark.range(400).selectExpr("cast(null as bigint) as doc_id", f"concat('{SHARED}', char(10), repeat(concat(translate(cast(id as string), '0123456789', 'abcdefghij'), ' '), 6)) as text").repartition(5)
    found = linededup.document_lines(docs).collect()
    assert len(found) == 400 and sum(SHARED in r.text for r in found) == 1 and all(r.text.strip() for r in found)
