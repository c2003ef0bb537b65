"""Fidelity over every document of a table, those with accented letters too, against plain Python."""

import re

from pyspark.sql import functions as F

from loomtext import catalog
from loomtext.operators import responses
from loomtext.plans import inputs


def kept(old, new):
    if not old or not new:
        return False
    a, b = (set(re.findall(r"\b[a-zA-Z0-9]{4,}\b", x.lower())) for x in (old, new))
    return not a or len(a & b) / len(a) >= 0.7 and 0.2 <= len(new) / len(old) <= 2


def test_fidelity_of_all_documents(spark, sf):
    texts = {r[0]: (r[1], r[2]) for r in responses.normalize(inputs.decorated(spark, sf), "text", None).select("doc_id", "text", "normalized_content").collect()}
    found = {r.doc_id: r for r in catalog.queries()["fidelity_scores"](spark, sf).collect()}
    assert found.keys() == texts.keys() and any(not t.isascii() for t, _ in texts.values())
    for i, (old, new) in texts.items():
        assert (found[i].content_preserved, found[i].semantic_preserved) == (new != "", kept(old, new)), i


def test_terms_with_accents(spark):
    from loomtext.functions import validate

    pairs = [("señor café naïve rivers", "rivers"), ("émile bridges", "bridges"), ("ééééé", "é"), ("rivers éabcd abcdé", "rivers"), ("", "x"), ("words here", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", validate.semantic_preserved(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.a, r.b, r.s) for r in rows] == [(a, b, kept(a, b)) for a, b in pairs]
