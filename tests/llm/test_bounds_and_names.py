"""Bounded samples, clashing names, broken images, scores of whole texts."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import media, quality, toxicity
from loomtext.llm.common import fold, partitions_for
from tests.llm.conftest import prose


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(k, prose(k, 30)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(spark.range(100_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("copy "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, y: seen.append(len(x)) or quality.Rules(0.0))
    quality.fit(docs, labels)
    assert seen and seen[0] <= 40


def test_the_sample_of_texts_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    texts, own = toxicity.sample(docs, labels, "toxic", 100, 3, 1, most_chars=5000)
    assert len(texts) == len(own) == 10 and all(x == "word " * 100 for x in texts)


def test_clashing_names_stay_or_are_replaced(spark):
    rows = [(k, prose(k, 30), "q", 5, b"x" * k) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __q_words string, toxicity int, payload binary")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, labels, least=0.0)
    assert kept.columns == docs.columns and {r["__q_words"] for r in kept.collect()} == {"q"}
    scored = toxicity.score(docs, toxicity.Model({}, {}, 0.25))
    assert scored.columns.count("toxicity") == 1 and {r.toxicity for r in scored.collect()} == {0.25}
    stored = media.media_features(media.add_media(docs.withColumn("media", F.lit(1)).withColumn("feature", F.lit("old"))))
    assert stored.columns.count("feature") == 1 and all(len(r.feature) == 16 for r in stored.collect())


def test_unknown_sizes_take_the_session_s_number(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark.createDataFrame([(1,)], "a int")) == n
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert partitions_for(table) == n < partitions_for(table, 1000)


def plain_unfilter(stream):
    """Sample by sample, as the format defines its filters."""
    rows, above = [], [0] * (stream.shape[1] - 1)
    for kind, *row in stream.tolist():
        out = []
        for i, x in enumerate(row):
            left, up, corner = out[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = left + up - corner
            near = min((abs(p - v), k) for k, v in enumerate((left, up, corner)))[1]
            out.append((x + (0, left, up, (left + up) // 2, (left, up, corner)[near])[kind]) & 255)
        rows.append(out)
        above = out
    return np.asarray(rows, np.uint8)


def test_every_filter_is_undone():
    rng = np.random.default_rng(8)
    for height in (1, 2, 7, 90):
        stream = rng.integers(0, 256, (height, 65), dtype=np.uint8)
        for kinds in (rng.integers(0, 5, height), np.full(height, 3), np.full(height, 4)):
            stream[:, 0] = kinds
            assert (media._unfilter(stream) == plain_unfilter(stream)).all()


def test_broken_headers_are_media_errors(spark):
    def png(head, body=b""):
        return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(body)) + media._chunk(b"IEND", b"")

    for image in (png(b"abc"), png(struct.pack(">IIBBBBB", 64, 0, 8, 0, 0, 0, 0)), png(struct.pack(">IIBBBBB", 0, 0, 8, 0, 0, 0, 0)), b"", media.SIGNATURE):
        with pytest.raises(media.MediaError):
            media.decode(image)
    df = spark.createDataFrame([(1, png(b"abc")), (2, None)], "doc_id bigint, media binary")
    assert [r.feature for r in media.media_features(df, errors="null").collect()] == [None, None]


def test_scores_are_those_of_all_windows_one_by_one():
    """Each window through the network by itself, with inputs made for it alone; the document's score is the greatest."""
    texts = [prose(k, 30 + 7 * k) + (" vile awful curse" if k % 3 == 0 else "") for k in range(30)]
    model = toxicity.train(texts, [int(k % 3 == 0) for k in range(30)], rounds=3, least_documents=2)
    more = [*texts, "", "x" * 500, "one", " ".join(["z" * 70] * 40), prose(5, 900) + " vile awful curse " + prose(6, 500)]
    expected = []
    for text in more:
        words = [toxicity.bare(x) for x in toxicity.words_of(text)] or [""]
        best = -np.inf
        for at in range(0, max(1, len(words) - toxicity.STRIDE), toxicity.STRIDE):
            x = model.inputs(words[at : at + toxicity.WINDOW])[:, None, :]
            best = max(best, float(toxicity.forward(model.p, x, np.ones((len(x), 1), bool))[0]))
        expected.append(1 / (1 + np.exp(-np.clip(best, -30, 30))))
    assert np.allclose(toxicity.Scorer(model).score(more), expected, atol=1e-5)


def test_held_out_rows_of_the_real_table(spark):
    """Accuracy over labelled documents that no training saw: sf0.1, as sf0.01 has too few labels to learn toxicity well."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    for label, folds, held, score in (("toxic", 3, 1, lambda d: toxicity.score(d, toxicity.fit(docs, labels)).withColumnRenamed("toxicity", "p")), ("quality", 5, 0, lambda d: quality.score(d, quality.fit(docs, labels), "p"))):
        rows = score(labelled.where(fold("doc_id", folds) == held)).join(labels, "doc_id").select("p", label).toPandas()
        y, p = rows[label].to_numpy(), rows["p"].to_numpy()
        auc = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean()
        assert len(rows) > 300 and auc > 0.9, (label, auc)
