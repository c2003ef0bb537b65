from collections import Counter

import corpus_pipeline
from loomtext.llm import linededup, mixing, neardup, packing, quality


def write(docs, labels, path):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_turn(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(30)], "doc_id bigint, quality int, toxic int")
    path = write(docs, labels, tmp_path / "in")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    operators = [lambda d: quality.keep_good(d, labels), linededup.drop_lines, neardup.drop_near, mixing.mix_documents, packing.pack_documents]
    for k, ((_, stage), operator) in enumerate(zip(corpus_pipeline.STAGES, operators, strict=True)):
        out = stage(spark, now, path)
        assert k == 4 or out.columns == columns
        key = [x for x in out.columns if x not in ("sequence_id", "offset")]
        assert Counter(map(str, out.select(key).collect())) == Counter(map(str, operator(now).select(key).collect()))
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.schema(out.schema).parquet(f"{tmp_path}/stage{k}")
    assert corpus_pipeline.run(spark, path).count() == now.count() > 0


def test_empty_tables_go_through(spark, none, tmp_path):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert corpus_pipeline.run(spark, write(none, labels, tmp_path / "in")).count() == 0
