import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomtext import catalog, cli
from loomtext.functions.register import register
from loomtext.plans import pipeline
from loomtext.sources import files
from loomtext.streaming import streams


def test_prompt_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n---\n\n---\n second ")
    (tmp_path / "b.json").write_text(json.dumps({"prompts": ["x", {"id": "p", "content": "y"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"id": "q", "content": "z"}))
    (tmp_path / "d.jsonl").write_text('"one"\n\n{"id": "r", "content": "two"}\n')
    read = lambda name: [(r.id, r.content) for r in files.read_prompts(spark, str(tmp_path / name)).orderBy("ord").collect()]
    assert read("a.txt") == [(None, "first"), (None, "second")] and read("b.json") == [(None, "x"), ("p", "y")] and read("c.json") == [("q", "z")] and read("d.jsonl") == [(None, "one"), ("r", "two")]
    found = pipeline.process_prompts(spark, str(tmp_path / "b.json")).collect()
    assert sorted(r.id for r in found) == ["p_seg_0", "prompt_0_seg_0"]
    with pytest.raises(files.ValidationError):
        files.read_prompts(spark, "x", "xml")


def test_process_twice_with_a_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A first sentence here. A first sentence here! Another one stands here.")
    args = (spark, str(tmp_path / "in"))
    first = pipeline.process_file(*args, str(tmp_path / "out"), cache=str(tmp_path / "cache"), statistics=str(tmp_path / "stats.txt"))
    assert sorted(r.text for r in first.collect()) == ["A first sentence here.", "Another one stands here."] and "classification" in first.columns
    assert "segments_written: 2" in "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "stats.txt")).collect())
    assert pipeline.process_file(*args, str(tmp_path / "out2"), cache=str(tmp_path / "cache")).count() == 0
    assert pipeline.process_file(*args, str(tmp_path / "out3"), remove=False, classify=False).count() == 3


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Some sentence is here. And another one.")
    assert cli.main(["process", str(tmp_path / "a.txt"), "-o", str(tmp_path / "out"), "-g", "paragraph"]) == 0
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 1
    assert cli.main(["process", str(tmp_path / "none.txt"), "-o", str(tmp_path / "x")]) == 1
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("0.")


def test_crawl_and_sinks(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", "src/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.file.rpartition("/")[2] for r in files.crawl(spark, str(tmp_path), (".py",)).collect()] == ["a.py"]
    rows = spark.createDataFrame([("a",)], "text string")
    files.write_segments(rows, str(tmp_path / "s"), "json", "in")
    assert files.read_jsonl(spark, str(tmp_path / "s/metadata")).first().total_segments == 1
    files.write_jsonl(rows, str(tmp_path / "j"))
    files.write_jsonl(rows, str(tmp_path / "j"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "j"), "text string").count() == 2
    assert files.render_statistics({"a": 1}, "txt") == "a: 1"


def test_sql_names(spark):
    register(spark)
    assert spark.sql("select c.content from values ('a\nb') t(x), lateral loom_chunks(x, 3, 0) c").count() == 2
    assert [r.type for r in spark.sql("select b.* from values ('# H\n\nWhy?') t(x), lateral loom_blocks(x) b order by block").collect()] == ["heading", "question"]
    assert len(spark.sql("select loom_blake2b('x') as h").first().h) == 128


def test_buffer_of_a_stream(spark, tmp_path):
    chunks = [("s", 0, "Hel", False), ("s", 1, "lo. ", False), ("s", 2, "```\nx", False), ("s", 3, "\n```", False), ("s", 4, "tail", True), ("t", 0, "a\n\nb", False), ("t", 1, None, True)]
    spark.createDataFrame(chunks, "stream_id string, seq long, chunk string, done boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    found = streams.run_available(streams.buffered(streams.read_table(spark, str(tmp_path / "in"))), "t").orderBy("stream_id", "unit").collect()
    assert [(r.stream_id, r.content, r.done) for r in found] == [("s", "Hello.", False), ("s", "```\nx\n```", False), ("s", "tail", True), ("t", "a\n\nb", False), ("t", "", True)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_text(f"Sentence number {k} is here. A shared sentence is here.")
    seen = []
    stream = streams.segments_of_files(spark, str(tmp_path / "in"))
    write = lambda df, n: seen.extend(r.text for r in df.collect())
    streams.unseen_batches(stream, str(tmp_path / "index"), write, ["file", "seg_idx"], str(tmp_path / "state")).start().awaitTermination()
    (tmp_path / "in" / "9.txt").write_text("A shared sentence is here. A new one is here.")
    streams.unseen_batches(streams.segments_of_files(spark, str(tmp_path / "in")), str(tmp_path / "index"), write, ["file", "seg_idx"], str(tmp_path / "state")).start().awaitTermination()
    assert sorted(seen) == sorted(["A shared sentence is here.", "A new one is here.", *(f"Sentence number {k} is here." for k in range(4))])
    batch = pipeline.process_texts(files.read_texts(spark, str(tmp_path / "in")), "file", classify=False)
    assert sorted(r.text for r in batch.collect()) == sorted(seen)


def test_progress_is_counted(spark, tmp_path):
    import time

    spark.range(20).write.parquet(str(tmp_path / "in"))
    seen = []
    listener = streams.Progress(seen.append)
    spark.streams.addListener(listener)
    assert streams.run_available(streams.read_table(spark, str(tmp_path / "in")), "p").count() == 20
    for _ in range(100):
        if listener.counts["rows_read"] >= 20:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.counts["rows_read"] == 20 and seen[-1]["batches"] >= 1


def test_short_names(spark):
    from loomtext import api

    rows = spark.createDataFrame([(0, "User: hi"), (1, "User: hi"), (2, "Explain it")], "ord int, content string")
    found = api.quick_process(rows, ["ord"])
    assert [r.duplicate for r in found.orderBy("ord").collect()] == [False, True, False]
    batch = rows.select("ord", F.lit("p").alias("id"), "content")
    keeper = api.Prompts(auto_deduplicate=True)
    first = keeper.process(batch, ["ord"]).select("hash").persist()
    assert first.count() == 2
    keeper.remember(first)
    assert keeper.process(batch, ["ord"]).count() == 0
    keeper.reset()
    assert keeper.process(batch, ["ord"]).count() == 2


def test_dedup_stream_state_is_bounded(spark):
    found = streams.dedup_batch(spark, "/root/testdata/sf0.001/events.parquet", ["user_id", "event_type"])
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type").distinct().count()
    assert found.where(F.col("ts").isNull()).count() == 0


def test_dedup_stream_keeps_the_smallest_id(spark, tmp_path):
    """Whatever the order of arrival; rows without a time, a key or an id count as in SQL."""
    at, schema = f"{tmp_path}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string"
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [(k, day(k % 900), k % 7, "ab"[k % 2]) for k in range(3000, 0, -1)]
    rows += [(None, day(0), 0, "a"), (-1, None, 1, "a"), (-2, day(5), None, "a"), (-3, None, None, None), (None, day(1), 9, "a"), (8, day(2), 9, "a"), (None, day(1), 10, "b")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(at)
    spark.createDataFrame(sorted(rows, key=repr, reverse=True), schema).coalesce(1).write.mode("append").parquet(at)
    expected = {}
    for k, _, user, kind in rows:
        ids = [x for x in (k, expected.get((user, kind))) if x is not None]
        expected[user, kind] = min(ids) if ids else None
    found = catalog.queries()["stream_dedup"](spark, str(tmp_path)).collect()
    assert len(found) == len(expected) and {(r.user_id, r.event_type): r.event_id for r in found} == expected


def test_dedup_stream_of_several_batches(spark, tmp_path):
    """A later batch adds what comes before the rows held, and what they are too old for; the firsts are those of all rows."""
    schema, path = "k string, n long, ts timestamp", str(tmp_path / "in")
    days = [[("a", 5, 800), ("b", 5, 800), ("c", 5, 1)], [("a", 7, 801), ("b", 3, 1), ("b", 4, 801), ("c", 6, 801)], [("a", 5, 802), ("b", 9, 802), ("d", 1, None)]]
    for i, rows in enumerate(days):
        made = spark.createDataFrame([(k, n, None if d is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)) for k, n, d in rows], schema)
        made.coalesce(1).write.mode("append").parquet(path)
        stream = streams.read_table(spark, path)
        streams.first_batches(stream, str(tmp_path / "out"), ["k"], ["n"], "ts", "365 days", str(tmp_path / "state")).start().awaitTermination()
    read = lambda *i: spark.read.schema(schema).parquet(*(f"{tmp_path}/out/{x}" for x in i))
    assert [sorted((r.k, r.n) for r in read(i).collect()) for i in range(3)] == [[("a", 5), ("b", 5), ("c", 5)], [("b", 3), ("c", 6)], [("d", 1)]]
    assert sorted((r.k, r.n) for r in streams.firsts(read(0, 1, 2), ["k"], ["n"]).collect()) == [("a", 5), ("b", 3), ("c", 5), ("d", 1)]
