from loomtext import catalog


def test_prompts_of_several_chunks_are_in_the_queries(spark, tmp_path):
    long = "\n".join(f"line {k} of a long prompt that goes on and on" for k in range(120))
    rows = [(1, 0, "user", "a short prompt"), (2, 0, "user", long), (2, 1, "assistant", long)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    segments = [r for r in run("prompt_segments") if r.prompt_id == "2-0"]
    lines = {x for r in segments for x in r.content.split("\n")}
    assert len(segments) > 2 and set(long.split("\n")) <= lines
    assert {r.prompt_id: r.segments for r in run("prompt_rollup")} == {"1-0": 1, "2-0": len(segments)}
    assert run("prompt_stats")[0].processed_count == 2 and run("validate_input")[0].total == 10
