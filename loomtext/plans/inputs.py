"""Inputs that the queries derive from the test tables, in expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document's text with markdown, code, reasoning, dialogue, JSON or XML around it, by doc_id.
_DECORATION = """case cast(doc_id % 8 as int)
 when 0 then concat('# ', source, chr(10), chr(10), text, chr(10), chr(10), '## Notes', chr(10), chr(10), '- item one', chr(10), '- item two')
 when 1 then concat('```PYTHON', chr(10), chr(10), 'def f():', chr(10), '    return 1', chr(10), chr(10), '```', chr(10), chr(10), text)
 when 2 then concat('<thinking>', chr(10), 'step one', chr(10), '</thinking>', chr(10), chr(10), text)
 when 3 then concat('System: be brief', chr(10), chr(10), 'Let me think about it.', chr(10), chr(10), text)
 when 4 then concat('User: ', text, chr(10), 'Assistant: ok')
 when 5 then concat('{"id": ', cast(doc_id as varchar(20)), ', "items": [1, 2, 3]}')
 when 6 then concat('<doc><t>', replace(text, '<', ''), '</t></doc>')
 else text end"""
#: An event's JSON, broken in four ways.
_BREAKAGE = """case cast(event_id % 5 as int)
 when 0 then props
 when 1 then replace(props, '}', ',}')
 when 2 then replace(props, '"', chr(39))
 when 3 then concat('Result: ', props, ' done')
 else 'no data here' end"""
#: The same in DuckDB.
DECORATED = f"select doc_id, source, lang, {_DECORATION} as text from documents"
BROKEN = f"select event_id, {_BREAKAGE} as raw from events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.expr(_DECORATION).alias("text"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_BREAKAGE).alias("raw"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as payloads of four providers: conv_id, turn, raw."""
    c, n, t = F.col("conv_id"), F.col("turn"), F.col("text")
    message = F.struct(F.lit("assistant").alias("role"), t.alias("content"))
    openai = F.struct(F.concat(F.lit("c"), c.cast("string")).alias("id"), F.lit("gpt-4").alias("model"), F.array(F.struct(message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(c.alias("prompt_tokens"), n.alias("completion_tokens"), (c + n).alias("total_tokens")).alias("usage"))
    anthropic = F.struct(F.concat(F.lit("m"), c.cast("string")).alias("id"), F.lit("claude-3").alias("model"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"), F.lit("end_turn").alias("stop_reason"), F.struct(c.alias("input_tokens"), n.alias("output_tokens")).alias("usage"))
    ollama = F.struct(F.lit("llama2").alias("model"), t.alias("response"), (n % 2 == 0).alias("done"), c.alias("prompt_eval_count"), n.alias("eval_count"))
    kind = (c + n) % 4
    raw = F.when(kind == 0, F.to_json(openai)).when(kind == 1, F.to_json(anthropic)).when(kind == 2, F.to_json(ollama)).otherwise(F.to_json(F.struct(t.alias("text"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))


#: The same payloads in DuckDB.
PAYLOADS = """
select conv_id, turn, text, case cast((conv_id + turn) % 4 as int)
 when 0 then json_object('id', concat('c', conv_id), 'model', 'gpt-4', 'choices', json_array(json_object('message', json_object('role', 'assistant', 'content', text), 'finish_reason', 'stop')), 'usage', json_object('prompt_tokens', conv_id, 'completion_tokens', turn, 'total_tokens', conv_id + turn))
 when 1 then json_object('id', concat('m', conv_id), 'model', 'claude-3', 'content', json_array(json_object('type', 'text', 'text', text)), 'stop_reason', 'end_turn', 'usage', json_object('input_tokens', conv_id, 'output_tokens', turn))
 when 2 then json_object('model', 'llama2', 'response', text, 'done', turn % 2 = 0, 'prompt_eval_count', conv_id, 'eval_count', turn)
 else json_object('text', text) end as raw
from conversations
"""
