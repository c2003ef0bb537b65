"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import classify as C
from loomtext.functions import jsonx, providers, rx, validate
from loomtext.functions import text as T
from loomtext.operators import blocks, chunk, dedup, prompts, responses, segment, stats
from loomtext.plans import inputs, pipeline, sql
from loomtext.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "conversations")


def _long(name: str):  # noqa: ANN202
    return F.col(name).cast("bigint").alias(name)


# Text functions


@query("select doc_id, length(text) // 4 as token_estimate, length(text) as chars from documents")
def doc_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).cast("bigint").alias("token_estimate"), F.length("text").cast("bigint").alias("chars"))


@query("select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from documents")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(T.hash_chunk(F.col("text"), x).alias(x) for x in ("sha256", "md5", "sha1")))


@query()
def doc_hash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.hash_text(F.col("text"), "blake2b").alias("hash"))


@query(f"with d as ({inputs.DECORATED}) select doc_id, sha256({sql.whitespace_normal('text')}) as hash from d")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decorated(spark, sf_dir).select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("hash"))


@query(rf"""with d as ({inputs.DECORATED}) select doc_id, len(regexp_extract_all(text, '(?s)```(\w+)?\n(.*?)```')) as blocks,
 coalesce(regexp_extract(text, '(?s)```(\w+)?\n(.*?)```', 1), '') as language, {sql.strip(r"regexp_extract(text, '(?s)```(\w+)?\n(.*?)```', 2)")} as content, instr(text, '```') - 1 as start_pos
 from d where contains(text, '```')""")
def code_blocks_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.decorated(spark, sf_dir).withColumn("b", T.code_blocks(F.col("text"))).where("size(b) > 0")
    return found.select("doc_id", F.size("b").cast("bigint").alias("blocks"), F.col("b")[0]["language"].alias("language"), F.col("b")[0]["content"].alias("content"), F.col("b")[0]["start"].cast("bigint").alias("start_pos"))


@query(rf"with d as ({inputs.DECORATED}) select doc_id, regexp_matches(text, '\*\*.*?\*\*') as bold, regexp_matches(text, '\*.*?\*') as italic, regexp_matches(text, '`.*?`') as code, regexp_matches(text, '\[.*?\]\(.*?\)') as links from d")
def inline_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decorated(spark, sf_dir).select("doc_id", T.inline_formatting(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as preview from documents")
def doc_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("select doc_id from documents where length(text) between 100 and 2000")
def text_content_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(validate.text_content(F.col("text"), 100, 2000)).select("doc_id")


# Dedup

_HASHED = f"select doc_id, lang, source, text, sha256({sql.dedup_normal('text')}) as hash from documents where length(text) >= 10"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hashed(_docs(spark, sf_dir))


@query(f"select doc_id, hash from ({_HASHED})")
def dedup_normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).where("hash is not null").select("doc_id", "hash")


@query(f"select d.doc_id, coalesce(h.n > 1, false) as duplicate from documents d left join (select doc_id, row_number() over (partition by hash order by doc_id) as n from ({_HASHED})) h using (doc_id)")
def dedup_flag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flag(_hashed(spark, sf_dir), ["doc_id"]).select("doc_id", "duplicate")


@query(f"select doc_id from documents where length(text) < 10 union all select min(doc_id) from ({_HASHED}) group by hash")
def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.survivors(_hashed(spark, sf_dir), ["doc_id"]).select("doc_id")


@query(f"select hash, arg_min(case when length(text) > 200 then left(text, 200) || '...' else text end, doc_id) as text, '2024-01-01T00:00:00' as first_seen, count(*) as occurrences from ({_HASHED}) group by hash")
def dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.index(_hashed(spark, sf_dir), ["doc_id"], seen=F.lit("2024-01-01T00:00:00"))


@query(f"""with f as (select *, row_number() over (partition by hash order by doc_id) > 1 as dup from ({_HASHED}))
 select lang, count(*) as total_processed, count(*) filter (not dup) as unique_content, count(*) filter (dup) as duplicates_found, count(*) filter (dup) / count(*)::double as dedup_ratio from f group by lang""")
def dedup_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(_hashed(spark, sf_dir), ["doc_id"], "lang")


def _sentence_hashes(df: DataFrame, key: str) -> DataFrame:
    return dedup.hashed(segment.segment(df.select(key, "text")))


def _benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.index(_sentence_hashes(inputs.table(spark, sf_dir, "benchmark"), "item_id"), ["item_id", "seg_idx"], seen=F.lit(""))


_BOTH = f"""{sql.sentences()}, {sql.sentences("benchmark", "item_id", prefix="b_")},
 s as (select doc_id, seg_idx, sha256({sql.dedup_normal('text')}) as hash from sentences where length(text) >= 10), b as (select distinct sha256({sql.dedup_normal('text')}) as hash from b_sentences where length(text) >= 10)"""


@query(f"with {_BOTH} select doc_id, count(*) as sentences from s anti join b using (hash) group by doc_id")
def dedup_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.unseen(_sentence_hashes(_docs(spark, sf_dir), "doc_id"), _benchmark_index(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("hash").alias("sentences")).where("sentences > 0")


@query(f"with {_BOTH} select doc_id, seg_idx, hash from s semi join b using (hash)")
def dedup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.known(_sentence_hashes(_docs(spark, sf_dir), "doc_id"), _benchmark_index(spark, sf_dir)).select("doc_id", _long("seg_idx"), "hash")


@query(f"""with f as (select *, row_number() over (partition by hash order by doc_id) > 1 as dup from ({_HASHED}))
 select count(*) as total_processed, count(*) filter (not dup) as unique_content, count(*) filter (dup) as duplicates_found, count(*) filter (dup) / count(*)::double as dedup_ratio from f""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.statistics(dedup.flag(_hashed(spark, sf_dir), ["doc_id"]))


_KNOWN = f"select distinct sha256({sql.dedup_normal('text')}) as hash from benchmark where length(text) >= 10"


@query(f"""with h as (select hash, row_number() over (partition by hash order by doc_id) > 1 as dup from ({_HASHED})), k as ({_KNOWN}), f as (select h.*, hash in (select hash from k) as hit from h),
 s as (select count(*) as total_processed, count(*) filter (dup or hit) as duplicates_found, count(*) filter (hit) as cache_hits from f)
 select total_processed, total_processed - duplicates_found as unique_content, duplicates_found, cache_hits, (select count(*) from (select hash from h union select hash from k)) as unique_hashes, duplicates_found / total_processed::double as dedup_ratio from s""")
def dedup_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a run that knows the benchmark's texts."""
    known = dedup.hashed(inputs.table(spark, sf_dir, "benchmark")).where("hash is not null")
    return dedup.index_statistics(dedup.flag(_hashed(spark, sf_dir), ["doc_id"]), known)


@query(f"with h as ({_HASHED}), i as (select hash, count(*) as occurrences from h group by hash) select doc_id, occurrences from h join i using (hash)")
def dedup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).where("hash is not null")
    return dedup.lookup(rows, dedup.index(rows, ["doc_id"])).select("doc_id", "occurrences")


@query(f"select hash, 2 * count(*) as occurrences from ({_HASHED}) group by hash")
def dedup_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = dedup.index(_hashed(spark, sf_dir), ["doc_id"], seen=F.lit(""))
    return dedup.merge_index(one, one).select("hash", "occurrences")


# Segments


@query(f"with {sql.sentences()} select doc_id, seg_idx, text, start_pos, end_pos from sentences")
def sentences_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", _long("seg_idx"), "text", _long("start_pos"), _long("end_pos"))


@query(f"with {sql.sentences(more='lang')} select lang, count(*) as sentences, sum(length(text))::bigint as chars from sentences group by lang")
def sentences_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment(_docs(spark, sf_dir).select("doc_id", "lang", "text"))
    return found.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))


@query(f"""with {sql.sentences(more='lang')}, h as (select *, sha256({sql.dedup_normal('text')}) as hash from sentences where length(text) >= 10),
 f as (select *, row_number() over (partition by hash order by doc_id, seg_idx) > 1 as dup from h)
 select lang, count(*) as total_processed, count(*) filter (not dup) as unique_content, count(*) filter (dup) as duplicates_found, count(*) filter (dup) / count(*)::double as dedup_ratio from f group by lang""")
def sentence_dedup_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.hashed(segment.segment(_docs(spark, sf_dir).select("doc_id", "lang", "text")))
    return dedup.summary(found, ["doc_id", "seg_idx"], "lang")


@query(rf"""with d as ({inputs.DECORATED}), p as (select doc_id, unnest(string_split_regex(text, '\n\s*\n')) as part from d), k as (select doc_id, part, {sql.strip('part')} as body from p)
 select doc_id, sha256(part) as hash, case when regexp_matches(body, '^#{{1,6}}\s+') then 'heading' when regexp_matches(body, '^[-*+]\s+') or regexp_matches(body, '^\d+\.\s+') then 'list_item'
 when starts_with(body, '```') or starts_with(body, '~~~') then 'code_block' else 'paragraph' end as type from k where body <> ''""")
def paragraphs_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment(inputs.decorated(spark, sf_dir), "paragraph")
    return found.select("doc_id", F.sha2("text", 256).alias("hash"), "type")


@query(f"with d as ({inputs.DECORATED}) select doc_id, regexp_extract(text, '(?s)```.*?```') as text, 0::bigint as start_pos, length(regexp_extract(text, '(?s)```.*?```')) as end_pos, 'fenced' as code_type from d where contains(text, '```')")
def code_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment(inputs.decorated(spark, sf_dir)).where("type = 'code_block'")
    return found.select("doc_id", "text", _long("start_pos"), _long("end_pos"), "code_type")


@query()
def segments_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(inputs.decorated(spark, sf_dir)).select("doc_id", _long("seg_idx"), "text", "type", _long("start_pos"), _long("end_pos"))


# Chunks


@query()
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", _long("chunk_id"), F.sha2("content", 256).alias("hash"), _long("length"), "chunk_type")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_idx from documents),
 w as (select doc_id, line_idx, line, unnest(range(0, length(line), 248)) as low from l where length(line) + 1 > 256) select doc_id, line_idx, low // 248 as frag_idx, substring(line, low + 1, 256) as content from w""")
def long_line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk.long_line_fragments(_docs(spark, sf_dir).select("doc_id", "text"), most=256, overlap=8)
    return found.select("doc_id", _long("line_idx"), _long("frag_idx"), "content")


# Classification


@query(r"""select doc_id, regexp_matches(text, '(?m)[{}\[\]()]') as brackets, least(1.0, 50.0 * (length(text) - length(translate(text, '.?!', ''))) / length(text))::double as ender_share,
 ((contains(text, '.')::int + contains(text, ',')::int + contains(text, '?')::int + contains(text, '!')::int + contains(text, ':')::int + contains(text, ';')::int) / 6.0)::double as variety,
 len(regexp_extract_all(text, '[^\r\n]+')) as filled_lines from documents""")
def classify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    variety = rx.flag_count(*(F.contains(t, F.lit(x)) for x in ".,?!:;")) / 6
    enders = F.least(F.lit(1.0), 50.0 * (F.length(t) - F.length(F.translate(t, ".?!", ""))) / F.length(t))
    filled = F.size(F.filter(rx.split_lines(t), lambda x: x != "")).cast("bigint")
    return _docs(spark, sf_dir).select("doc_id", rx.found(t, r"[{}\[\]()]", "m").alias("brackets"), enders.alias("ender_share"), variety.alias("variety"), filled.alias("filled_lines"))


_KEYWORDS = ", ".join(f"'{x}'" for x in C.KEYWORDS)
_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')"
_CLASSIFIED = rf"""f as (select doc_id, text, {_LINES} as ls, string_split(text, chr(10)) as al, lower(text) as lo, {sql.strip("text")} as st from d),
 g as (select doc_id, text, length(text) as n,
 least((regexp_matches(text, '[{{}}\[\]()]')::int + regexp_matches(text, '[=<>!]+')::int + regexp_matches(text, '(?m);$')::int + regexp_matches(text, '=>|->|\|\||&&')::int + regexp_matches(text, '(?m)^\s*#include|^import |^from .+ import')::int
  + regexp_matches(text, '(?m)^\s*(public|private|protected)\s+(class|interface|enum)')::int) / 6::double * 0.7::double + least((n0 - length(translate(text, '{{}}[]()<>', ''))) / n0::double * 10, 1::double) * 0.3::double, 1::double) as syntax,
 least(coalesce(len(list_filter(ws, lambda w: w in ({_KEYWORDS}))) / nullif(len(ws), 0)::double, 0) * 10, 1::double) as keywords,
 case when len(ls) < 3 then 0 else least(len(list_filter(ls, lambda x: left(x, 1) in (' ', chr(9)))) / len(ls)::double + case when len(list_filter(ls, lambda x: (length(x) - length(ltrim(x, ' ' || chr(9)))) % 2 = 1)) = 0 then 0.3::double else 0 end, 1::double) end as indent,
 least((regexp_matches(lo, '(^|[^\p{{L}}\p{{N}}_])(the|a|an|and|or|but|in|on|at|to|for|of|with)($|[^\p{{L}}\p{{N}}_])')::int + regexp_matches(lo, '(^|[^\p{{L}}\p{{N}}_])(is|are|was|were|be|been|being)($|[^\p{{L}}\p{{N}}_])')::int) / 3::double * 0.6::double
  + case when mw between 10 and 30 then 0.5::double when mw between 5 and 40 then 0.3::double else 0 end * 0.4::double, 1::double) as prose,
 case when ((starts_with(st, '{{') and ends_with(st, '}}')) or (starts_with(st, '[') and ends_with(st, ']'))) and json_valid(st) then 1::double
  when starts_with(st, '<') and ends_with(st, '>') and len(regexp_extract_all(st, '<[^>]+>')) >= 2 then 0.9::double
  when len(list_filter(string_split(st, chr(10)), lambda x: regexp_matches(x, '^\s*[\w-]+:\s+'))) / len(string_split(st, chr(10)))::double > 0.5 then 0.8::double else 0 end as structured,
 (contains(text, '.')::int + contains(text, ',')::int + contains(text, '?')::int + contains(text, '!')::int + contains(text, ':')::int + contains(text, ';')::int) / 6::double * 0.4::double
  + least((n0 - length(translate(text, '.?!', ''))) / n0::double * 50, 1::double) * 0.6::double as punct
 from (select *, length(text) as n0, regexp_extract_all(lo, '[\p{{L}}\p{{N}}_]+') as ws,
  list_sum(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')))) / len(string_split_regex(text, '[.!?]+'))::double as mw from f)),
 s as (select doc_id, n, structured, syntax * 0.3::double + keywords * 0.25::double + indent * 0.2::double + (1 - prose) * 0.25::double as code, prose * 0.4::double + punct * 0.3::double + (1 - syntax) * 0.3::double as prose_score from g),
 k as (select doc_id, n, code, prose_score, structured, case when structured > 0.7 then 'structured_data' when code > prose_score and code >= 0.6 then 'code' when prose_score >= 0.6 then 'prose' when abs(code - prose_score) < 0.2 then 'mixed' else 'unknown' end as content_type from s)"""


@query(f"with d as ({inputs.DECORATED}), {_CLASSIFIED} select doc_id, content_type, round(code, 6) as code_score, round(prose_score, 6) as prose_score, structured as structured_score, n as char_count from k")
def classify_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.classify(inputs.decorated(spark, sf_dir))
    return found.select("doc_id", "content_type", F.round("code_score", 6).alias("code_score"), F.round("prose_score", 6).alias("prose_score"), "structured_score", _long("char_count"))


@query(f"with d as (select page_id as doc_id, html as text from pages), {_CLASSIFIED} select content_type, count(*) as pages from k group by content_type")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.classify(inputs.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))
    return found.groupBy("content_type").agg(F.count("*").alias("pages"))


# Prompts


@query(f"with d as ({inputs.DECORATED}) select doc_id, sha256({sql.prompt_normal('text')}) as hash from d")
def prompt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decorated(spark, sf_dir).select("doc_id", F.sha2(T.normalize_prompt(F.col("text")), 256).alias("hash"))


@query(f"with d as ({inputs.DECORATED}) select {sql.prompt_type('text')} as type, count(*) as prompts from d group by all")
def prompt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decorated(spark, sf_dir).groupBy(T.prompt_type(F.col("text")).alias("type")).agg(F.count("*").alias("prompts"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _conversations(spark, sf_dir).where("role = 'user'")
    return turns.select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"))


_PROMPTS = f"""n as (select conv_id, turn, concat(conv_id, '-', turn) as prompt_id, {sql.prompt_normal('text')} as content from conversations where role = 'user' and length(text) <= 2000 and length(text) > 0),
 s as (select *, {sql.prompt_type('content')} as type, length(content) + 1 as length, sha256(content) as hash, length(content) // 4 as token_estimate, row_number() over (partition by sha256(content) order by conv_id, turn) > 1 as duplicate from n where content <> '')"""


@query(f"with {_PROMPTS} select concat(prompt_id, '_seg_0') as id, prompt_id, type, content, length, hash, duplicate, token_estimate from s")
def prompt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts.process(_prompts(spark, sf_dir), ["conv_id", "turn"])
    return found.select("id", "prompt_id", "type", "content", _long("length"), "hash", "duplicate", _long("token_estimate"))


@query(f"with {_PROMPTS} select prompt_id, content, type, token_estimate, 1::bigint as segments, 'input' as direction, 'openai' as provider from s")
def prompt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = prompts.for_provider(prompts.rollup(prompts.process(_prompts(spark, sf_dir), ["conv_id", "turn"])), "openai")
    return rolled.select("prompt_id", "content", "type", "token_estimate", "segments", "direction", "provider")


@query(f"with {_PROMPTS} select count(distinct prompt_id) as processed_count, count(distinct hash) as unique_hashes, 2048::bigint as max_chars, 200::bigint as overlap from s")
def prompt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts.statistics(prompts.process(_prompts(spark, sf_dir), ["conv_id", "turn"]))
    return found.select("processed_count", "unique_hashes", _long("max_chars"), _long("overlap"))


@query("select concat('prompt_', row_number() over (order by conv_id, turn) - 1) as id, conv_id, turn from conversations")
def prompt_default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).select("conv_id", "turn", F.lit(None).cast("string").alias("id"))
    return prompts.with_ids(rows, ["conv_id", "turn"]).select("id", "conv_id", "turn")


# Responses


@query(f"""with d as ({inputs.DECORATED}), r as (select doc_id, text, {sql.response_clean('text')} as new from d)
 select doc_id, sha256(new) as hash, length(text) as original_length, length(new) as normalized_length, length(new) // 4 as token_estimate, 1 - length(new) / length(text)::double as reduction_ratio from r""")
def response_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.normalize(inputs.decorated(spark, sf_dir), "text", None)
    return found.select("doc_id", "hash", _long("original_length"), _long("normalized_length"), _long("token_estimate"), "reduction_ratio")


@query(rf"""with d as ({inputs.DECORATED}) select doc_id, contains(text, '```') as has_code, len(regexp_extract_all(text, '(?s)```(\w+)?\n(.*?)```')) as code_blocks, regexp_matches(text, '(?m)^\s*[-*+]\s') as has_lists,
 regexp_matches(text, '(?m)^#{{1,6}}\s') as has_headings, len(string_split(text, chr(10))) as line_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {sql.strip('p')} <> '')) as paragraph_count from d""")
def response_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decorated(spark, sf_dir).select("doc_id", T.content_metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("select conv_id, turn, text from conversations")
def response_model_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _conversations(spark, sf_dir).withColumn("model", F.when(F.col("turn") % 2 == 0, "Llama2-7b").otherwise("mistral-7b"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[INST] be\nbrief [/INST] "), "text", F.lit(" </s>"))).otherwise(F.concat(F.lit("<|im_start|>x<|im_end|> "), "text"))
    return marked.withColumn("raw", raw).select("conv_id", "turn", T.remove_quirks(F.col("raw"), F.col("model")).alias("text"))


_KIND = "case cast((conv_id + turn) % 4 as int) when 0 then 'openai' when 1 then 'anthropic' when 2 then 'ollama' else 'generic' end"


@query(f"select conv_id, turn, {_KIND} as provider from conversations")
def provider_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.payloads(spark, sf_dir).select("conv_id", "turn", providers.detect(F.col("raw")).alias("provider"))


@query(f"""with p as (select conv_id, turn, text, {_KIND} as provider from conversations)
 select conv_id, turn, text as content, provider, case provider when 'openai' then 'gpt-4' when 'anthropic' then 'claude-3' when 'ollama' then 'llama2' else 'unknown' end as model,
 case when provider <> 'generic' then conv_id else -1 end as prompt_tokens, case when provider <> 'generic' then turn else -1 end as completion_tokens, case when provider <> 'generic' then conv_id + turn else -1 end as total_tokens,
 case provider when 'openai' then 'stop' when 'anthropic' then 'end_turn' when 'ollama' then case when turn % 2 = 0 then 'stop' else 'length' end else 'unknown' end as finish_reason from p""")
def provider_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.payloads(spark, sf_dir).select("conv_id", "turn", providers.parse(F.col("raw")).alias("r"))
    counts = [F.coalesce(F.col(f"r.{x}"), F.lit(-1).cast("bigint")).alias(x) for x in validate.USAGE_FIELDS]
    return found.select("conv_id", "turn", "r.content", "r.provider", "r.model", *counts, "r.finish_reason")


@query(f"select conv_id, turn, sha256({sql.response_clean('text')}) as hash from conversations")
def provider_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.normalize_payloads(inputs.payloads(spark, sf_dir)).select("conv_id", "turn", "hash")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("provider"), F.lit("m").alias("model"), "text")
    return responses.normalize(rows, "text")


_TURNS = f"""t as (select conv_id, turn, role, {sql.response_clean('text')} as new from conversations), w as (select *, {sql.word_set('new')} as ws from t),
 p as (select a.conv_id, a.turn as i, b.turn as j, case when len(a.ws) = 0 or len(b.ws) = 0 then 0 else len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws))::double end as similarity from w a join w b on a.conv_id = b.conv_id and a.turn < b.turn)"""


@query(f"with {_TURNS} select *, similarity >= 0.8 as similar from p")
def response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.pairs(_turns(spark, sf_dir), "conv_id", "turn")


@query(f"""with {_TURNS}, f as (select *, row_number() over (partition by conv_id, sha256(new) order by turn) > 1 as again from t)
 select f.conv_id, count(*) as total_responses, count(*) filter (not again) as unique_responses, count(*) filter (again) as duplicate_responses, array_to_string(list_sort(list_distinct(list(role))), ',') as providers,
 min(length(new)) as min_normalized_length, max(length(new)) as max_normalized_length, round(avg(length(new)), 6) as avg_normalized_length, round(coalesce(any_value(s.a), 0), 6) as average_similarity
 from f left join (select conv_id, avg(similarity) as a from p group by conv_id) s on f.conv_id = s.conv_id group by f.conv_id""")
def response_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.compare(_turns(spark, sf_dir), "conv_id", "turn")
    return found.select("conv_id", "total_responses", "unique_responses", "duplicate_responses", F.array_join("providers", ",").alias("providers"), _long("min_normalized_length"), _long("max_normalized_length"), F.round("avg_normalized_length", 6).alias("avg_normalized_length"), F.round("average_similarity", 6).alias("average_similarity"))


@query("select conv_id, turn, case role when 'user' then 8192 when 'assistant' then 4096 else 0 end as max_context from conversations")
def provider_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = spark.createDataFrame([("user", 8192), ("assistant", 4096)], "role string, max_context int")
    return responses.with_provider_config(_conversations(spark, sf_dir), configs, "role").select("conv_id", "turn", F.coalesce("max_context", F.lit(0)).alias("max_context"))


# JSON


@query("select event_id, json_valid(props) as valid from events")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select("event_id", C.strict_json(F.col("props")).alias("valid"))


@query(f"with b as ({inputs.BROKEN}) select b.event_id, case when b.event_id % 5 in (0, 1, 3) then list_sort(json_keys(e.props)) end as keys, b.event_id % 5 in (0, 1, 3) as repaired from b join events e using (event_id)")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = inputs.broken(spark, sf_dir).withColumn("fixed", jsonx.repair(F.col("raw")))
    return fixed.select("event_id", F.array_sort(F.json_object_keys("fixed")).alias("keys"), F.col("fixed").isNotNull().alias("repaired"))


@query("""select event_id, '{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '"' || k || '":' || (props -> k)::varchar), ',') || '}' as json from events""")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select("event_id", jsonx.canonical(F.col("props")).alias("json"))


@query("select conv_id, turn, case when (conv_id + turn) % 4 < 3 then 'output' else 'input' end as direction from conversations")
def json_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.payloads(spark, sf_dir).select("conv_id", "turn", jsonx.direction(F.col("raw")).alias("direction"))


@query(r"select event_id, list_sort(json_keys(props)) as keys, true as repaired from events")
def json_repair_bare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose keys have lost their quotes."""
    raw = F.regexp_replace("props", r'"(\w+)"\s*:', "$1:")
    fixed = inputs.table(spark, sf_dir, "events").select("event_id", jsonx.repair(raw).alias("fixed"))
    return fixed.select("event_id", F.array_sort(F.json_object_keys("fixed")).alias("keys"), F.col("fixed").isNotNull().alias("repaired"))


# Full mode


@query(f"""select conv_id, turn, true as valid, {_KIND} as provider, text as content, case when {_KIND} = 'generic' then 0 else conv_id + turn end as total_tokens,
 case when {_KIND} = 'generic' then 0 else conv_id end as prompt_tokens, 0::bigint as errors from (select conv_id, turn, {sql.response_clean('text')} as text from conversations)""")
def full_mode_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.normalize_full(inputs.payloads(spark, sf_dir))
    at = lambda x: F.get_json_object("record", f"$.{x}")
    return found.select("conv_id", "turn", "valid", at("provider").alias("provider"), at("content").alias("content"), at("usage.total_tokens").cast("bigint").alias("total_tokens"), at("usage.prompt_tokens").cast("bigint").alias("prompt_tokens"), F.size("errors").cast("bigint").alias("errors"))


@query(f"""with d as ({inputs.DECORATED}), n as (select doc_id, {sql.prompt_normal('text')} as content from d)
 select doc_id, content <> '' as valid, case when content <> '' then sha256(content) end as hash, case when content <> '' then {sql.prompt_type('content')} end as type, case when content <> '' then length(content) // 4 end as token_estimate, case when content = '' then 1 else 0 end::bigint as errors from n""")
def full_mode_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.normalize_full(inputs.decorated(spark, sf_dir).select("doc_id", F.col("text").alias("raw")), kind="input")
    at = lambda x: F.get_json_object("record", f"$.{x}")
    return found.select("doc_id", "valid", F.sha2(at("content"), 256).alias("hash"), at("type").alias("type"), at("token_estimate").cast("bigint").alias("token_estimate"), F.size("errors").cast("bigint").alias("errors"))


# Blocks


def _blocks(spark: SparkSession, sf_dir: str, level: str = "high") -> DataFrame:
    return blocks.parse(inputs.decorated(spark, sf_dir), level=level)


@query()
def blocks_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.type", "b.content", "b.level", "b.language", "b.list_type", F.array_join("b.items", "|").alias("items"))


@query(f"with d as ({inputs.DECORATED}) select doc_id, (doc_id % 8 = 0)::bigint * 2 as heading, (doc_id % 8 = 1)::bigint as code_block, (doc_id % 8 = 2)::bigint as thinking, (doc_id % 8 = 0)::bigint as list from d where not regexp_matches(text, '(?m)^\\s*([-*+]|\\d+\\.)\\s') or doc_id % 8 = 0")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", *(F.col(f"statistics.{x}").cast("bigint").alias(x) for x in ("heading", "code_block", "thinking", "list")))


_NEVER = ("answer", "quote", "table", "link", "image", "instruction", "context", "example", "metadata", "system", "user")


@query(f"with d as ({inputs.DECORATED}) select doc_id, (doc_id % 8 = 0)::bigint * 2 as heading, (doc_id % 8 = 1)::bigint as code_block, (doc_id % 8 = 2)::bigint as thinking, {', '.join(f'0::bigint as {x}' for x in _NEVER)} from d")
def block_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every kind whose lines SQL can tell apart; paragraphs, lists and questions are tested by brute force."""
    found = _blocks(spark, sf_dir).select("doc_id", blocks.kind_counts(F.col("blocks")).alias("k"))
    return found.select("doc_id", *(F.col(f"k.{x}").cast("bigint").alias(x) for x in ("heading", "code_block", "thinking", *_NEVER)))


@query()
def block_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of blocks to JSON and back, and what a low fidelity leaves of them."""
    found = _blocks(spark, sf_dir, "maximum").select("doc_id", "blocks", blocks.to_document(F.col("blocks"), "low").alias("json"))
    read = found.withColumn("d", blocks.from_document(F.col("json")))
    return read.select("doc_id", F.col("d.version").alias("version"), F.col("d.fidelity").alias("fidelity"), F.size("d.blocks").cast("bigint").alias("blocks"), (F.col("d.blocks") == blocks.fidelity_filter(F.col("blocks"), "low")).alias("same"))


@query("select doc_id, doc_id % 8 = 2 as dropped from documents")
def block_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.decorated(spark, sf_dir).withColumn("b", blocks.parser()(F.col("text")))
    return found.select("doc_id", (F.size(blocks.fidelity_filter(F.col("b"), "low")) < F.size(blocks.fidelity_filter(F.col("b"), "maximum"))).alias("dropped"))


@query()
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir, "maximum").withColumn("restored", blocks.reconstruct(F.col("blocks"), "maximum"))
    return found.select("doc_id", validate.round_trip(F.col("text"), F.col("restored")).alias("r")).select("doc_id", "r.*")


@query()
def block_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir)
    kept = found.select("doc_id", blocks.of_kind(blocks.fuse(F.col("blocks"), F.col("blocks")), "heading", "list").alias("b"))
    return kept.select("doc_id", F.size("b").alias("blocks"), blocks.reconstruct(F.col("b")).alias("text"))


# Validation


@query(f"""with p as (select {_KIND} as provider, conv_id, turn from conversations)
 select provider, 7 * count(*) as total, count(*) * case provider when 'generic' then 3 else 4 end as passed from p group by provider""")
def validate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.payloads(spark, sf_dir).select(providers.parse(F.col("raw")).alias("r"))
    usage = F.struct(F.col("r.prompt_tokens").alias("prompt_tokens"), F.col("r.completion_tokens").alias("completion_tokens"), F.col("r.total_tokens").alias("total_tokens"))
    record = F.to_json(F.struct(F.col("r.provider").alias("provider"), F.col("r.model").alias("model"), usage.alias("usage")))
    checked = found.select(F.col("r.provider").alias("provider"), record.alias("record")).select("provider", validate.validate_output(F.col("record")).alias("checks"))
    return stats.validation_summary(checked, "checks", "provider").select("provider", "total", "passed")


@query(f"with {_PROMPTS} select count(*) * 5 as total, count(*) * 5 as passed, 0::bigint as errors, 0::bigint as warnings from s")
def validate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = prompts.rollup(prompts.process(_prompts(spark, sf_dir), ["conv_id", "turn"]))
    record = F.to_json(F.struct("content", "type", "token_estimate", "direction"))
    return stats.validation_summary(rolled.select(record.alias("record")).select(validate.validate_input(F.col("record")).alias("checks")))


@query(rf"""with d as ({inputs.DECORATED}), r as (select doc_id, text, {sql.response_clean('text')} as new from d),
 t as (select *, list_distinct(regexp_extract_all(lower(text), '\b[a-z0-9]{{4,}}\b')) as a, list_distinct(regexp_extract_all(lower(new), '\b[a-z0-9]{{4,}}\b')) as b, length(new) / length(text)::double as ratio from r where regexp_matches(text, '^[\x00-\x7f]*$'))
 select doc_id, new <> '' as content_preserved, case when new = '' then false when len(a) = 0 then true else len(list_intersect(a, b)) / len(a)::double >= 0.7 and ratio between 0.2 and 2 end as semantic_preserved from t""")
def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = inputs.decorated(spark, sf_dir).where(F.col("text").rlike(r"\A[\x00-\x7f]*\z"))
    found = responses.normalize(ascii_only, "text", None).select("doc_id", validate.fidelity_report(F.col("text"), F.col("normalized_content")).alias("r"))
    return found.select("doc_id", "r.content_preserved", "r.semantic_preserved")


@query()
def fidelity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = responses.normalize(inputs.decorated(spark, sf_dir), "text", None)
    return found.select("doc_id", validate.fidelity_report(F.col("text"), F.col("normalized_content")).alias("r")).select("doc_id", "r.*")


@query("select conv_id, turn, 0::bigint as errors from conversations")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.payloads(spark, sf_dir).select("conv_id", "turn", F.to_json(providers.parse(F.col("raw"))).alias("json"))
    return found.select("conv_id", "turn", F.size(validate.schema_errors(F.col("json"))).cast("bigint").alias("errors"))


@query("""select conv_id, turn, list_sort(list_filter([case when conv_id % 5 = 0 then 'content: missing' end, case when turn % 2 = 1 then 'provider: not a known provider' end, case when conv_id % 3 = 0 then 'model: empty' end,
 case when conv_id % 7 = 0 then 'usage.prompt_tokens: negative' end, case when turn % 4 = 2 then 'timestamp: not ISO-8601' end], lambda x: x is not null)) as errors from conversations""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break the schema in five ways, alone and together."""
    c, t = F.col("conv_id"), F.col("turn")
    usage = F.struct(F.when(c % 7 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(2).alias("total_tokens"))
    record = F.to_json(F.struct(
        F.when(c % 5 != 0, F.col("text")).alias("content"), F.when(t % 2 == 1, F.lit("nobody")).otherwise(F.lit("openai")).alias("provider"), F.when(c % 3 == 0, F.lit("")).otherwise(F.lit("m")).alias("model"),
        usage.alias("usage"), F.when(t % 4 == 2, F.lit("some day")).otherwise(F.lit("2024-01-02T03:04:05")).alias("timestamp"),
    ))
    found = _conversations(spark, sf_dir).select("conv_id", "turn", validate.schema_errors(record).alias("e"))
    return found.select("conv_id", "turn", F.array_sort(F.transform("e", lambda x: F.concat_ws(": ", x["field"], x["error"]))).alias("errors"))


# Statistics


_ITEMS = f"select length(text) // 4 as token_estimate, row_number() over (partition by hash order by doc_id) > 1 as duplicate from ({_HASHED})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.flag(_hashed(spark, sf_dir).where("hash is not null").select("doc_id", "hash", T.token_estimate(F.col("text")).alias("token_estimate")), ["doc_id"])
    return found.select("token_estimate", "duplicate")


@query(f"""with i as ({_ITEMS}), s as (select count(*) as items, count(*) filter (not duplicate) as unique_items, sum(token_estimate)::bigint as tokens, (sum(token_estimate) filter (not duplicate))::bigint as unique_tokens from i)
 select items, unique_items, tokens, unique_tokens, round(tokens / 1000::double * 0.03 + items * 100 / 1000::double * 0.06, 6) as cost, round(unique_tokens / 1000::double * 0.03 + unique_items * 100 / 1000::double * 0.06, 6) as unique_cost from s""")
def token_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.token_cost(_items(spark, sf_dir))
    return found.select("items", "unique_items", "tokens", "unique_tokens", F.round("cost", 6).alias("cost"), F.round("unique_cost", 6).alias("unique_cost"))


@query(f"""with i as ({_ITEMS}), s as (select sum(token_estimate)::bigint as tokens, (sum(token_estimate) filter (not duplicate))::bigint as unique_tokens from i)
 select tokens, unique_tokens, round(tokens / 1000::double * 0.0001, 6) as cost, round(unique_tokens / 1000::double * 0.0001, 6) as unique_cost from s""")
def embedding_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.embedding_cost(_items(spark, sf_dir))
    return found.select("tokens", "unique_tokens", F.round("cost", 6).alias("cost"), F.round("unique_cost", 6).alias("unique_cost"))


@query("select lang, sum(strlen(text))::bigint as text_bytes, sum(strlen(json_object('doc_id', doc_id, 'text', text)::varchar))::bigint as json_bytes from documents group by lang")
def storage_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    json = F.octet_length(F.to_json(F.struct("doc_id", "text")))
    return docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("text_bytes"), F.sum(json).alias("json_bytes"))


@query(rf"""with {sql.sentences()}, l as (select 'line' as granularity, {sql.strip("unnest(string_split(text, chr(10)))")} as piece from documents union all select 'segment', text from sentences
 union all select 'block', unnest(string_split_regex(text, '\n\s*\n')) from documents) select granularity, count(*) as total, count(distinct piece) as "unique", round((count(*) - count(distinct piece)) / count(*)::double, 6) as dedup_rate from l where {sql.strip('piece')} <> '' group by granularity""")
def dedup_rate_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dedup_rates(_docs(spark, sf_dir)).withColumn("dedup_rate", F.round("dedup_rate", 6))


@query(r"select count(*) as files_processed, sum(length(text))::bigint as total_characters, sum(len(string_split(text, chr(10))) - (text = '' or ends_with(text, chr(10)))::int)::bigint as total_lines from documents")
def input_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.input_statistics(_docs(spark, sf_dir))


@query()
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.flag(dedup.hashed(segment.segment(inputs.decorated(spark, sf_dir))), ["doc_id", "seg_idx"])
    return stats.run_statistics(C.classify(found))


@query("select lang, quality, count(*) as docs, sum(length(text))::bigint as chars from documents join labels using (doc_id) group by all")
def label_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.length("text").alias("n"))
    return docs.join(inputs.table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


@query("select doc_id, text from documents order by doc_id limit 50")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").limit(50)


# Streams


@query()
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.buffered_batch(spark, f"{sf_dir}/conversations.parquet")


@query("select min(event_id) as event_id, user_id, event_type from events group by user_id, event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.dedup_batch(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"], order=["event_id"]).select("user_id", "event_type", "event_id")
