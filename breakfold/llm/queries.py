"""The registered queries of the training-data operators and their SQL.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact, html, neardup, packing, quality, sharding, substring
from .common import table

#: Tools that the derived calls use.
SCHEMAS = {
    "search": {
        "properties": {
            "query": {"type": "string"},
            "limit": {"type": ["integer", "null"], "maximum": 4},
            "filter": {"type": "object", "properties": {"fields": {"type": "array", "items": {"enum": ["title", "text"]}}, "strict": {"type": "boolean"}}, "required": ["strict"], "additionalProperties": False},
        },
        "required": ["query"],
        "additionalProperties": False,
    }
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """All messages of the conversations, a call after each of the user's and a result for each of the assistant's.

    The conversations hold no tool calls, so these are derived: a user's turn searches for itself by place and length, and the
    search of the turn before has found an assistant's turn, by its text's digest.  Results stand before their calls.
    """
    t, at = F.col("turn"), (F.col("turn") * 4).cast("long")
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    row = lambda turn, role, text: F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"))
    words = F.coalesce("text", F.lit(""))
    query = F.concat(F.lit('turn "'), t.cast("string"), F.lit('" of '), F.col("conv_id").cast("string"), F.lit(": "), F.length(words).cast("string"))
    wanted = F.struct(query.alias("query"), t.alias("limit"), F.struct((t > 0).alias("strict"), F.array(F.lit("title"), F.lit("text")).alias("fields")).alias("filter"))
    call = row(at + 1, F.lit("assistant"), F.to_json(F.struct(name(t).alias("tool_call_id"), F.lit("search").alias("name"), wanted.alias("arguments"))))
    result = row(at - 4, F.lit("tool"), F.to_json(F.struct(name(t - 1).alias("tool_call_id"), F.md5(words).alias("content"))))
    # One reading of the table gives all three kinds.
    rows = F.array(row(at, F.col("role"), F.col("text")), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result))
    return conversations.select("conv_id", F.explode(rows).alias("row")).where("row is not null").select("conv_id", "row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.ingest(table(spark, sf_dir, "documents"), substring.Index(spark))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(with_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_sample(docs, table(spark, sf_dir, "labels"), "quality", held_out=quality.quarter_held_out)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.quarter_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_nearest": op2_nearest,
        "op3_bpe": op3_bpe,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_shards": op5_shards,
        "op6_html_text": op6_html_text,
        "op7_chat_format": op7_chat_format,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_quality": op9_quality,
        "op10_packing": op10_packing,
    }


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            with d as (select doc_id, length(coalesce(text, '')) as n, translate(coalesce(text, ''), {_BLANKS}, '') as norm from documents),
            r as (select *, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r""",
        "op4_substring_dedup": r"""
            with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
            i as (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50),
            win as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as h from i),
            f as (select h, min(doc_id) as m from win group by h),
            gone as (select distinct doc_id, unnest(range(s, s + 50)) as p from win join f using (h) where m < doc_id),
            words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
            kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
            select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from d left join kept k using (doc_id)""",
        "op8_near_duplicates": r"""
            with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
            i as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as s from d where len(w) > 0),
            sh as (select distinct doc_id, array_to_string(w[s:s + 2], ' ') as h from i),
            n as (select doc_id, count(*) as n from sh group by doc_id),
            c as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.h = b.h and a.doc_id < b.doc_id group by all),
            l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
            e as (select a, b from l union all select b, a from l),
            r(id, root) as (select doc_id, doc_id from d union select e.b, r.root from r join e on e.a = r.id),
            m as (select id, min(root) as component_id from r group by id)
            select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d left join n using (doc_id) join m on m.id = d.doc_id""",
        "op7_chat_format": """
            with c as (select conv_id, turn as t, turn * 4 as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
            calls as (select *, turn + 1 as own, 'c' || t as id from c where role = 'user'),
            first_call as (select conv_id, id, min(own) as call_turn from calls group by all),
            results as (select conv_id, turn - 4 as turn, 'c' || (t - 1) as id, '{"tool_call_id":"c' || (t - 1) || '","content":"' || md5(text) || '"}' as text from c where role = 'assistant'),
            answered as (select distinct conv_id, id from results),
            m as (
                select conv_id, turn, role, 'text' as kind, null::varchar as tool_call_id, false as linked, turn as order_turn, 0 as order_rank, '' as errors,
                       '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' as message from c
                union all
                select conv_id, own, 'assistant', 'call', id, a.id is not null, own, 0, case when t > 4 then 'bad limit' else '' end,
                       '{"arguments":{"filter":{"fields":["title","text"],"strict":' || (t > 0)::varchar || '},"limit":' || t || ',"query":"turn \\"' || t || '\\" of ' || conv_id || ': ' || length(text) || '"},"name":"search","role":"assistant","tool_call_id":"' || id || '"}'
                from calls left join answered a using (conv_id, id)
                union all
                select conv_id, turn, 'tool', 'result', id, call_turn is not null, coalesce(call_turn, turn), (call_turn is not null)::int, case when call_turn is null then 'no call' else '' end,
                       '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || id || '"}' from results left join first_call using (conv_id, id))
            select conv_id, row_number() over (partition by conv_id order by order_turn, order_rank, turn, message) - 1 as position, turn, role, kind, tool_call_id, linked, order_turn, order_rank, errors = '' as valid, errors, message
            from m""",
    }
