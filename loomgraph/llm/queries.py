"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, extract, jaccard, lexical, licenses, lm, mixing, neardup, periodic, quality, substrings, toxicity
from .session import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(turns))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


#: The template's marks: see chat.py. A conversation is escaped where a text holds a mark.
CHAT_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (select *, regexp_matches(text, '\[INST |\[/INST\]|<s>|<s escaped>|</s>') as clash,
  replace(replace(replace(text, '\', '\b'), '[', '\o'), '<', '\l') as shown,
  length(replace(replace(replace(replace(role, '\', '\b'), '[', '\o'), '<', '\l'), ']', '\c')) as role_chars from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (case when bool_or(clash) then 11 + sum(length(shown)) else 3 + sum(length(text)) end + sum(role_chars + 18))::bigint as formatted_chars,
  bool_or(clash) as escaped
from marked group by conv_id
"""


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"
SEARCH_SQL = f"""
with tf as (select doc_id, term, count(*) as tf from (select doc_id, {_TERMS} from documents) group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by all),
total as (select count(*) as docs, sum(n)::bigint as terms from n),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by all) cross join total),
asked as (select item_id, term, count(*) as times from (select item_id, {_TERMS} from benchmark) group by all),
scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::bigint as score
  from asked join w using (term) join tf using (term) join n using (doc_id) cross join total group by all)
select * from (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0) where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": CHAT_SQL, "op13_ranked_search": SEARCH_SQL}
