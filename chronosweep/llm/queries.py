"""The operators as registered queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronosweep.llm import bpe, chat, codebooks, decontaminate, embeddings, fim, language, quality, secrets, sharding, simhash, suffixes, token_counts
from chronosweep.llm.common import table

#: The conversation whose texts are made of control strings.
CONFLICT = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(more)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.fit_quality(documents, table(spark, sf_dir, "labels")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.predict_languages(documents, language.fit_languages(documents))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest_fim(table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_embedding_near_dedup, op3_token_counts, op4_simhash_near_dedup, op5_secret_scans, op6_sharding, op7_byte_bpe, op8_quality_classifier, op9_benchmark_decontamination, op10_language_id, op11_fill_in_middle, op12_suffix_array_dedup, op13_vector_codes)}

_STUFFED = r"regexp_replace(coalesce({0}, ''), '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')"

OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
-- a conversation is stuffed where its raw rendering has other control strings than the template's own in their order, or a text looks stuffed already
raw AS (SELECT conv_id, regexp_extract_all(string_agg('<s>[INST]' || role || '[/INST]' || text || '</s>', '' ORDER BY turn NULLS FIRST, role, text), '<s>|</s>|\\[INST\\]|\\[/INST\\]') AS marks, count(*) AS n, bool_or(regexp_matches(role || chr(10) || text, '[<\\[]\\\\+/?(?:s>|INST\\])')) AS told FROM turns GROUP BY conv_id),
stuffed AS (SELECT conv_id, marks <> list_transform(range(0, 4 * n), lambda k: ['<s>', '[INST]', '[/INST]', '</s>'][k % 4 + 1]) OR told AS yes FROM raw)
SELECT turns.conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + CASE WHEN yes THEN length({_STUFFED.format("role")}) + length({_STUFFED.format("text")}) ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM turns JOIN stuffed ON stuffed.conv_id IS NOT DISTINCT FROM turns.conv_id GROUP BY turns.conv_id
"""

OP9_SQL = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 4) AS s
  FROM item_words, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
-- shingles of five words, and of as few as there are items of
widths AS (SELECT DISTINCT len(s) AS k FROM item_shingles),
doc_shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + k - 1) AS s
  FROM doc_words, widths, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
found AS (
  SELECT d.doc_id, i.item_id, count(*) AS k
  FROM item_shingles i JOIN doc_shingles d ON i.s = d.s GROUP BY d.doc_id, i.item_id)
SELECT doc_id, found.item_id AS item_id, n AS n_shingles, k AS n_found, k / n AS containment
FROM found JOIN sizes USING (item_id) WHERE k >= 0.8 * n
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(g, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS UBIGINT) AS h2,
  CAST('0x' || substr(g, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_slice(w, 1, lo), '') AS pre, array_to_string(list_slice(w, lo + 1, hi), '') AS mid, array_to_string(list_slice(w, hi + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM d, unnest(range(0, len(x) // 2 - 49)) AS u(p)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, p FROM w JOIN m USING (s) WHERE least < doc_id),
i AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM i),
v AS (SELECT r, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY r, k),
e AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS z FROM v),
t AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY k) AS kept FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.r IS NULL THEN x ELSE kept || substr(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

ORACLES = {"op1_chat_formatting": OP1_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_suffix_array_dedup": OP12_SQL}
