"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabsight.llm import decontaminate, heapmeans, langid, linededup, lmscore, multiset, pii, quality, sentencepieces, shards, simhash, turns, urlfilter

#: The tokenizer's model; a parameter of the operator.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), least=1)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.hilbert_shards(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heapmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.digest(multiset.compare_with_edits(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sanitise": op1_sanitise,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepieces": op5_sentencepieces,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_simhash": op10_simhash,
    "op11_heap_clusters": op11_heap_clusters,
    "op12_multiset_fingerprints": op12_multiset_fingerprints,
    "op13_conversation_repair": op13_conversation_repair,
}

_Q = quality
_VISIBLE = rf"len(regexp_replace({{0}}, '{_Q.BLANKS}', '', 'g'))"
_LINE_FAILS = (
    f"(regexp_matches(line, '{_Q.NOTICE}') OR regexp_matches(line, '{_Q.MENU}') OR regexp_matches(line, '{_Q.BARS}') "
    f"OR 2 * len(regexp_replace(line, '{_Q.PLAIN}', '', 'g')) >= {_VISIBLE.format('line')})"
)

ORACLES: dict[str, str] = {
    "op4_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    t AS (SELECT *, list_filter(regexp_split_to_array(text, '{_Q.BLANKS}'), lambda w: w <> '') AS words FROM d),
    w AS (SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
    c AS (SELECT id, i FROM w QUALIFY count(*) OVER (PARTITION BY id, gram) > 1),
    p AS (SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY id),
    l AS (SELECT id, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_Q.WORD}')),
    k AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER ({_LINE_FAILS}) AS n_failed_lines, coalesce(sum({_VISIBLE.format('line')}) FILTER ({_LINE_FAILS}), 0) AS lost FROM l GROUP BY id),
    m AS (SELECT doc_id, len(words) AS n_words, {_VISIBLE.format('text')} AS word_chars, len(regexp_replace(text, '{_Q.SYMBOLS}', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost, 0) AS lost FROM t LEFT JOIN p USING (id) LEFT JOIN k USING (id)),
    b AS (SELECT *, n_words < {_Q.LEAST_WORDS} OR 100 * n_repeat_words > {_Q.MOST_REPEATED} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {_Q.MOST_LOST} * word_chars AS kept, n_failed_lines FROM b""",
}
