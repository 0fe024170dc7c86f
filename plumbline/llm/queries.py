"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, lm_score, packing, quality, secrets, simhash, suffix_dedup, toxicity, warc
from plumbline.llm.common import joined_splits, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a word is folded once in each task that meets it
    found = bpe.encode(joined_splits(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)
    return found.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "lines_removed", "bytes_removed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        secrets.labelled("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_examples"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs)).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return found.select(
        F.col("id").alias("page_id"), "response_id", "target_uri", "title", "n_links", "source_digest", "digest_ok",
        "metadata_id", "metadata_digest", "conversion_id", "conversion_digest",
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.sha2("text", 256).alias("text_sha256"), F.sha2("metadata_record", 256).alias("metadata_record_sha256"),
        F.sha2("conversion_record", 256).alias("conversion_record_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_quality_rules, op4_toxicity, op5_simhash, op6_secret_scan, op7_lm_score, op8_exact_dedup, op9_packing, op10_warc_derivatives)
}

def _quality_sql(rules: quality.LineRules = quality.LineRules()) -> str:
    """The line rules and word statistics in SQL; a run of menu entries is an island of short lines without marks."""
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    quoted = quality.NOTICE.replace("'", "''")
    count = "len(list_filter(ws, lambda x: {}))"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, {words.format('t')} AS ws FROM d),
        spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
        grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM spots),
        again AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS k) o WHERE n > 1 GROUP BY doc_id),
        split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM d),
        lines AS (SELECT * FROM (SELECT doc_id, line, line_no, {words.format('line')} AS ws FROM split) s WHERE len(ws) > 0),
        menu AS (SELECT *, len(ws) <= {rules.max_entry_words} AND NOT regexp_matches(line, '[{quality.MARKS}]') AS entry,
            row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM lines),
        islands AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, entry ORDER BY line_no) AS island FROM menu),
        judged AS (SELECT doc_id, line, list_sum(list_transform(ws, lambda x: strlen(x))) AS size,
            (entry AND count(*) OVER (PARTITION BY doc_id, entry, island) > {rules.max_entries})
            OR {count.format(f"x IN ({', '.join(repr(x) for x in quality.SEPARATORS)})")} > {rules.max_bars} * len(ws)
            OR {count.format("regexp_matches(x, '[#*$%&<>]')")} > {rules.max_symbol_words} * len(ws)
            OR {count.format("regexp_matches(x, '[!?][!?]$')")} > {rules.max_shouted} * len(ws)
            OR (len(ws) <= {rules.max_teaser_words} AND regexp_matches(ws[len(ws)], '(?:\.\.\.|…|\[…\])$'))
            OR (len(ws) <= {rules.max_boilerplate_words} AND regexp_matches(lower(line), '{quoted}')) AS fails FROM islands),
        sums AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count_if(fails) AS lines_removed,
            sum(CASE WHEN fails THEN size ELSE 0 END) AS bytes_removed, sum(size) AS total FROM judged GROUP BY doc_id),
        base AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lines_removed, 0) AS lines_removed, coalesce(bytes_removed, 0) AS bytes_removed,
            coalesce(total, 0) AS total FROM w LEFT JOIN again ON again.doc_id = w.doc_id LEFT JOIN sums ON sums.doc_id = w.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
            n_words < {rules.min_words} OR n_repeat_words > {rules.max_repeat} * n_words AS base_failed,
            NOT (n_words < {rules.min_words} OR n_repeat_words > {rules.max_repeat} * n_words) AND bytes_removed <= {rules.max_lost} * total AS kept,
            CAST(lines_removed AS BIGINT) AS lines_removed, CAST(bytes_removed AS BIGINT) AS bytes_removed FROM base"""


ORACLE_SQL: dict[str, str] = {
    # strings by their digests; runs of overlapping or touching strings; what lies between the runs
    "op2_suffix_dedup": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
        starts AS (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400),
        digests AS (SELECT r, i, md5(b[i:i + 399]) AS m FROM starts),
        again AS (SELECT m FROM digests GROUP BY m HAVING count(*) > 1),
        hits AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM digests JOIN again USING (m)),
        runs AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
        spans AS (SELECT r, run, min(i) AS first, max(i) + 400 AS past FROM runs GROUP BY r, run),
        gaps AS (SELECT r, first, past, coalesce(lag(past) OVER (PARTITION BY r ORDER BY first), 1) AS opens FROM spans),
        kept AS (SELECT g.r, count(*) AS n_spans, sum(past - first) AS n_removed, max(past) AS last, string_agg(hex(b[opens:first - 1]), '' ORDER BY first) AS left_hex
            FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r)
        SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(from_hex(left_hex || hex(b[last:]))) END AS kept_sha256
        FROM d LEFT JOIN kept ON kept.r = d.r""",
    "op3_quality_rules": _quality_sql(),
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
               h AS text_sha256
        FROM d""",
}
