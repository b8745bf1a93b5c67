"""One query for each operator, over whole tables and with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, license_scan, near_dedup, packing, quality_rules, suffix_dedup, toxicity, url_filter, warc
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Verdict, host and path of each rule.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat_format.raw_turns(table(spark, sf_dir, "conversations"))
    held_out = chat_format.held_out(F.col("conv_id"))
    bits = chat_format.line_bits(raw)
    out = chat_format.format_chats(chat_format.transcripts(raw, bits), chat_format.learn(raw.where(~held_out)))
    place = F.floor(F.col("turn") / (1 << bits)).alias("turn"), F.pmod("turn", F.lit(1 << bits)).alias("line")
    return out.select("conv_id", *place, held_out.alias("held_out"), "role", "n_turns", "continues", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_decontamination, op4_suffix_dedup, op5_url_filter, op6_toxicity, op7_packing, op8_license_scan, op9_near_dedup, op10_warc)}

ORACLE_SQL = {
    "op3_decontamination": r"""
        WITH items AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
        item_shingles AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items),
        docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        doc_shingles AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM docs, (SELECT DISTINCT k FROM items)),
        n AS (SELECT item_id, k, count(*) AS n FROM item_shingles GROUP BY item_id, k)
        SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared
        FROM doc_shingles JOIN item_shingles USING (k, s) JOIN n USING (item_id, k)
        GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
    "op5_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT page_id, host, path, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_warc": r"""
        WITH h AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS response, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM h)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(hex, (1 + 5 * i)::BIGINT, 5))::BIGINT), lambda v:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1)
                || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> response THEN response END AS refers_to,
            CASE WHEN rest IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS url_key,
            strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM d""",
}
