"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, interaction, licenses, mainhtml, mixing, periodic, quality, rules, simhash, suffix, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failures").bitwiseAND(F.lit(rules.policy_mask(rules.POLICIES["base-v1"]))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy drops, alone and with the others."""
    return rules.ablation(rules.ledger(_table(spark, sf_dir, "documents")))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.swapped_pairs(_table(spark, sf_dir, "conversations")))


def op11_main_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.mask_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS k FROM win),
pos AS (
  SELECT rid, s, list_slice(w, s, s + k - 1) AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)
), hits AS (
  SELECT rid, s, len(win.win) AS k, item_id FROM pos JOIN win ON pos.win = win.win
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM w) WHERE r > 1
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit)
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), tri AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), tok AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM tri
), twice AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tok
), hit AS (
  SELECT rid, count(DISTINCT i + d) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) v(d) WHERE k > 1 GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN hit USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""


def ablation_sql() -> str:
    """Failures, sole failures and rows kept with and without each rule, from the rows of ``OP7_SQL``."""
    each = [
        f"SELECT '{r.name}' AS rule, count(*) FILTER (failures & {1 << r.bit} <> 0) AS n_failed, count(*) FILTER (failures = {1 << r.bit}) AS n_failed_alone, "
        f"count(*) FILTER (failures = 0) AS n_kept_with, count(*) FILTER (failures IN (0, {1 << r.bit})) AS n_kept_without FROM f"
        for r in rules.RULES
    ]
    return OP7_SQL[: OP7_SQL.rindex("SELECT doc_id, n_words")] + " UNION ALL ".join(each)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontamination": op3_decontamination,
        "op4_url_filter": op4_url_filter,
        "op5_source_mix": op5_source_mix,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality_rules": op7_quality_rules,
        "quality_rule_ablation": quality_rule_ablation,
        "op8_warc_archive": op8_warc_archive,
        "op9_simhash": op9_simhash,
        "op10_preference_pairs": op10_preference_pairs,
        "op11_main_html": op11_main_html,
        "op12_filter_interaction": op12_filter_interaction,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op3_decontamination": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "quality_rule_ablation": ablation_sql(), "op8_warc_archive": OP8_SQL, "op10_preference_pairs": chat.SQL, "op11_main_html": mainhtml.SQL, "op12_filter_interaction": interaction.SQL, "op13_periodic_runs": periodic.SQL}
