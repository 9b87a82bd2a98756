"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import (
    bpe, decontamination, jaccard_join, language_id, manifest, periodic_runs, personal_data, quality_rules, sharding,
    suffix_dedup, toxicity, unigram_counts, urls,
)
from tickloom.llm.session import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: So many that a table is merged into a greater one, and that the last batch meets tables of two sizes.
SUFFIX_BATCHES = 4

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(table(spark, sf_dir, "documents"), batches=SUFFIX_BATCHES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digest(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.documents_manifest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_filter, op2_jaccard_join, op3_sharding, op4_bpe, op5_token_counts, op6_personal_data, op7_suffix_dedup, op8_quality_rules,
    op9_decontamination, op10_language_id, op11_manifest, op12_periodic_runs, op13_toxicity)}
QUERIES["pipeline"] = corpus_pipeline.run
#: crc32 of a short ASCII text, one bit at a time: a byte is xor-ed in, then the polynomial divides eight times.
CRC32_SQL = """CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
  range(1, length({0}) + 1), lambda k: list_prepend(CAST(ascii(substr({0}, k, 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS BIGINT)"""


def _tree_sql(name: str, nodes: str) -> str:
    """All levels (grp, level, slot, h) of the trees whose leaves `nodes` (grp, slot, h) has, and each leaf's siblings."""
    return f"""
{name} AS (
  SELECT grp, 0 AS level, slot, h FROM {nodes}
  UNION ALL
  SELECT grp, level + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY grp, level, slot // 2
),
{name}_steps AS (
  SELECT a.grp, a.slot, b.level,
         CASE WHEN s.h IS NULL THEN '=' WHEN (a.slot >> b.level) % 2 = 1 THEN '<' || s.h ELSE '>' || s.h END AS step
  FROM {nodes} a
  JOIN (SELECT grp, level FROM {name} GROUP BY 1, 2 HAVING count(*) > 1) b ON a.grp = b.grp
  LEFT JOIN {name} s ON s.grp = a.grp AND s.level = b.level AND s.slot = xor(a.slot >> b.level, 1)
)"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (
        "doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql("n_chars")} AS h,
         CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS now
  FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS slot FROM rows_),
{_tree_sql("tree", "leaves")},
subroots AS (
  SELECT '' AS grp, name, h, row_number() OVER (ORDER BY encode(name)) - 1 AS slot
  FROM (SELECT grp AS name, arg_max(h, level) AS h FROM tree GROUP BY grp)
),
{_tree_sql("top", "subroots")},
root AS (SELECT arg_max(h, level) AS root FROM top),
steps AS (
  SELECT grp, slot, list(step ORDER BY level) AS steps FROM tree_steps GROUP BY grp, slot
),
upper_steps AS (
  SELECT g.name, list(t.step ORDER BY t.level) AS steps FROM subroots g JOIN top_steps t ON t.slot = g.slot GROUP BY g.name
),
folded AS (
  SELECT l.doc_id, l.h AS leaf, coalesce(l.now, l.h) AS now, g.h AS subroot, r.root,
         list_concat(coalesce(s.steps, []), coalesce(u.steps, [])) AS steps
  FROM leaves l JOIN subroots g ON g.name = l.grp CROSS JOIN root r
  LEFT JOIN steps s ON s.grp = l.grp AND s.slot = l.slot LEFT JOIN upper_steps u ON u.name = l.grp
),
results AS (
  SELECT *, list_reduce(list_prepend(now, steps), lambda a, x: sha256(
    CASE x[1] WHEN '<' THEN x[2:] || a WHEN '>' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM folded
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM results"""

QUALITY_SQL = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
         list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(
           regexp_replace(lower(x), '[0-9]', '0', 'g'), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')) AS lines
  FROM documents
),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM rows_ WHERE len(words) > 7)
),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(8)) AS k) GROUP BY rid),
held AS (SELECT rid, doc_id, source, unnest(lines) AS line FROM rows_),
frequent AS (
  SELECT h.source, h.line FROM held h JOIN (SELECT source, count(DISTINCT doc_id) AS n FROM rows_ GROUP BY 1) s
    ON s.source IS NOT DISTINCT FROM h.source
  GROUP BY h.source, h.line, s.n HAVING count(DISTINCT h.doc_id) > 40 AND count(DISTINCT h.doc_id) > CAST(0.002 AS DOUBLE) * s.n
),
removed AS (
  SELECT h.rid, CAST(sum(length(h.line)) AS BIGINT) AS n FROM held h JOIN frequent f
    ON f.source IS NOT DISTINCT FROM h.source AND f.line = h.line GROUP BY h.rid
),
counted AS (
  SELECT r.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         CAST(length(array_to_string(lines, '')) AS BIGINT) AS line_chars, coalesce(d.n, 0) AS removed_chars
  FROM rows_ r LEFT JOIN covered c USING (rid) LEFT JOIN removed d USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, line_chars, removed_chars,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND line_chars - removed_chars >= CAST(0.3 AS DOUBLE) * line_chars AS kept
FROM counted"""

SQL: dict[str, str] = {"op8_quality_rules": QUALITY_SQL, "op11_manifest": MANIFEST_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
