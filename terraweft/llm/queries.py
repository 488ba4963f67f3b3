"""Queries of the operators over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraweft.llm import credentials, divergence, exact, language, licenses, mixing, near, packing, personal, quality, repeats, search, spelling

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), percent=85)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir), with_text=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_secrets(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan_personal(documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(documents(spark, sf_dir))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_mix_sources, op3_exact_dedup, op4_language_id, op5_quality_rules, op6_secret_scan, op7_license_scan, op8_personal_data, op9_repeated_passages, op10_best_fit_packing, op11_source_divergence, op12_exact_top_k, op13_spelling_variants)}

TWINS: dict[str, str] = {}

TWINS["op2_mix_sources"] = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
numbered AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM sizes GROUP BY source),
weighted AS (SELECT *, (sid - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM numbered),
summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS caps_before, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weights_before
  FROM weighted WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (
  SELECT *, CAST(cap AS DOUBLE) / weight <= CAST(total - caps_before AS DOUBLE) / (weights - weights_before) AS stops FROM summed),
aimed AS (
  SELECT *, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
    CAST(total - coalesce(CAST(sum(CASE WHEN stops THEN cap END) OVER () AS BIGINT), 0) AS DOUBLE) * weight
      / CAST(sum(CASE WHEN NOT stops THEN weight END) OVER () AS BIGINT) END AS target FROM stopped),
sources AS (
  SELECT *, CAST(sum(CAST(round(target) AS BIGINT)) OVER (ORDER BY sid) AS BIGINT) AS high FROM aimed),
scale AS (SELECT max(high) AS words, greatest(1, least({mixing.LARGEST_BLOCK}, max(high) // {mixing.SLOTS})) AS block FROM sources),
points AS (
  SELECT slot, (slot >> 20) * CAST({mixing.STEP_HIGH!r} AS DOUBLE) + (slot % 1048576) * CAST({mixing.STEP!r} AS DOUBLE) AS turn
  FROM (SELECT unnest(range(CAST((words + block - 1) // block AS BIGINT))) AS slot FROM scale)),
slots AS (
  SELECT slot, sid, CAST(ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT) AS n_blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM points, scale, sources
  WHERE floor((turn - floor(turn)) * CAST(words AS DOUBLE)) >= high - CAST(round(target) AS BIGINT) AND floor((turn - floor(turn)) * CAST(words AS DOUBLE)) < high),
uses AS (SELECT sid, rank % n_blocks AS block_no, count(*) AS uses FROM slots WHERE rank < 3 * n_blocks GROUP BY 1, 2),
placed AS (
  SELECT doc_id, size, sid, source_size, target, row_number() OVER () AS row_no,
         CAST(coalesce(sum(size) OVER (PARTITION BY sid ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source),
cut AS (
  SELECT row_no, p.sid, a, a + size AS z, block, unnest(range(a // block, (a + size - 1) // block + 1)) AS block_no FROM placed AS p, scale WHERE size > 0),
given AS (
  SELECT row_no, sum((least(z, (cut.block_no + 1) * block) - greatest(a, cut.block_no * block)) * coalesce(uses, 0)) AS taken
  FROM cut LEFT JOIN uses ON cut.sid = uses.sid AND cut.block_no = uses.block_no GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN given USING (row_no)
"""

TWINS["op3_exact_dedup"] = """
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM bodies)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

# every character that is none of a word is doubled, so that phrases beside each other both have a boundary of their own
NO_WORD = "[^0-9A-Za-z_\\x{80}-\\x{10FFFF}]"
PHRASES = f"(?i){NO_WORD}({quality.BOILERPLATE.replace(' ', '  ')}){NO_WORD}"
TWINS["op5_quality_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (
  SELECT r, i, CAST(list_slice(w, i, i + 7) AS VARCHAR[]) AS win FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i FROM worded WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
split_lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT r, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         length(line) - length(regexp_replace(line, '[#*$%&<>{{}}~^=_\\x5C]', '', 'g')) AS marks, length(line) - length(replace(line, '|', '')) AS seps,
         CASE WHEN regexp_matches(line, '(?i){quality.BOILERPLATE}') THEN list_sum(list_transform(regexp_extract_all('  ' || regexp_replace(line, '({NO_WORD})', '\\1\\1', 'g') || '  ', '{PHRASES}', 1), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2 + 1)) END AS told
  FROM split_lines),
judged AS (
  SELECT r, line, len(lw) AS n, chars, len(lw) > 0 AND (10 * marks > chars OR (seps >= 3 AND 6 * seps >= len(lw))
    OR 3 * len(list_filter(lw, lambda x: ends_with(x, '!!'))) >= 2 * len(lw) OR (coalesce(told, 0) > 0 AND (len(lw) <= {quality.SHORT_LINE} OR {quality.PHRASE_SHARE} * told >= len(lw)))) AS fails FROM lines),
summed AS (
  SELECT r, CAST(sum(chars) AS BIGINT) AS word_chars, CAST(sum(CASE WHEN fails THEN chars ELSE 0 END) AS BIGINT) AS lost_chars,
         count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM judged GROUP BY 1),
joined AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, lost_chars
  FROM worded JOIN summed USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept FROM joined
"""

TWINS["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) + count(*) AS size FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(own.n, 0) AS HUGEINT) AS n, k.total
  FROM groups AS g JOIN kept AS k ON g.lang = k.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
sized AS (SELECT lang, source, sum(n) + count(*) AS size FROM dense GROUP BY ALL),
shares AS (
  SELECT d.lang, d.source, term, n, 1 + 1000000000 * (n + 1) // s.size AS p, 1 + 1000000000 * (total + 1) // l.size AS q
  FROM dense AS d JOIN sized AS s ON d.lang = s.lang AND d.source = s.source JOIN langs AS l ON d.lang = l.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

TWINS["op12_exact_top_k"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS score
  FROM vectors AS q JOIN vectors AS c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
