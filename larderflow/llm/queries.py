"""The subpackage's queries and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm import exact_dedup, fingerprints, language_id, license_scan, line_dedup, mixing, packing, quality, sharding, simhash


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def lines_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    out = line_dedup.dedup_lines(docs, removed="removed_lines")
    return out.select("doc_id", "n_lines", "removed_lines", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.training_fold(docs))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (language_id.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs, model)
    return out.select("doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda spark, d: packing.pack_documents(documents(spark, d)),
        "op2_quality": qualities,
        "op3_exact_dedup": lambda spark, d: exact_dedup.dedup(documents(spark, d)),
        "op4_fingerprints": lambda spark, d: fingerprints.fingerprint(documents(spark, d)),
        "op5_sharding": lambda spark, d: sharding.shard(documents(spark, d)),
        "op6_simhash": near_duplicates,
        "op7_line_dedup": lines_deduped,
        "op8_language_id": languages,
        "op9_mixing": lambda spark, d: mixing.mix(documents(spark, d)),
        "op10_license_scan": lambda spark, d: license_scan.scan(documents(spark, d)),
    }


EXACT_DEDUP = """
WITH r AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM r WINDOW g AS (PARTITION BY text_sha256)
"""

MIXING = """
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5('5:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM r GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / w, source IS NULL, source) AS n FROM s
), fill AS (
  SELECT 0::BIGINT AS n, (SELECT sum(source_size) FROM s)::BIGINT AS rest, (SELECT sum(w) FROM s)::BIGINT AS wleft, NULL::DOUBLE AS level
  UNION ALL
  SELECT f.n + 1, (f.rest - c.cap)::BIGINT, (f.wleft - c.w)::BIGINT,
         CASE WHEN f.level IS NOT NULL THEN f.level WHEN c.cap::DOUBLE / c.w > f.rest::DOUBLE / f.wleft THEN f.rest::DOUBLE / f.wleft END
  FROM fill f JOIN c ON c.n = f.n + 1
), t AS (
  SELECT c.source, source_size, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE f.level * w END AS target
  FROM c JOIN fill f ON f.n = c.n
), p AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, round(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken
FROM p
"""


def license_sql() -> str:
    """Canonical texts and digests computed again from the known texts, by another engine."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(text)}, {quote(key)})" for text, key in license_scan.known_texts())
    plain = (
        f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN regexp_matches(lower(x), {quote(license_scan.COPYRIGHT)}) THEN '' "
        f"ELSE trim(regexp_replace(replace(lower(x), '&', ' and '), {quote(license_scan.PUNCTUATION)}, ' ', 'g')) END)"
    )

    def spelled(x: str) -> str:
        out = f"' ' || {x} || ' '"
        for old, new in license_scan.SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"trim({out})"

    whole = spelled("array_to_string(list_filter(lines, lambda x: x <> ''), ' ')")
    return f"""
WITH k AS (
  SELECT sha256(t) AS digest, min(license) AS license
  FROM (SELECT {whole} AS t, license FROM (SELECT {plain} AS lines, license FROM (VALUES {rows}) v(text, license)))
  WHERE t <> '' GROUP BY 1
), d AS (
  SELECT row_number() OVER () AS n, doc_id, {plain} AS lines FROM documents
), l AS (
  SELECT n, count(*) AS notices, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM (SELECT n, sha256({spelled("x")}) AS digest FROM (SELECT n, unnest(lines) AS x FROM d)) JOIN k USING (digest) GROUP BY n
), w AS (SELECT n, doc_id, sha256({whole}) AS digest FROM d)
SELECT doc_id, w.digest AS canonical_sha256, k.license, coalesce(notices, 0) AS n_notices, coalesce(names, '') AS line_licenses
FROM w LEFT JOIN k USING (digest) LEFT JOIN l USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_DEDUP, "op9_mixing": MIXING, "op10_license_scan": license_sql()}
