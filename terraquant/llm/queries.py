"""The registered queries over the text tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from terraquant.llm import bpe, decontam, jaccard, likelihood, lines, maglev, mixing, packing, rules, urls
from terraquant.session import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op2_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return rules.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op4_rate_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return likelihood.relative_rules(documents(spark, sf_dir), target)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "containment")


def op6_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir), share=lines.SHARE)


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op8_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = rules.fit_rules(*rules.training_rows(documents(spark, sf_dir), table(spark, sf_dir, "labels")))
    return urls.judge_urls(pages, urls.page_outcomes(pages, model))


def op9_assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.assign_shards(documents(spark, sf_dir).select("doc_id"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    found = dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
    return found | {"pipeline": corpus_pipeline.run}


def _op9_sql() -> str:
    owner = maglev.lookup_table([f"shard-{i:05d}" for i in range(maglev.SHARDS)])
    return f"""
    WITH t AS (SELECT {owner} AS owner),
    s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {maglev.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM s, t"""


OP10_SQL = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
-- reshare the excess by weight among the sources that are not full, round by round
fill AS (
  SELECT 0 AS round, source, source_size, w, CAST(0 AS DOUBLE) AS target, 1.5 * sum(source_size) OVER () AS spare FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, least(2 * source_size, raised),
         sum(greatest(raised - 2 * source_size, 0)) OVER ()
  FROM (SELECT *, target + CASE WHEN target < 2 * source_size THEN spare * w / sum(CASE WHEN target < 2 * source_size THEN w END) OVER () ELSE 0 END AS raised
        FROM fill WHERE round < 60)),
t AS (SELECT source, source_size, target FROM fill WHERE round = 60),
r AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target + 1e-6) / source_size) * size
         + greatest(0, least(size, floor(target + 1e-6) - floor(floor(target + 1e-6) / source_size) * source_size - before)) END AS BIGINT) AS taken
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op9_assign_shards": _op9_sql(), "op10_mix_sources": OP10_SQL}
