"""Queries over the training-data operators; keys are pN_name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import abuse, components, encoding, markup, names, neighbours, packing, rank_fusion, survivors, tokens
from loomgraph.runtime import staged, table

#: Probability from which a document counts as abusive.
ABUSIVE = 0.65


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.best_supported(table(spark, d, "retrieval_results"), table(spark, d, "retrieval_queries"))


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = rank_fusion.fused_ranking(table(spark, d, "retrieval_results"))
    return r.select("query_id", "entity_id", F.round("fused", 6).alias("fused"), "n_sources", "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = markup.records_with_markup(table(spark, d, "markdown_docs"), "markdown_id", "markdown_docs")
    return a.unionByName(markup.records_with_markup(table(spark, d, "repo_documents"), "repo_doc_id", "repo_documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "markdown_docs").select(F.lit("markdown_docs").alias("table_name"), F.col("markdown_id").alias("record_id"), "text")
    r = table(spark, d, "repo_documents").select(F.lit("repo_documents").alias("table_name"), F.col("repo_doc_id").alias("record_id"), "text")
    return markup.convert_markup(m.unionByName(r)).select("table_name", "record_id", "markup.kinds", "markup.clean", "markup.blocks")


def p3_near(spark: SparkSession, d: str) -> DataFrame:
    e = neighbours.usable_vectors(table(spark, d, "entities"), "entity", "id", "name_embedding")
    return neighbours.nearest(e.unionByName(neighbours.usable_vectors(table(spark, d, "chunks"), "chunk", "id", "embedding")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(p3_near(spark, d))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_fields(table(spark, d, "pdf_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(p4_restored(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    m = names.entity_mentions(table(spark, d, "entities")).unionByName(names.author_mentions(table(spark, d, "pdf_metadata")))
    return names.linked_mentions(m)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.mention_pairs(p5_groups(spark, d))


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    r = survivors.survivors(table(spark, d, "resolution_decisions"), table(spark, d, "entities"), table(spark, d, "source_trust"))
    return r.select("canonical_id", "field_name", "value", "entity_id", F.round("posterior", 6).alias("posterior"), F.col("ahead.entity_id").alias("ahead_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # the statement asks for the member of best standing; p6_survivors has the fusion
    return survivors.ahead(table(spark, d, "resolution_decisions"), table(spark, d, "entities"), table(spark, d, "source_trust"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate(table(spark, d, "candidate_pairs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_packed(spark, d)).withColumn("fill", F.round("fill", 6))


def _abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.train_from_tables(docs, table(spark, d, "abuse_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).where(F.col("abusive") >= ABUSIVE).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in abuse.CHAIN])


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates_by_source(staged(_abuse_scores(spark, d), "scores"), ABUSIVE).withColumn("rate", F.round("rate", 6))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_ranking, p2_found, p2_clean, p3_found, p3_near, p4_found, p4_restored, p5_found, p5_groups,
        p6_found, p6_survivors, p7_found, p8_ids, p9_packed, p9_fill, p10_found, p10_scores, p10_rates,
    )
}

ORACLES = {
    # the documented rule of the surviving member, without the fusion
    "p6_found": """
WITH m AS (SELECT DISTINCT canonical_id, unnest(source_ids) AS entity_id FROM resolution_decisions
  WHERE action IN ('MERGE', 'TENTATIVE') AND length(trim(canonical_id)) > 0),
e AS (SELECT * FROM entities WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, ingested_at DESC) = 1),
v AS (SELECT m.canonical_id, m.entity_id, coalesce(t.trust, 0) AS trust,
  coalesce(CASE WHEN isnan(e.confidence) THEN NULL WHEN e.confidence BETWEEN 0 AND 1 THEN e.confidence WHEN e.confidence BETWEEN 2 AND 100 THEN e.confidence / 100 END, 0) AS conf,
  e.observed_at, unnest(['name', 'description', 'homepage', 'category']) AS field_name,
  unnest([e.name, e.description, e.homepage, e.category]) AS value
  FROM m JOIN e ON e.id = m.entity_id LEFT JOIN source_trust t ON t.source_kind = split_part(e.extraction_source, ':', 1))
SELECT canonical_id, field_name, entity_id FROM v
WHERE value IS NOT NULL AND lower(trim(value, ' ' || chr(9) || chr(10) || chr(160))) NOT IN ('', '-', '--', '—', '–', '?', '??', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'tbd', 'tba', 'todo', 'unknown', 'undefined', 'not available', 'not applicable', 'xxx', '...', '…')
QUALIFY row_number() OVER (PARTITION BY canonical_id, field_name ORDER BY trust DESC, conf DESC, observed_at DESC NULLS LAST, entity_id) = 1
""",
    "p7_found": """
WITH RECURSIVE e AS (SELECT DISTINCT trim(id_a, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS a, trim(id_b, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS b
  FROM candidate_pairs WHERE score >= 0.70 AND NOT isnan(score)),
u AS (SELECT a, b FROM e WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM e WHERE a <> b AND a <> '' AND b <> ''),
r AS (SELECT a AS id, a AS r FROM u UNION SELECT u.b, r.r FROM r JOIN u ON u.a = r.id)
SELECT id, min(r) AS group_id FROM r GROUP BY id
""",
}
