"""Relationships: authors, mentions, chunks and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.schema import BYLINE_AUTHOR, METADATA_AUTHOR, SOURCE_KINDS


def same_as(decisions: DataFrame) -> DataFrame:
    """(canonical_id, entity_id, decision_action) of MERGE and TENTATIVE decisions; an entity in several keeps the smallest."""
    d = decisions.where(F.col("action").isin("MERGE", "TENTATIVE")).select("canonical_id", F.explode("source_ids").alias("entity_id"), F.col("action").alias("decision_action"))
    return d.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min(F.struct("canonical_id", "decision_action")).alias("m")).select("m.canonical_id", "entity_id", "m.decision_action")


def resolve_targets(rows: DataFrame, links: DataFrame, col: str = "target_id") -> DataFrame:
    """Replace ids in ``col`` by their canonical id where there is one: one join in place of a look-up per row."""
    m = links.select(F.col("entity_id").alias(col), F.col("canonical_id").alias("_c"))
    return rows.join(m, col, "left").withColumn(col, F.coalesce("_c", col)).drop("_c")


def first_by_target(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(extraction_source, target_id, entity_id): the first entity (by id) of each source and resolved target."""
    e = resolve_targets(entities.select("extraction_source", F.col("id").alias("entity_id"), F.col("id").alias("target_id")), links)
    return e.groupBy("extraction_source", "target_id").agg(F.min("entity_id").alias("entity_id"))


def extract_authors(papers: DataFrame) -> DataFrame:
    """Author candidates (source_id, target_name, type, confidence, evidence): from the metadata, else from the byline.

    Of the metadata's author list only the first entry is split, as it holds the raw field.
    """
    raw = F.nullif(F.trim(F.get("authors", F.lit(0))), F.lit(""))
    meta = F.size(X.split_names(F.coalesce(raw, F.lit("")))) > 0
    p = papers.select(F.col("paper_id").alias("source_id"), "extraction_source", F.when(meta, X.split_names(raw)).otherwise(X.byline("text")).alias("names"), meta.alias("from_metadata"))
    c = p.select("source_id", "extraction_source", "from_metadata", F.explode("names").alias("target_name"))
    return c.select(
        "source_id", "extraction_source", "target_name", F.lit("AUTHORED_BY").alias("type"),
        F.when(F.col("from_metadata"), METADATA_AUTHOR).otherwise(BYLINE_AUTHOR).alias("confidence"), F.when(F.col("from_metadata"), "metadata").otherwise("byline").alias("evidence"),
    )


def author_ids(candidates: DataFrame) -> DataFrame:
    """Add person_id: the id that an extracted person of that name and source has."""
    return candidates.withColumn("person_id", F.concat(F.lit("person_"), X.entity_slug("target_name"), F.lit("__"), X.slug(X.lowered(F.regexp_replace("extraction_source", "(?s)^[^:]*:", "")))))


def resolve_authors(candidates: DataFrame, persons: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(AUTHORED_BY edges to live persons or their canonicals, candidates whose person is unknown)."""
    c = author_ids(candidates)
    live = persons.select(F.col("id").alias("person_id")).distinct()
    hit = resolve_targets(c.join(live, "person_id").withColumnRenamed("person_id", "target_id"), links)
    return hit.select("source_id", "type", "target_id", "confidence", "extraction_source", "evidence"), c.join(live, "person_id", "left_anti")


def extract_mentions(entities: DataFrame) -> DataFrame:
    """One MENTIONS candidate per extracted entity, from its source's node."""
    kinds = F.substring_index("extraction_source", ":", 1).isin(*SOURCE_KINDS)
    e = entities.where(kinds)
    return e.select(
        X.source_node_id("extraction_source").alias("source_id"), F.lit("MENTIONS").alias("type"), F.col("id").alias("target_id"), "confidence", "extraction_source",
        F.col("mention_count").alias("frequency"), F.concat(F.lit("mentioned "), F.col("mention_count").cast("string"), F.lit(" time(s)")).alias("evidence"),
    )


def resolve_mentions(entities: DataFrame, links: DataFrame) -> DataFrame:
    """MENTIONS edges to canonicals where there are any; edges that then repeat are kept once, the smallest entity's."""
    e = extract_mentions(entities).withColumn("entity_id", F.col("target_id"))
    e = resolve_targets(e, links)
    cols = ["confidence", "extraction_source", "frequency", "evidence"]
    return e.groupBy("source_id", "type", "target_id").agg(F.min_by(F.struct(*cols), "entity_id").alias("r")).select("source_id", "type", "target_id", "r.*")


def has_chunk(chunks: DataFrame) -> DataFrame:
    """HAS_CHUNK edges and the chunk's number through all files of its source."""
    w = Window.partitionBy("source_id").orderBy("source_file", "chunk_index", "id")
    return chunks.select("source_id", F.lit("HAS_CHUNK").alias("type"), F.col("id").alias("target_id"), (F.row_number().over(w) - 1).alias("number"))


def mention_chunks(entities: DataFrame, chunks: DataFrame, width: int = 2048) -> DataFrame:
    """(id, chunk_id): the first chunk of the same file that covers the entity's first mention.

    Positions and chunks meet in bins of ``width`` characters, so the range condition is an equi join; a chunk is in
    as many bins as it spans, and a file with many mentions is spread over its bins.
    """
    lo, hi = F.floor(F.col("char_start") / width), F.floor((F.col("char_end") - 1) / width)
    c = chunks.where("char_end > char_start").select("source_file", F.col("id").alias("chunk_id"), "chunk_index", "char_start", "char_end", F.explode(F.sequence(lo, hi)).alias("bin"))
    e = entities.where("doc_char_start IS NOT NULL").select("id", "source_file", "doc_char_start", F.floor(F.col("doc_char_start") / width).alias("bin"))
    hit = e.join(c, ["source_file", "bin"]).where("char_start <= doc_char_start AND doc_char_start < char_end")
    return hit.groupBy("id").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))


def enrich_evidence(edges: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Set evidence_chunk_id on existing edges only; ``enrichments`` is (source_id, type, target_id, chunk_id)."""
    n = enrichments.groupBy("source_id", "type", "target_id").agg(F.min("chunk_id").alias("_c"))
    base = edges if "evidence_chunk_id" in edges.columns else edges.withColumn("evidence_chunk_id", F.lit(None).cast("string"))
    return base.join(n, ["source_id", "type", "target_id"], "left").withColumn("evidence_chunk_id", F.coalesce("_c", "evidence_chunk_id")).drop("_c")


#: Edge type to the functions that find candidates and resolve them.
REGISTRY = {"AUTHORED_BY": (extract_authors, resolve_authors), "MENTIONS": (extract_mentions, resolve_mentions)}
