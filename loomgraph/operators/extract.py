"""From mentions and documents to entities."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.schema import BASE_CONFIDENCE, ID_PREFIXES, LABEL_TYPES, MAX_CONFIDENCE, MENTION_LABELS, REPEAT_BONUS, literal_map


class Extractor(Protocol):
    """Anything that turns chunks into mentions (text, label, doc_char_start, doc_char_end, source_file, extraction_source, ord)."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


def capitalised_spans(chunks: DataFrame) -> DataFrame:
    """A rule-based extractor: runs of two to four capitalised words; the last word tells an organisation.

    ``chunks`` has content, char_start, source_file, extraction_source and chunk_index; positions are those of the
    content added to char_start.
    """
    org = "(?:University|Foundation|Institute|Laboratories|Systems|Partners|Publishing|Library)"
    span = r"(?U)\b(\p{Lu}[\p{L}’'-]+(?: \p{Lu}[\p{L}’'-]+){1,3})\b"
    rows = chunks.select("extraction_source", "source_file", "chunk_index", "char_start", "content", F.posexplode(F.regexp_extract_all("content", F.lit(span), F.lit(1))).alias("i", "text"))
    start = F.col("char_start") + F.instr("content", F.col("text")) - 1
    label = F.when(F.col("text").rlike(org), "ORG").otherwise("PERSON")
    out = rows.select("extraction_source", "source_file", "text", label.alias("label"), start.alias("doc_char_start"), (start + F.length("text")).alias("doc_char_end"), F.struct("source_file", "chunk_index", "i").alias("ord"))
    return out.where(~X.is_noise("text"))


def kept_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with a label of interest that are no noise."""
    return mentions.where(F.col("label").isin(*MENTION_LABELS) & ~X.is_noise("text"))


def skipped_labels(mentions: DataFrame) -> DataFrame:
    """(label, n) of kept mentions whose label has no node type."""
    return kept_mentions(mentions).where(~F.col("label").isin(*LABEL_TYPES)).groupBy("label").agg(F.count("*").alias("n"))


def collapse_mentions(mentions: DataFrame, method: str = "rules:capitalised@1") -> DataFrame:
    """One entity per (source, type, slug of the name), from mentions with ``ord`` as their order.

    The name is the most frequent surface form (ties: the first seen), the aliases are the others in order; offsets
    and file are those of the first mention; confidence grows with repeats. Two levels of aggregation, the first
    by surface form, so a frequent name is combined before it is shuffled.
    """
    typed = mentions.select(
        "extraction_source", literal_map(LABEL_TYPES)[F.col("label")].alias("type"), X.collapse("text").alias("form"), X.entity_slug("text").alias("slug"), "doc_char_start", "doc_char_end", "source_file", "ord"
    ).where("type IS NOT NULL")
    forms = typed.groupBy("extraction_source", "type", "slug", "form").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by(F.struct("doc_char_start", "doc_char_end", "source_file"), "ord").alias("at")
    )
    rank = Window.partitionBy("extraction_source", "type", "slug").orderBy(F.desc("n"), "first")
    forms = forms.withColumn("r", F.row_number().over(rank))
    e = forms.groupBy("extraction_source", "type", "slug").agg(
        F.max(F.when(F.col("r") == 1, F.col("form"))).alias("name"), F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.col("form")))).alias("aliases"),
        F.sum("n").alias("mention_count"), F.min_by("at", "first").alias("at"),
    )
    confidence = F.least(F.lit(MAX_CONFIDENCE), F.lit(BASE_CONFIDENCE) + REPEAT_BONUS * (F.col("mention_count") - 1))
    return e.select(
        F.concat(literal_map(ID_PREFIXES)[F.col("type")], F.lit("_"), "slug", F.lit("__"), X.slug(X.lowered(F.regexp_replace("extraction_source", "(?s)^[^:]*:", "")))).alias("id"),
        "type", "name", confidence.alias("confidence"), "extraction_source", F.lit(method).alias("extraction_method"), "mention_count",
        "at.doc_char_start", "at.doc_char_end", "at.source_file", "aliases", F.when(F.col("type") == "Person", F.col("name")).alias("full_name"),
    )


def source_entities(docs: DataFrame, kind: str, title_col: str | None, now: int = 0) -> DataFrame:
    """Paper, Markdown or Repository nodes of ``docs`` (extraction_source and a title); the slug stands in for a title."""
    prefix = {"Paper": "paper", "Markdown": "markdown", "Repository": "repo"}[kind]
    s = X.source_slug("extraction_source")
    title = F.coalesce(F.nullif(F.col(title_col), F.lit("")), s) if title_col else s
    return docs.select(
        F.concat(F.lit(prefix + "_"), s).alias("id"), F.lit(kind).alias("type"), title.alias("name"), F.lit(1.0).alias("confidence"), "extraction_source",
        F.lit("ingestion").alias("extraction_method"), F.lit(now).cast("long").alias("ingestion_timestamp"),
    ).distinct()


def chunk_entities(chunks: DataFrame, now: int = 0) -> DataFrame:
    """Chunk nodes: id chunk_{source slug}_{index}, numbered through all files of a source in their order."""
    w = Window.partitionBy("source_id").orderBy("source_file", "chunk_index")
    k = F.row_number().over(w) - 1
    return chunks.withColumn("chunk_index", k).select(
        F.concat(F.lit("chunk_"), F.regexp_replace("source_id", "^(?:paper|markdown|repo)_", ""), F.lit("_"), F.col("chunk_index").cast("string")).alias("id"),
        "source_id", "source_file", "chunk_index", "content", "char_start", "char_end", F.lit(1.0).alias("confidence"), F.lit(now).cast("long").alias("created_at"),
    )
