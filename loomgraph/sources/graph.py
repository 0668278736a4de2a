"""Reads of the graph: node scans, look-ups, titles, SQL with parameters, JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def node_table(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, type, name, resolution, extraction_source) of entities and canonicals."""
    e = entities.select("id", "type", "name", F.lit("unresolved").alias("resolution"), "extraction_source")
    c = decisions.where(F.col("action").isin("MERGE", "TENTATIVE")).groupBy("canonical_id").agg(F.min(F.struct("entity_type", "canonical_name")).alias("m"))
    return e.unionByName(c.select(F.col("canonical_id").alias("id"), F.col("m.entity_type").alias("type"), F.col("m.canonical_name").alias("name"), F.lit("canonical").alias("resolution"), F.lit("resolution:candidate_pairs").alias("extraction_source")))


def source_titles(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, title) for the wanted ids of ``docs`` (id, title, name); null and empty titles are left out."""
    t = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("name"), F.lit("")))
    return docs.join(ids.select("id").distinct(), "id", "left_semi").select("id", t.alias("title")).where("title IS NOT NULL").distinct()


def run_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """Any SQL over the given tables, with bound parameters."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def read_artifact(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Rows of the list ``field`` of a JSON document that is one object."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("_r")).select("_r.*")
