"""Writes: upserts as joins, and a staged commit by rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import assert_flat

EDGE_KEY = ["source_id", "type", "target_id"]


def last_rows(new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key of a batch: the last by ``order``, so that a batch merges like its rows one by one."""
    if order is None:
        return new.dropDuplicates(key)
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` and the rows of ``old`` without a key in it: a full replacement of properties."""
    kept = old.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_properties(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Like :func:`upsert`, but properties that ``new`` lacks or has as null keep their old value."""
    cols = list(dict.fromkeys([*old.columns, *new.columns]))
    n = new.select(*[F.col(c).alias(c if c in key else f"_n_{c}") for c in new.columns])
    both = old.join(n, key, "full")
    value = lambda c: F.coalesce(*[F.col(x) for x in (f"_n_{c}", c) if x in both.columns]).alias(c)
    return both.select(*[F.col(c) if c in key else value(c) for c in cols])


def check_unique(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(id, n) of ids that occur more than once: the constraint that node tables must meet. Null ids count too."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def create_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append nodes; an id that exists, or comes twice, is an error, as a unique constraint would make it."""
    both = old.unionByName(new, allowMissingColumns=True)
    bad = check_unique(both.select("id")).limit(5).collect()
    if bad:
        raise ValueError(f"ids are not unique: {[r[0] for r in bad]}")
    return both


def write_resolution(entities: DataFrame, canonicals: DataFrame, edges: DataFrame, decisions: DataFrame, decided_at: int) -> tuple[DataFrame, DataFrame]:
    """(canonicals, edges) after a resolution: canonicals merged by id, SAME_AS edges merged by their ends."""
    return (
        merge_properties(canonicals, canonical_rows(decisions, decided_at), ["id"]),
        merge_edges(edges, same_as_rows(decisions, entities, decided_at)),
    )


def create_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist; others are left out without an error."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def merge_edges(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert of edges by source, type and target."""
    return upsert(old, last_rows(new, EDGE_KEY, order), EDGE_KEY)


def canonical_rows(decisions: DataFrame, decided_at: int) -> DataFrame:
    """Canonical nodes of MERGE and TENTATIVE decisions; NONE gives none."""
    d = decisions.where(F.col("action").isin("MERGE", "TENTATIVE"))
    return d.select(
        F.col("canonical_id").alias("id"), "canonical_name", F.col("entity_type").alias("type"), F.size(F.array_distinct("source_ids")).alias("source_count"), "confidence", F.lit(decided_at).cast("long").alias("created_at"),
        F.lit("resolution:candidate_pairs").alias("extraction_source"), F.lit("merge_resolver:union_find@v1").alias("extraction_method"),
    ).dropDuplicates(["id"])


def same_as_rows(decisions: DataFrame, entities: DataFrame, decided_at: int) -> DataFrame:
    """SAME_AS edges from canonicals to those members that exist."""
    d = decisions.where(F.col("action").isin("MERGE", "TENTATIVE")).select("canonical_id", "action", F.explode("source_ids").alias("target_id")).distinct()
    e = entities.select(F.col("id").alias("target_id")).distinct()
    return d.join(e, "target_id", "left_semi").select(F.col("canonical_id").alias("source_id"), F.lit("SAME_AS").alias("type"), "target_id", F.col("action").alias("decision_action"), F.lit(decided_at).cast("long").alias("decided_at"))


def set_vectors(nodes: DataFrame, vectors: DataFrame, prop: str) -> DataFrame:
    """Set the vector property of existing nodes; ``vectors`` is (id, v)."""
    if prop not in ("name_embedding", "embedding"):
        raise ValueError(f"not a vector property: {prop}")
    base = nodes.drop(prop) if prop in nodes.columns else nodes
    old = nodes.select("id", F.col(prop).alias("_o")) if prop in nodes.columns else None
    out = base.join(vectors.select("id", F.col("v").alias(prop)), "id", "left")
    if old is not None:
        out = out.join(old, "id", "left").withColumn(prop, F.coalesce(prop, "_o")).drop("_o")
    return out


def clear_source(nodes: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed): without the nodes of a source and every edge at one of them; removed is one row."""
    gone = nodes.where(F.col("extraction_source") == source).select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    kept = nodes.where(F.col("extraction_source").isNull() | (F.col("extraction_source") != source))
    return kept, e, gone.agg(F.count("*").alias("removed"))


def commit(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write to a folder beside ``path``, then put it in its place; returns the rows written.

    Readers see the old or the new table, never a part. The count comes from the write itself.
    """
    from pyspark.sql import Observation

    assert_flat(df)
    seen = Observation()
    tmp = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(tmp)
    spark = df.sparkSession
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = P(f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")
    if fs.exists(P(path)):
        fs.rename(P(path), old)
    fs.rename(P(tmp), P(path))
    fs.delete(old, True)
    return int(seen.get["n"])


def write_artifact(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)
