"""Aggregates over the graph and over a resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import check_edge_types


def most_mentioned(mentions: DataFrame, canonicals: DataFrame, limit: int = 10) -> DataFrame:
    """(canonical_id, mention_count): canonicals mentioned by the most distinct sources."""
    m = mentions.join(canonicals.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return m.groupBy(F.col("target_id").alias("canonical_id")).agg(F.count_distinct("source_id").alias("mention_count")).orderBy(F.desc("mention_count"), "canonical_id").limit(limit)


def by_alias_count(links: DataFrame, least: int = 3, limit: int = 10) -> DataFrame:
    """(canonical_id, alias_count) of canonicals with at least ``least`` members."""
    n = links.groupBy("canonical_id").agg(F.count("*").alias("alias_count"))
    return n.where(F.col("alias_count") >= least).orderBy(F.desc("alias_count"), "canonical_id").limit(limit)


def edge_statistics(edges: DataFrame, edge_type: str) -> DataFrame:
    """One row (edge_count, avg, min, max of confidence); zero and nulls for a known type without edges."""
    check_edge_types([edge_type])
    c = F.col("confidence")
    return edges.where(F.col("type") == edge_type).agg(F.count("*").alias("edge_count"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def names_across_sources(entities: DataFrame, least: int = 2) -> DataFrame:
    """(name, sources, n_sources, confidence): names, in lower case, that at least ``least`` sources have."""
    g = entities.where("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("extraction_source")).alias("sources"), F.max("confidence").alias("confidence"))
    return g.withColumn("n_sources", F.size("sources")).where(F.col("n_sources") >= least)


def author_lists(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(source_id, authors): sorted names of the targets of AUTHORED_BY edges; ``names`` is (id, name)."""
    a = edges.where("type = 'AUTHORED_BY'").join(names.select(F.col("id").alias("target_id"), "name"), "target_id")
    return a.groupBy("source_id").agg(F.array_sort(F.collect_list("name")).alias("authors"))


def distinct_authors(edges: DataFrame, links: DataFrame) -> DataFrame:
    """One row (canonical_aware, naive): distinct authors with aliases counted once, and each alias counted."""
    a = edges.where("type = 'AUTHORED_BY'").select("target_id")
    aware = a.agg(F.count_distinct("target_id").alias("canonical_aware"))
    expanded = a.join(links.select(F.col("canonical_id").alias("target_id"), "entity_id"), "target_id", "left")
    naive = expanded.agg(F.count_distinct(F.coalesce("entity_id", "target_id")).alias("naive"))
    return aware.crossJoin(naive)  # one row by one row


def score_histogram(pairs: DataFrame, steps: int = 20) -> DataFrame:
    """(bucket, n): scores in buckets of 1/steps; null and NaN scores are left out."""
    ok = pairs.where("score IS NOT NULL AND NOT isnan(score)")
    return ok.groupBy((F.floor(F.col("score") * steps) / steps).alias("bucket")).agg(F.count("*").alias("n"))


def resolution_metrics(decisions: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: members, canonicals, reduction in percent, mean aliases, canonicals across sources, orphans.

    Orphans are ids of pairs with a score of at least 0.70 that no cluster holds.
    """
    d = decisions.where("action <> 'NONE'")
    m = d.select("canonical_id", F.explode("source_ids").alias("id")).distinct()
    s = m.join(entities.select("id", "extraction_source").distinct(), "id", "left").groupBy("canonical_id").agg(F.count_distinct("id").alias("n"), F.count_distinct("extraction_source").alias("k"))
    one = s.agg(F.sum("n").alias("members"), F.count("*").alias("canonicals"), F.sum((F.col("k") > 1).cast("long")).alias("cross_source"))
    live = pairs.where("score >= 0.70 AND NOT isnan(score)")
    ids = live.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    orphans = ids.join(m.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("orphans"))
    out = one.crossJoin(orphans)  # one row by one row
    return out.select(
        "members", "canonicals", F.bround(100 * (1 - F.col("canonicals") / F.col("members")), 4).alias("reduction_percent"), F.bround(F.col("members") / F.col("canonicals"), 4).alias("mean_aliases"), "cross_source", "orphans"
    )


def size_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.where("action <> 'NONE'").groupBy(F.size("source_ids").alias("cluster_size")).agg(F.count("*").alias("n"))


def coauthors(edges: DataFrame) -> DataFrame:
    """(person_a, person_b, papers), person_a < person_b: two hops over AUTHORED_BY, by distinct targets per paper."""
    a = edges.where("type = 'AUTHORED_BY'").select("source_id", "target_id").distinct()
    b = a.select("source_id", F.col("target_id").alias("person_b"))
    return a.withColumnRenamed("target_id", "person_a").join(b, "source_id").where("person_a < person_b").groupBy("person_a", "person_b").agg(F.count("*").alias("papers"))


def mentioned_by_all(mentions: DataFrame, source_ids: list[str]) -> DataFrame:
    """(target_id): what every one of the sources mentions."""
    out = None
    for s in source_ids:
        part = mentions.where(F.col("source_id") == s).select("target_id")
        out = part.distinct() if out is None else out.intersect(part)
    return out


def shared_names(entities: DataFrame, prefix_a: str, prefix_b: str) -> DataFrame:
    """(name, id_a, id_b): entities of two kinds of sources whose names agree in lower case."""
    e = entities.select("id", F.lower("name").alias("name"), "extraction_source")
    a = e.where(F.col("extraction_source").startswith(prefix_a)).select("name", F.col("id").alias("id_a"))
    b = e.where(F.col("extraction_source").startswith(prefix_b)).select("name", F.col("id").alias("id_b"))
    return a.join(b, "name")
