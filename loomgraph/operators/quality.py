"""Quality flags over decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.schema import LARGE_CLUSTER

COLUMNS = ("flag_type", "canonical_id", "canonical_name", "entity_type", "evidence")


def _members(decisions: DataFrame) -> DataFrame:
    return decisions.select("canonical_id", "canonical_name", "entity_type", "action", F.explode("source_ids").alias("id")).distinct()


def short_name_flags(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """TENTATIVE clusters held by an embedding edge between members one of whose names is short or initials only."""
    e = pairs.where(F.array_contains("matched_by", "embedding_similarity"))
    e = e.where(X.is_risky(X.normalized("name_a")) | X.is_risky(X.normalized("name_b")))
    m = _members(decisions.where("action = 'TENTATIVE'"))
    a = m.withColumnRenamed("id", "id_a")
    b = m.select(F.col("canonical_id").alias("c2"), F.col("id").alias("id_b"))
    hit = e.join(a, "id_a").join(b, "id_b").where("canonical_id = c2")
    text = F.concat("name_a", F.lit(" ~ "), "name_b")
    return hit.groupBy("canonical_id", "canonical_name", "entity_type").agg(F.array_sort(F.collect_set(text)).alias("evidence")).withColumn("flag_type", F.lit("short_name_embedding")).select(*COLUMNS)


def stutter_flags(decisions: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters with a member whose name repeats itself; ``names`` is (id, name)."""
    hit = _members(decisions).join(names, "id").where(X.has_stutter(X.normalized("name")))
    return hit.groupBy("canonical_id", "canonical_name", "entity_type").agg(F.array_sort(F.collect_set("name")).alias("evidence")).withColumn("flag_type", F.lit("ner_stutter")).select(*COLUMNS)


def large_flags(decisions: DataFrame) -> DataFrame:
    """TENTATIVE clusters of five members or more."""
    d = decisions.where((F.col("action") == "TENTATIVE") & (F.size("source_ids") >= LARGE_CLUSTER))
    return d.withColumn("flag_type", F.lit("large_tentative_cluster")).withColumn("evidence", F.col("source_ids")).select(*COLUMNS)


def collision_flags(decisions: DataFrame) -> DataFrame:
    """Clusters whose normalized name also stands for a cluster of another type; evidence lists the others."""
    d = decisions.where("action <> 'NONE'").withColumn("norm", X.normalized("canonical_name")).where("norm <> ''")
    many = d.groupBy("norm").agg(F.count_distinct("entity_type").alias("k")).where("k > 1").select("norm")
    d = d.join(many, "norm").select("norm", "canonical_id", "canonical_name", "entity_type").distinct()
    o = d.select("norm", F.col("canonical_id").alias("o"), F.col("entity_type").alias("ot"))
    both = d.join(o, "norm").where("o <> canonical_id OR ot <> entity_type")
    text = F.concat("o", F.lit(" ("), "ot", F.lit(")"))
    return both.groupBy("canonical_id", "canonical_name", "entity_type").agg(F.array_sort(F.collect_set(text)).alias("evidence")).withColumn("flag_type", F.lit("cross_type_collision")).select(*COLUMNS)


def flag_decisions(decisions: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """All flags of MERGE and TENTATIVE decisions."""
    d = decisions.where("action <> 'NONE'")
    return short_name_flags(d, pairs).unionByName(stutter_flags(d, names)).unionByName(large_flags(d)).unionByName(collision_flags(d))
