"""Evidence, caveats and explained answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import CONFIDENCE_LABELS, literal_map

# Short labels of the limits that an answer may carry.
CAVEATS = {
    "unresolved": "unresolved entity, may have unmerged duplicate aliases",
    "unresolved_mention": "unresolved MENTIONS target, outside quality flags",
    "one_hop": "graph retrieval is 1-hop only",
    "tentative": "identity merge was TENTATIVE",
    "pdf_person": "PDF-sourced person name, possible encoding corruption",
    "rare_type": "Technology and Language entities are under-extracted",
}


def evidence(answers: DataFrame, results: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """Add shape, evidence_chunk, evidence_text, evidence_source, evidence_title to answers (rows of results).

    A chunk answers for itself; an answer with a chunk_id takes the chunk's row from the same results (by ``keys``),
    and keeps the shape without text if that row isn't among them; others are entities alone.
    """
    c = results.where("result_type = 'Chunk'").groupBy(*keys, F.col("entity_id").alias("chunk_id")).agg(F.min(F.struct("matched_text", "source_id")).alias("_c"))
    t = titles.groupBy(F.col("id").alias("evidence_source")).agg(F.min("title").alias("evidence_title"))
    chunk = F.col("result_type") == "Chunk"
    a = answers.join(c, [*keys, "chunk_id"], "left")
    linked = F.nullif("chunk_id", F.lit("")).isNotNull()
    a = a.withColumn("shape", F.when(chunk, "chunk_is_answer").when(linked, "entity_with_chunk").otherwise("entity_only"))
    a = a.withColumn("evidence_chunk", F.when(chunk, F.coalesce(F.nullif("chunk_id", F.lit("")), "entity_id")).when(linked, F.col("chunk_id")))
    a = a.withColumn("evidence_text", F.when(chunk, F.col("matched_text")).otherwise(F.col("_c.matched_text")))
    a = a.withColumn("evidence_source", F.when(chunk, F.col("source_id")).otherwise(F.col("_c.source_id"))).drop("_c")
    return a.join(t, "evidence_source", "left")


def caveats(results: DataFrame, graph_used) -> DataFrame:
    """Add caveats: the names of all that apply; ``graph_used`` is a boolean column or value."""
    g = graph_used if hasattr(graph_used, "alias") else F.lit(graph_used)
    loose = F.col("target_resolution") == "unresolved"
    rules = {
        "unresolved": loose, "unresolved_mention": loose & (F.col("relationship_type") == "MENTIONS"), "one_hop": g, "tentative": F.col("decision_action") == "TENTATIVE",
        "pdf_person": (F.col("node_type") == "Person") & F.col("extraction_source").startswith("pdf:"), "rare_type": F.col("node_type").isin("Technology", "Language"),
    }
    return results.withColumn("caveats", F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])))


def confidence_label(col: str = "confidence_method"):
    return F.coalesce(literal_map(CONFIDENCE_LABELS)[F.col(col)], F.col(col))


def explained(question: str, category: str, types: list[str] | None, retrievers: list[str], ranked: DataFrame, results: DataFrame, titles: DataFrame, rank: int = 1) -> DataFrame:
    """One row that explains the answer at ``rank`` (no row if there is none)."""
    one = ranked.where(F.col("rank") == rank).withColumn("_q", F.lit(1))
    a = caveats(evidence(one, results.withColumn("_q", F.lit(1)), titles, ["_q"]), "graph" in retrievers)
    return a.select(
        F.lit(question).alias("question"), F.col("entity_id").alias("answer_entity_id"), F.col("matched_text").alias("answer_text"), F.col("result_type").alias("answer_type"), "target_resolution",
        "shape", "evidence_chunk", "evidence_text", "evidence_source", "evidence_title", F.lit(category).alias("routing"), F.lit(",".join(types or [])).alias("edge_types"), F.lit(",".join(retrievers)).alias("retrievers"),
        (F.col("source") == "fusion").alias("fused"), "score", confidence_label().alias("confidence"), "caveats",
    )
