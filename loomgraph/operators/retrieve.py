"""Graph, vector and keyword retrieval, and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.functions import text as X
from loomgraph.schema import RRF_K, check_edge_types

RESULT = ("entity_id", "result_type", "score", "source", "matched_text", "target_resolution", "confidence_method", "chunk_id")
META = ("node_type", "relationship_type", "extraction_source", "decision_action", "source_id", "chunk_index", "outgoing")
_NULLS = {"node_type": "string", "relationship_type": "string", "extraction_source": "string", "decision_action": "string", "source_id": "string", "chunk_index": "long", "outgoing": "boolean", "chunk_id": "string"}


def as_results(df: DataFrame) -> DataFrame:
    """The columns of a result row in their order; those that ``df`` lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(_NULLS[c]).alias(c) for c in (*RESULT, *META)])


def entity_context(node_id: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, types: list[str] | None = None, include_seed: bool = True) -> DataFrame:
    """The node, its neighbours over one edge in either direction, and the chunks that are evidence of these edges.

    ``nodes`` is (id, type, name, resolution, extraction_source); ``edges`` has source_id, type, target_id, confidence
    and maybe extraction_source, evidence_chunk_id, decision_action. One row per edge, so a neighbour may repeat.
    An unknown node has no rows. Both filters reach the scan of the edges; order with :func:`graph_order`.
    """
    e = edges if types is None else edges.where(F.col("type").isin(*check_edge_types(types)))
    opt = [F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("extraction_source", "evidence_chunk_id", "decision_action")]
    out = e.where(F.col("source_id") == node_id).select(F.col("target_id").alias("id"), F.col("type").alias("relationship_type"), "confidence", *opt, F.lit(True).alias("outgoing"))
    back = e.where(F.col("target_id") == node_id).select(F.col("source_id").alias("id"), F.col("type").alias("relationship_type"), "confidence", *opt, F.lit(False).alias("outgoing"))
    seed = nodes.where(F.col("id") == node_id)
    hops = out.unionByName(back).join(seed.select(F.lit(1).alias("_live")).limit(1), F.lit(True), "left_semi")  # at most one row
    near = hops.join(nodes.select("id", F.col("type").alias("node_type"), "name", "resolution"), "id")
    linked = as_results(near.select(
        F.col("id").alias("entity_id"), F.when(F.col("resolution") == "canonical", "Canonical").otherwise("Entity").alias("result_type"), F.col("confidence").alias("score"), F.lit("graph").alias("source"),
        X.display_name("name").alias("matched_text"), F.col("resolution").alias("target_resolution"), F.lit("graph_edge_confidence").alias("confidence_method"), F.col("evidence_chunk_id").alias("chunk_id"),
        "node_type", "relationship_type", "extraction_source", "decision_action", "outgoing",
    ))
    ids = hops.where("evidence_chunk_id IS NOT NULL").select(F.col("evidence_chunk_id").alias("id")).distinct()
    proof = as_results(chunks.join(ids, "id", "left_semi").select(
        F.col("id").alias("entity_id"), F.lit("Chunk").alias("result_type"), F.lit(1.0).alias("score"), F.lit("graph").alias("source"), F.substring("content", 1, 200).alias("matched_text"),
        F.lit("unresolved").alias("target_resolution"), F.lit("graph_evidence_chunk").alias("confidence_method"), F.col("id").alias("chunk_id"), "source_id", F.col("chunk_index").cast("long").alias("chunk_index"),
    ))
    rows = linked.unionByName(proof)
    if not include_seed:
        return rows
    own = as_results(seed.select(
        F.col("id").alias("entity_id"), F.when(F.col("resolution") == "canonical", "Canonical").otherwise("Entity").alias("result_type"), F.lit(1.0).alias("score"), F.lit("graph").alias("source"),
        X.display_name("name").alias("matched_text"), F.col("resolution").alias("target_resolution"), F.lit("graph_exact_match").alias("confidence_method"), F.col("type").alias("node_type"), "extraction_source",
    ))
    return own.unionByName(rows)


def graph_order() -> list:
    """Chunks last; then by score, entity and relationship."""
    return [F.asc(F.col("result_type") == "Chunk"), F.desc("score"), F.asc("entity_id"), F.asc_nulls_first("relationship_type")]


def search_vectors(index: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(id, cosine): the k nearest of ``index`` (id, v) to one query vector, exact: scan, project, top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    c = index.where("v IS NOT NULL").select("id", S.cosine(F.col("v"), q).alias("cosine")).where("cosine IS NOT NULL")
    return c.orderBy(F.desc("cosine"), "id").limit(k)


def search_by_name(entities: DataFrame, canonicals: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """Nearest names: the k best of each of the two indexes, then of both. Inputs have id, name, v."""
    both = search_vectors(entities, query, k).withColumn("target_resolution", F.lit("unresolved")).unionByName(search_vectors(canonicals, query, k).withColumn("target_resolution", F.lit("canonical")))
    return both.orderBy(F.desc("cosine"), "id").limit(k)


def search_by_passage(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """Nearest passages of (id, v, content)."""
    best = search_vectors(chunks, query, k)
    return best.join(chunks.select("id", F.substring("content", 1, 200).alias("preview")), "id").orderBy(F.desc("cosine"), "id")


#: Which node types and columns each of the keyword indexes covers.
INDEXES = {
    "document": (("Paper", "Markdown"), ("title", "description")), "person": (("Person",), ("full_name",)),
    "technology": (("Technology",), ("name", "description", "aliases")), "organization": (("Organization",), ("name", "description", "aliases")),
}
K1, B = 1.2, 0.75


def postings(entities: DataFrame, index: str) -> DataFrame:
    """(id, term, tf, dl) of one keyword index; only raw entities are indexed, canonicals carry none of its fields."""
    types, fields = INDEXES[index]
    parts = [F.concat_ws(" ", F.col(f)) if f == "aliases" else F.col(f) for f in fields if f in entities.columns]
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    d = entities.where(F.col("type").isin(*types)).select("id", words.alias("w")).where(F.size("w") > 0)
    return d.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def search_by_keyword(entities: DataFrame, query: str, k: int = 5, indexes: tuple[str, ...] = tuple(INDEXES)) -> DataFrame:
    """(id, index_name, score): BM25 with any of the terms, the k best of each index and then of all by raw score.

    A quoted phrase must occur as written, in lower case, in one of the fields.
    """
    import re

    phrases = [p.lower() for p in re.findall(r'"([^"]+)"', query)]
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    out = None
    for name in indexes:
        types, fields = INDEXES[name]
        e = entities
        for p in phrases:
            e = e.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(f) for f in fields if f in entities.columns])), F.lit(p)))
        post = postings(e, name)
        stats = post.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
        hit = post.where(F.col("term").isin(*terms)) if terms else post.where(F.lit(False))
        df = hit.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        # df has at most one row per query term, the statistics have one row
        score = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(weight).alias("score"))
        top = score.orderBy(F.desc("score"), "id").limit(k).withColumn("index_name", F.lit(name))
        out = top if out is None else out.unionByName(top)
    return out.orderBy(F.desc("score"), "id").limit(k)


def rank_lists(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add rank: 1, 2, ... within each retriever's list, by score (null and NaN last), then entity_id."""
    s = F.when(~F.isnan("score"), F.col("score"))
    w = Window.partitionBy(*(keys or []), "source").orderBy(F.desc_nulls_last(s), "entity_id")
    return results.withColumn("rank", F.row_number().over(w))


def reciprocal_rank_fusion(ranked: DataFrame, links: DataFrame, k: int = RRF_K, keys: list[str] | None = None) -> DataFrame:
    """(keys, fusion_key, score, source_count, representative): sum of 1 / (k + rank) over all lists.

    Unresolved results count for their canonical, where there is one. source_count is the number of contributions.
    The representative is the best-ranked direct hit of the key itself, else the key.
    """
    keys = keys or []
    m = links.select(F.col("entity_id"), F.col("canonical_id").alias("_c"))
    r = ranked.join(m, "entity_id", "left").withColumn("fusion_key", F.when(F.col("target_resolution") == "unresolved", F.coalesce("_c", "entity_id")).otherwise(F.col("entity_id")))
    direct = F.when(F.col("entity_id") == F.col("fusion_key"), F.col("entity_id"))
    return r.groupBy(*keys, "fusion_key").agg(
        F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.count("*").alias("source_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.max(direct).alias("direct")
    ).withColumn("representative", F.coalesce("direct", "fusion_key")).drop("direct")


def neighbourhood(seed_id: str, context: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, truncated) for display: chunks left out, the first ``limit`` rows with the seed counted.

    limit is at least 1 and at most 500.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be in 1..500")
    rows = context.where("result_type <> 'Chunk'").orderBy(F.desc(F.col("confidence_method") == "graph_exact_match"), *graph_order()).limit(limit + 1)
    shown = rows.limit(limit)
    nodes = shown.select(F.col("entity_id").alias("id"), F.col("matched_text").alias("name"), F.col("node_type").alias("type"), "target_resolution")
    hop = shown.where("relationship_type IS NOT NULL")
    edges = hop.select(F.when(F.col("outgoing"), F.lit(seed_id)).otherwise(F.col("entity_id")).alias("source"), F.when(F.col("outgoing"), F.col("entity_id")).otherwise(F.lit(seed_id)).alias("target"), F.col("relationship_type").alias("type"))
    return nodes, edges, rows.agg((F.count("*") > limit).alias("truncated"))
