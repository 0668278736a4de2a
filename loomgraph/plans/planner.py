"""From a question to results: routing, retrieval, fusion. Control flow on the driver, data in lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import retrieve as R
from loomgraph.plans import classify as C
from loomgraph.plans import explain as E


@dataclass
class Graph:
    """The tables that retrieval reads, and the embedder of query texts (text to a list of numbers)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    entities: DataFrame
    links: DataFrame
    entity_vectors: DataFrame
    canonical_vectors: DataFrame
    chunk_vectors: DataFrame
    titles: DataFrame
    embed: Callable[[str], list[float]]


@dataclass
class Routing:
    category: str
    edge_types: list[str] | None
    retrievers: list[str] = field(default_factory=list)
    results: DataFrame | None = None


def hashed_embedder(dim: int) -> Callable[[str], list[float]]:
    """An embedder that needs no model: hashed letter trigrams with signs, of length 1."""
    import zlib

    def embed(text: str) -> list[float]:
        v = [0.0] * dim
        s = f"  {text.lower()} "
        for i in range(len(s) - 2):
            h = zlib.crc32(s[i : i + 3].encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / n for x in v]

    return embed


def embed_column(df: DataFrame, col: str, embed: Callable[[str], list[float]], out: str = "v") -> DataFrame:
    """Add the vectors of a text column; an embedder is loaded once per task. Null texts have null vectors."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else embed(t))

    return df.withColumn(out, run(F.col(col)))


def _vector(g: Graph, hits: DataFrame, passage: bool) -> DataFrame:
    names = (g.chunks.select("id", F.substring("content", 1, 200).alias("matched_text"), F.col("source_id"), F.col("chunk_index").cast("long").alias("chunk_index"))
             if passage else g.nodes.select("id", F.col("name").alias("matched_text"), F.col("type").alias("node_type"), "extraction_source"))
    h = hits if "target_resolution" in hits.columns else hits.withColumn("target_resolution", F.lit("unresolved"))
    kind = F.lit("Chunk") if passage else F.when(F.col("target_resolution") == "canonical", "Canonical").otherwise("Entity")
    method = "cosine_similarity_passage" if passage else "cosine_similarity_name"
    return R.as_results(h.join(names, "id").withColumn("entity_id", F.col("id")).withColumn("result_type", kind).withColumn("score", F.col("cosine")).withColumn("source", F.lit("vector")).withColumn("confidence_method", F.lit(method)))


def _keyword(g: Graph, question: str, k: int) -> DataFrame:
    hits = R.search_by_keyword(g.entities, question, k)
    e = g.nodes.select("id", F.col("name").alias("matched_text"), F.col("type").alias("node_type"), "extraction_source")
    return R.as_results(hits.join(e, "id").withColumn("entity_id", F.col("id")).withColumn("result_type", F.lit("Entity")).withColumn("source", F.lit("keyword")).withColumn("target_resolution", F.lit("unresolved")).withColumn("confidence_method", F.lit("lucene_relevance")))


def _ranked(df: DataFrame, order: list, k: int) -> DataFrame:
    # at most k rows reach the window
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def plan_and_retrieve(question: str, g: Graph, seed: str | None = None, k: int = 8) -> Routing:
    """Route a question and return ranked results. A graph question without a seed is an error."""
    category, fired = C.classify_one(question)
    types = C.edges_for(question)
    graph = lambda: _ranked(R.entity_context(seed, g.nodes, g.edges, g.chunks, types, C.seed_is_answer(types)), R.graph_order(), k)
    name = lambda: _vector(g, R.search_by_name(g.entity_vectors, g.canonical_vectors, g.embed(C.name_term(question)), k), False)
    passage = lambda: _vector(g, R.search_vectors(g.chunk_vectors, g.embed(question), k), True)
    best = [F.desc("score"), F.asc("entity_id")]
    if category == "graph":
        if seed is None:
            raise ValueError("a graph question needs a seed: entities are not linked from text")
        return Routing(category, types, ["graph"], graph())
    if category in ("vector_name", "vector_passage"):
        return Routing(category, None, ["vector"], _ranked(name() if category == "vector_name" else passage(), best, k))
    if category == "keyword":
        return Routing(category, None, ["keyword"], _ranked(_keyword(g, question, k), best, k))
    by_passage = "vector_passage" in fired or ("vector_name" not in fired and fired == {"graph"})
    lists = [_ranked(passage() if by_passage else name(), best, k), _ranked(_keyword(g, question, k), best, k)]
    used = ["vector", "keyword"]
    if seed is not None:
        lists.insert(0, graph())
        used.insert(0, "graph")
    pool = lists[0]
    for x in lists[1:]:
        pool = pool.unionByName(x)
    fused = R.reciprocal_rank_fusion(pool, g.links)
    rep = pool.groupBy("entity_id").agg(F.min_by(F.struct(*[c for c in (*R.RESULT, *R.META) if c not in ("entity_id", "score", "source", "confidence_method")]), "rank").alias("r"))
    named = fused.withColumnRenamed("representative", "entity_id").join(rep, "entity_id", "left").join(g.nodes.select(F.col("id").alias("entity_id"), "name"), "entity_id", "left")
    out = named.select(
        "entity_id", F.coalesce("r.result_type", F.lit("Canonical")).alias("result_type"), "score", F.lit("fusion").alias("source"), F.coalesce("r.matched_text", "name").alias("matched_text"),
        F.coalesce("r.target_resolution", F.lit("canonical")).alias("target_resolution"), F.lit("rrf_fused").alias("confidence_method"), "r.chunk_id", *[f"r.{c}" for c in R.META],
    )
    return Routing("hybrid", types if seed is not None else None, used, _ranked(out, best, k))


def answer(question: str, g: Graph, seed: str | None = None, k: int = 5, rank: int = 1) -> DataFrame:
    """The explained answer to a question, one row or none."""
    r = plan_and_retrieve(question, g, seed, k)
    return E.explained(question, r.category, r.edge_types, r.retrievers, r.results, r.results, g.titles, rank)


def entity_detail(node_id: str, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, type, name, aliases): a node and, for a canonical, its members with their decision; no row if unknown."""
    m = links.where(F.col("canonical_id") == node_id).join(nodes.select(F.col("id").alias("entity_id"), F.col("name").alias("alias")), "entity_id")
    a = m.groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "alias", "decision_action"))).alias("aliases"))
    return nodes.where(F.col("id") == node_id).join(a, "id", "left").select("id", "type", X_name(), "aliases")


def X_name():
    from loomgraph.functions.text import display_name

    return display_name("name").alias("name")
