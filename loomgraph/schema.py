"""Vocabularies, thresholds and table schemas of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Node types by base type.
BASE_TYPES = {
    "Resource": ("Document", "Paper", "Markdown", "Repository", "Website", "Chunk"),
    "CodeEntity": ("Module", "Class", "Function", "Interface", "Variable", "Type"),
    "KnowledgeEntity": ("Technology", "Language", "Framework", "API", "Dataset", "Organization", "Person"),
}
NODE_TYPES = {t: base for base, types in BASE_TYPES.items() for t in types}
# Edge types.
EDGE_TYPES = frozenset(
    "AUTHORED_BY PUBLISHED_BY AFFILIATED_WITH CITES MENTIONS DESCRIBES BUILT_BY CREATED_IN EXTENDS DEPENDS_ON DEFINED_IN CALLS IMPLEMENTS "
    "INHERITS_FROM USES_TECHNOLOGY USES_API REFERENCES CONTAINED_IN SIMILAR_TO ALTERNATIVE_TO EVALUATED_ON USES_DATASET PRODUCED_BY "
    "EXTRACTED_FROM HAS_CHUNK SAME_AS".split()
)
# Closed vocabularies of retrieval results and decisions.
RESULT_TYPES = ("Entity", "Canonical", "Chunk")
RETRIEVERS = ("graph", "vector", "keyword", "fusion")
RESOLUTIONS = ("canonical", "unresolved")
CONFIDENCE_LABELS = {
    "graph_exact_match": "Exact ID lookup",
    "graph_edge_confidence": "Graph relationship confidence",
    "graph_evidence_chunk": "Linked source passage",
    "cosine_similarity_name": "Name similarity (embedding)",
    "cosine_similarity_passage": "Passage similarity (embedding)",
    "lucene_relevance": "Keyword search relevance",
    "rrf_fused": "Combined ranking across retrievers",
}
ACTIONS = ("MERGE", "TENTATIVE", "NONE")
# Labels that a mention extractor keeps, their node types, id prefixes.
MENTION_LABELS = ("PERSON", "ORG", "GPE", "PRODUCT", "LANGUAGE", "WORK_OF_ART", "NORP", "FAC", "EVENT", "LAW")
LABEL_TYPES = {"PERSON": "Person", "ORG": "Organization", "PRODUCT": "Technology", "LANGUAGE": "Language"}
ID_PREFIXES = {"Person": "person", "Organization": "org", "Technology": "tech", "Language": "lang"}
SOURCE_KINDS = {"pdf": "paper", "md": "markdown", "github": "repo"}
# Thresholds.
STRING_THRESHOLD, EMBEDDING_THRESHOLD = 0.85, 0.90
MERGE_ABOVE, TENTATIVE_FROM, COHESION_FLOOR = 0.92, 0.70, 0.85
SHORT_NAME_TOKENS, LARGE_CLUSTER = 3, 5
CHUNK_TOKENS, CHUNK_OVERLAP, PASSAGE_TOKENS, PASSAGE_OVERLAP = 500, 50, 60, 15
BASE_CONFIDENCE, REPEAT_BONUS, MAX_CONFIDENCE = 0.6, 0.05, 0.95
METADATA_AUTHOR, BYLINE_AUTHOR = 0.98, 0.96
RRF_K, MAX_REPO_BYTES, MIN_LETTERS, VECTOR_DIM = 60, 200_000, 2, 384

ENTITY = (
    "id string, type string, name string, confidence double, extraction_source string, extraction_method string, mention_count long, "
    "doc_char_start long, doc_char_end long, source_file string, aliases array<string>, full_name string"
)
EDGE = (
    "source_id string, type string, target_id string, confidence double, extraction_source string, extraction_method string, frequency long, evidence string, evidence_chunk_id string"
)


def literal_map(d: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def base_type(col):
    """Base type of a node type; null for unknown types."""
    return literal_map(NODE_TYPES)[col]


def check_edge_types(types) -> list[str]:
    """The given edge types; an unknown one is an error."""
    bad = [t for t in types if t not in EDGE_TYPES]
    if bad:
        raise ValueError(f"unknown edge types: {bad}")
    return list(types)


def assert_flat(df) -> None:
    """Properties are scalars or lists of scalars: nested structs and maps can't be stored on a node or edge."""
    for f in df.schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
            raise ValueError(f"property {f.name} is nested")
