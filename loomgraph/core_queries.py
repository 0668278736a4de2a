"""One query per operator of the core, over the domain tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.core_oracles import oracles
from loomgraph.functions import similarity as S
from loomgraph.functions import text as X
from loomgraph.operators import aggregates as A
from loomgraph.operators import chunking, extract, quality, relate, resolve, retrieve, validate
from loomgraph.plans import classify, explain, planner
from loomgraph.runtime import shared_dir, table
from loomgraph.schema import base_type
from loomgraph.sources import files, graph, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------ shared inputs

ENTITY = ["type", "base_type", "name", "confidence", "extraction_source", "extraction_method", "mention_count", "doc_char_start", "doc_char_end", "source_file", "full_name", "description", "ingested_at"]
E_SQL = "e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
D_SQL = "d AS (SELECT DISTINCT action, confidence, canonical_id, canonical_name, entity_type, source_ids FROM resolution_decisions)"
L_SQL = """l AS (SELECT entity_id, min({'c': canonical_id, 'a': action}) AS m FROM (SELECT canonical_id, action, unnest(source_ids) AS entity_id FROM resolution_decisions
  WHERE action IN ('MERGE', 'TENTATIVE')) WHERE entity_id IS NOT NULL GROUP BY entity_id)"""
P_SQL = """p AS (SELECT least(trim(id_a, w), trim(id_b, w)) AS a, greatest(trim(id_a, w), trim(id_b, w)) AS b, score, type, matched_by FROM candidate_pairs, (SELECT ' ' || chr(9) || chr(10) || chr(13) || chr(160) AS w)
  WHERE score IS NOT NULL AND NOT isnan(score) AND trim(id_a, w) <> trim(id_b, w)
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, scored_at, id_a, name_a, name_b) = 1)"""
C_SQL = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
M_SQL = """m AS (SELECT CASE split_part(extraction_source, ':', 1) WHEN 'pdf' THEN 'paper_' WHEN 'md' THEN 'markdown_' ELSE 'repo_' END
  || trim(regexp_replace(lower(regexp_replace(extraction_source, '^[^:]*:', '')), '[^a-z0-9]+', '_', 'g'), '_') AS source_id, coalesce(l.m.c, e.id) AS target_id, e.id, e.confidence, e.mention_count, e.extraction_source
  FROM e LEFT JOIN l ON l.entity_id = e.id WHERE split_part(extraction_source, ':', 1) IN ('pdf', 'md', 'github')
  QUALIFY row_number() OVER (PARTITION BY source_id, coalesce(l.m.c, e.id) ORDER BY e.id) = 1)"""
NORM = (
    "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace({0}, chr(160), ' '))), '[''’]s\\b', '', 'g'), "
    "'^\\s*(?:(?:the|an?)\\s+)+', ''), '[^\\pL\\pN\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(?: (?:inc|ltd|llc|co))+$', '')"
)


def entities(s: SparkSession, d: str) -> DataFrame:
    return resolve.first_deliveries(table(s, d, "entities"), keep=ENTITY)


def decisions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "resolution_decisions").select("action", "confidence", "canonical_id", "canonical_name", "entity_type", "source_ids").distinct()


def links(s: SparkSession, d: str) -> DataFrame:
    return relate.same_as(decisions(s, d))


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Candidate pairs once each: trimmed ids, id_a < id_b, the best score."""
    p = table(s, d, "candidate_pairs").withColumn("ia", F.btrim("id_a", F.lit(" \t\n\r\u00a0"))).withColumn("ib", F.btrim("id_b", F.lit(" \t\n\r\u00a0"))).where("score IS NOT NULL AND NOT isnan(score) AND ia <> ib")
    flip = F.col("ia") > F.col("ib")
    q = p.select(
        F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.when(flip, F.col("name_b")).otherwise(F.col("name_a")).alias("na"), F.when(flip, F.col("name_a")).otherwise(F.col("name_b")).alias("nb"),
        "type", "score", "cross_source", "matched_by", "matcher", "scored_at", "id_a", "name_a", "name_b",
    )
    w = Window.partitionBy("a", "b").orderBy(F.desc("score"), "scored_at", "id_a", "name_a", "name_b")
    q = q.withColumn("k", F.row_number().over(w)).where("k = 1")
    return q.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("na").alias("name_a"), F.col("nb").alias("name_b"), "type", "score", "cross_source", "matched_by", "matcher")


def chunks(s: SparkSession, d: str) -> DataFrame:
    return resolve.first_deliveries(table(s, d, "chunks"), order="created_at", keep=["source_id", "source_file", "chunk_index", "content", "char_start", "char_end", "created_at"])


def papers(s: SparkSession, d: str) -> DataFrame:
    return resolve.first_deliveries(table(s, d, "pdf_metadata"), "paper_id", keep=["title", "authors", "text", "extraction_source", "file_hash", "ingested_at"])


def mentions(s: SparkSession, d: str) -> DataFrame:
    return relate.resolve_mentions(entities(s, d), links(s, d))


def nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.node_table(entities(s, d), decisions(s, d))


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


# ------------------------------------------------------------------------------------------------ sources


@query("SELECT markdown_id, sha256(text) AS hash FROM markdown_docs WHERE text IS NOT NULL")
def s2_file_hash(s, d):
    return table(s, d, "markdown_docs").where("text IS NOT NULL").select("markdown_id", files.file_hash("text").alias("hash"))


@query("SELECT markdown_id, ingested_at, nullif(trim(regexp_extract(text, '(?m)^#{1,6}\\s+(.+)$', 1)), '') AS heading FROM markdown_docs WHERE text IS NOT NULL")
def s3_first_heading(s, d):
    h = F.nullif(F.trim(F.regexp_extract("text", files._TITLE, 1)), F.lit(""))
    return table(s, d, "markdown_docs").where("text IS NOT NULL").select("markdown_id", "ingested_at", h.alias("heading"))


@query("""SELECT repo_name, path, octet_length(encode(text)) AS length FROM repo_documents
WHERE regexp_matches(lower(path), '\\.(md|rst)$') AND octet_length(encode(text)) <= 200000 AND NOT regexp_matches(path, '(?:^|/)(?:\\.git|node_modules|\\.venv|venv)/')""")
def s4_wanted_documents(s, d):
    return files.wanted_documents(table(s, d, "repo_documents").select("repo_name", "path", F.octet_length("text").cast("long").alias("length")))


@query(f"WITH {E_SQL} SELECT id, type, name FROM e WHERE type <> 'Chunk'")
def s6_node_scan(s, d):
    return resolve.resolvable(entities(s, d)).select("id", "type", "name")


@query(f"""WITH {E_SQL}, {L_SQL} SELECT l.m.c AS canonical_id, string_agg(e.id || '/' || e.name || '/' || l.m.a, '; ' ORDER BY e.id) AS aliases FROM l JOIN e ON e.id = l.entity_id GROUP BY 1""")
def s7_detail_aliases(s, d):
    j = links(s, d).join(entities(s, d).select(F.col("id").alias("entity_id"), "name"), "entity_id")
    line = F.concat_ws("/", "entity_id", "name", "decision_action")
    return j.groupBy("canonical_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", line.alias("x")))), lambda r: r["x"]), "; ").alias("aliases"))


@query("""SELECT DISTINCT paper_id AS id, title FROM pdf_metadata WHERE title IS NOT NULL AND title <> '' AND paper_id IN (SELECT source_id FROM chunks)""")
def s8_source_titles(s, d):
    p = table(s, d, "pdf_metadata").select(F.col("paper_id").alias("id"), "title", F.lit(None).cast("string").alias("name"))
    return graph.source_titles(p, table(s, d, "chunks").select(F.col("source_id").alias("id")))


@query("SELECT type, count(*) AS n FROM entities WHERE confidence >= 0.9 GROUP BY type")
def s9_sql_with_parameters(s, d):
    return graph.run_query(s, "SELECT type, count(*) AS n FROM ent WHERE confidence >= :least GROUP BY type", {"ent": table(s, d, "entities")}, {"least": 0.9})


# ------------------------------------------------------------------------------------------------ sinks


@query(f"""WITH {E_SQL}, n AS (SELECT id, upper(name) AS name FROM e WHERE confidence > 0.9), o AS (SELECT id, name FROM e WHERE confidence <= 0.95 OR confidence IS NULL)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def k2_upsert_nodes(s, d):
    e = entities(s, d)
    return sinks.upsert(e.where("confidence <= 0.95 OR confidence IS NULL").select("id", "name"), e.where("confidence > 0.9").select("id", F.upper("name").alias("name")), ["id"])


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, x AS (SELECT id FROM e WHERE type = 'Person' UNION SELECT source_id FROM m)
SELECT source_id, target_id FROM m WHERE source_id IN (SELECT id FROM x) AND target_id IN (SELECT id FROM x)""")
def k4_create_edges(s, d):
    m = mentions(s, d)
    live = entities(s, d).where("type = 'Person'").select("id").unionByName(m.select(F.col("source_id").alias("id")))
    return sinks.create_edges(live, m).select("source_id", "target_id")


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL} SELECT source_id, 'MENTIONS' AS type, target_id, CASE WHEN confidence > 0.8 THEN 100 + mention_count ELSE mention_count END AS frequency FROM m""")
def k5_merge_edges(s, d):
    m = mentions(s, d).select("source_id", "type", "target_id", "frequency", "confidence")
    new = m.where("confidence > 0.8").withColumn("frequency", F.col("frequency") + 100)
    return sinks.merge_edges(m, new).select("source_id", "type", "target_id", "frequency")


@query(f"""WITH {D_SQL} SELECT canonical_id AS id, min(entity_type) AS type, max(len(list_distinct(source_ids))) AS source_count FROM d WHERE action IN ('MERGE', 'TENTATIVE') GROUP BY 1""")
def k6_canonical_rows(s, d):
    c = sinks.canonical_rows(decisions(s, d), 0)
    return c.groupBy("id").agg(F.min("type").alias("type"), F.max("source_count").cast("long").alias("source_count"))


@query(f"""WITH {E_SQL}, {D_SQL} SELECT DISTINCT canonical_id AS source_id, 'SAME_AS' AS type, target_id, action AS decision_action FROM (SELECT canonical_id, action, unnest(source_ids) AS target_id FROM d WHERE action IN ('MERGE', 'TENTATIVE'))
WHERE target_id IN (SELECT id FROM e)""")
def k6_same_as_rows(s, d):
    return sinks.same_as_rows(decisions(s, d), entities(s, d), 0).select("source_id", "type", "target_id", "decision_action")


@query()
def k7_set_vectors(s, d):
    e = table(s, d, "entities").where("name_embedding IS NOT NULL").select("id", F.col("name_embedding").alias("v")).dropDuplicates(["id"])
    return sinks.set_vectors(entities(s, d).select("id", "name"), e, "name_embedding").select("id", F.size("name_embedding").alias("dim"))


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, {C_SQL},
h AS (SELECT e.id, arg_min(c.id, {{'i': c.chunk_index, 'c': c.id}}) AS chunk FROM e JOIN c ON c.source_file = e.source_file AND c.char_start <= e.doc_char_start AND e.doc_char_start < c.char_end GROUP BY 1)
SELECT source_id, target_id, h.chunk AS evidence_chunk_id FROM m LEFT JOIN h ON h.id = m.id""")
def k8_enrich_evidence(s, d):
    e, lk = entities(s, d), links(s, d)
    m = relate.resolve_mentions(e, lk)
    own = relate.resolve_targets(relate.extract_mentions(e).withColumn("entity_id", F.col("target_id")), lk)
    first = own.groupBy("source_id", "type", "target_id").agg(F.min("entity_id").alias("id"))
    enr = first.join(relate.mention_chunks(e, chunks(s, d)), "id").select("source_id", "type", "target_id", "chunk_id")
    return relate.enrich_evidence(m, enr).select("source_id", "target_id", "evidence_chunk_id")


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, g AS (SELECT id FROM e WHERE extraction_source = 'web:community_wiki_dump')
SELECT (SELECT count(*) FROM g) AS removed, (SELECT count(*) FROM e WHERE extraction_source <> 'web:community_wiki_dump' OR extraction_source IS NULL) AS kept,
(SELECT count(*) FROM m WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)) AS edges""")
def k12_clear_source(s, d):
    kept, e, gone = sinks.clear_source(entities(s, d), mentions(s, d), "web:community_wiki_dump")
    return gone.crossJoin(kept.agg(F.count("*").alias("kept"))).crossJoin(e.agg(F.count("*").alias("edges")))  # one row each


# ------------------------------------------------------------------------------------------------ projections, predicates


@query(f"WITH {E_SQL} SELECT id FROM e WHERE length(regexp_replace(name, '[^A-Za-z]', '', 'g')) >= 2 AND NOT regexp_matches(lower(trim(name)), '^(http|www\\.)') AND type IN ('Person', 'Organization', 'Technology', 'Language')")
def pr1_kept_mentions(s, d):
    label = F.when(F.col("type") == "Person", "PERSON").when(F.col("type") == "Organization", "ORG").when(F.col("type") == "Technology", "PRODUCT").when(F.col("type") == "Language", "LANGUAGE").otherwise("OTHER")
    return extract.kept_mentions(entities(s, d).select("id", F.col("name").alias("text"), label.alias("label"))).select("id")


@query(f"WITH {P_SQL} SELECT a AS id_a, b AS id_b, CASE WHEN list_contains(matched_by, 'embedding_similarity') THEN 'TENTATIVE' WHEN score > 0.92 THEN 'MERGE' WHEN score >= 0.70 THEN 'TENTATIVE' ELSE 'NONE' END AS action FROM p")
def pr6_grade_pairs(s, d):
    return resolve.grade(pairs(s, d)).select("id_a", "id_b", "action")


@query(f"WITH {E_SQL}, n AS (SELECT id, string_split({NORM.format('name')}, ' ') AS t FROM e WHERE name IS NOT NULL) SELECT id, len(t) <= 3 OR len(list_filter(t, lambda x: length(x) <> 1)) = 0 AS risky FROM n")
def pr7_risky_names(s, d):
    return entities(s, d).where("name IS NOT NULL").select("id", X.is_risky(X.normalized("name")).alias("risky"))


@query(f"WITH {C_SQL} SELECT id, substr(content, 1, 200) AS preview FROM c")
def pr11_previews(s, d):
    return chunks(s, d).select("id", F.substring("content", 1, 200).alias("preview"))


@query(f"WITH {E_SQL} SELECT id, coalesce(nullif(full_name, ''), nullif(name, ''), '') AS shown FROM e")
def pr12_display_names(s, d):
    return entities(s, d).select("id", X.display_name("full_name", "name").alias("shown"))


@query(f"WITH {E_SQL} SELECT type, CASE WHEN type IN ('Technology', 'Language', 'Framework', 'API', 'Dataset', 'Organization', 'Person') THEN 'KnowledgeEntity' END AS base, count(*) AS n FROM e GROUP BY ALL")
def f27_base_types(s, d):
    return entities(s, d).groupBy("type", base_type(F.col("type")).alias("base")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------ text functions


@query("SELECT doc_id AS id, len(regexp_extract_all(text, '[^\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{000B}]+')) AS tokens FROM documents WHERE text IS NOT NULL")
def f1_token_counts(s, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), F.lit(1)))
    return docs(s, d).where("text IS NOT NULL").select("id", n.cast("long").alias("tokens"))


@query("""WITH t AS (SELECT doc_id AS id, len(regexp_extract_all(text, '[^\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{000B}]+')) AS n FROM documents WHERE text IS NOT NULL)
SELECT id, CASE WHEN n <= 60 THEN 1 ELSE ceil((n - 60) / 45.0) + 1 END::BIGINT AS chunks FROM t WHERE n > 0""")
def f2_passages_per_document(s, d):
    return chunking.passages(docs(s, d)).groupBy("id").agg(F.count("*").alias("chunks"))


@query()
def f3_chunk_pages(s, d):
    c = chunking.chunk_texts(papers(s, d).select(F.col("paper_id").alias("id"), "text"))
    return c.select("id", "chunk_index", "char_start", "char_end", F.array_join(F.col("page_markers").cast("array<string>"), ",").alias("pages"))


@query()
def f5_clean_markdown(s, d):
    return table(s, d, "markdown_docs").where("text IS NOT NULL").select("markdown_id", X.clean_markdown("text").alias("clean"))


@query(f"WITH {E_SQL} SELECT id, coalesce(nullif(trim(regexp_replace(lower(trim(regexp_replace(replace(name, chr(160), ' '), '\\s+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS slug FROM e WHERE name IS NOT NULL")
def f6_slugs(s, d):
    return entities(s, d).where("name IS NOT NULL").select("id", X.entity_slug("name").alias("slug"))


@query("""SELECT DISTINCT extraction_source, CASE split_part(extraction_source, ':', 1) WHEN 'pdf' THEN 'paper_' WHEN 'md' THEN 'markdown_' WHEN 'github' THEN 'repo_' END
  || trim(regexp_replace(lower(regexp_replace(extraction_source, '^[^:]*:', '')), '[^a-z0-9]+', '_', 'g'), '_') AS node FROM entities WHERE extraction_source IS NOT NULL""")
def f7_source_nodes(s, d):
    return table(s, d, "entities").where("extraction_source IS NOT NULL").select("extraction_source", X.source_node_id("extraction_source").alias("node")).distinct()


@query(f"SELECT DISTINCT name, {NORM.format('name')} AS norm FROM entities WHERE name IS NOT NULL")
def f8_normalized_names(s, d):
    return resolve.normalized_names(table(s, d, "entities"))


@query(f"""WITH n AS (SELECT DISTINCT {NORM.format('name')} AS norm FROM entities WHERE name IS NOT NULL), t AS (SELECT norm, string_split(norm, ' ') AS t FROM n WHERE norm <> ''),
u AS (SELECT norm, t, list_filter(t, lambda x: length(x) > 1) AS g FROM t) SELECT norm, CASE WHEN len(g) >= 2 AND len(g) < len(t) THEN norm || '|' || array_to_string(g, ' ') ELSE norm END AS forms FROM u""")
def f9_name_forms(s, d):
    n = resolve.normalized_names(table(s, d, "entities")).select("norm").where("norm <> ''").distinct()
    return n.select("norm", F.array_join(X.name_forms(F.col("norm")), "|").alias("forms"))


@query(f"""WITH n AS (SELECT DISTINCT {NORM.format('name')} AS norm FROM entities WHERE name IS NOT NULL), t AS (SELECT norm, string_split(norm, ' ') AS t FROM n WHERE norm <> '')
SELECT norm, t[1] AS first_token, t[-1] AS last_token, array_to_string(list_sort(list_transform(t, lambda x: substr(x, 1, 1))), '') AS initials FROM t""")
def f10_block_keys(s, d):
    n = resolve.normalized_names(table(s, d, "entities")).select("norm").where("norm <> ''").distinct()
    k = X.block_keys(F.col("norm"))
    return n.select("norm", F.get(k, F.lit(0))["value"].alias("first_token"), F.get(k, F.lit(1))["value"].alias("last_token"), F.get(k, F.lit(2))["value"].alias("initials"))


@query()
def f11_similarity(s, d):
    p = pairs(s, d).select("id_a", "id_b", X.normalized("name_a").alias("a"), X.normalized("name_b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return p.select("id_a", "id_b", S.string_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"""WITH n AS (SELECT DISTINCT name, string_split({NORM.format('name')}, ' ') AS t FROM entities WHERE name IS NOT NULL)
SELECT name, len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1])) > 0 OR (len(t) >= 2 AND len(t) % 2 = 0 AND t[1:len(t) // 2] = t[len(t) // 2 + 1:]) AS stutter FROM n""")
def f16_stutter(s, d):
    return resolve.normalized_names(table(s, d, "entities")).select("name", X.has_stutter(F.col("norm")).alias("stutter"))


@query(f"""WITH {E_SQL}, q AS (SELECT id, split_part(id, '_', 1) || '_' || coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS base FROM e WHERE name IS NOT NULL),
r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM q) SELECT id, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS canonical_id FROM r""")
def f17_canonical_ids(s, d):
    e = entities(s, d).where("name IS NOT NULL").select("id", F.concat(F.substring_index("id", "_", 1), F.lit("_"), X.slug("name")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return e.withColumn("k", k).select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"))).alias("canonical_id"))


@query(f"""WITH {P_SQL}, v AS (SELECT id, any_value(name_embedding) AS v FROM entities WHERE name_embedding IS NOT NULL GROUP BY id)
SELECT a AS id_a, b AS id_b, round(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 6) AS cosine FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b
WHERE list_sum(list_transform(x.v, lambda q: abs(q))) > 0 AND list_sum(list_transform(y.v, lambda q: abs(q))) > 0""")
def j4_pair_cosines(s, d):
    v = table(s, d, "entities").where("name_embedding IS NOT NULL").select("id", "name_embedding").dropDuplicates(["id"])
    a, b = v.select(F.col("id").alias("id_a"), F.col("name_embedding").alias("va")), v.select(F.col("id").alias("id_b"), F.col("name_embedding").alias("vb"))
    j = pairs(s, d).select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    return j.select("id_a", "id_b", F.round(S.cosine(F.col("va"), F.col("vb")), 6).alias("cosine")).where("cosine IS NOT NULL")


# ------------------------------------------------------------------------------------------------ joins

_BLOCKS_SQL = f"""{E_SQL}, n AS (SELECT id, type, {NORM.format('name')} AS norm FROM e WHERE type <> 'Person' AND name IS NOT NULL), t AS (SELECT id, type, norm, string_split(norm, ' ') AS t FROM n WHERE norm <> ''),
g AS (SELECT *, list_filter(t, lambda x: length(x) > 1) AS g FROM t), fm AS (SELECT id, type, unnest(CASE WHEN len(g) >= 2 AND len(g) < len(t) THEN [t, g] ELSE [t] END) AS t FROM g),
bk AS (SELECT DISTINCT id, type, k.kind AS kind, k.value AS value FROM (SELECT id, type, unnest([{{'kind': 'first_token', 'value': t[1]}}, {{'kind': 'last_token', 'value': t[-1]}},
  {{'kind': 'initials', 'value': array_to_string(list_sort(list_transform(t, lambda x: substr(x, 1, 1))), '')}}]) AS k FROM fm))"""


def _blocks(s, d):
    """Blocks of the entities that the SQL covers: all but persons."""
    return resolve.block_members(entities(s, d).where("type <> 'Person'"))


def _all_blocks(s, d):
    return resolve.block_members(entities(s, d))


@query(f"WITH {_BLOCKS_SQL} SELECT x.id AS id_a, y.id AS id_b, array_to_string(list_sort(list(DISTINCT x.kind)), ',') AS kinds FROM bk x JOIN bk y USING (type, kind, value) WHERE x.id < y.id GROUP BY 1, 2")
def j1_blocked_pairs(s, d):
    return resolve.blocked_pairs(_blocks(s, d)).select("id_a", "id_b", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {_BLOCKS_SQL}, {P_SQL}, q AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM bk x JOIN bk y USING (type, kind, value) WHERE x.id < y.id)
SELECT id_a, id_b FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = q.id_a AND p.b = q.id_b)""")
def j3_unscored_pairs(s, d):
    return resolve.unscored_pairs(_blocks(s, d), pairs(s, d))


@query()
def j1_all_blocked_pairs(s, d):
    """j1_blocked_pairs over the whole table, persons included."""
    return resolve.blocked_pairs(_all_blocks(s, d)).select("id_a", "id_b", F.array_join("kinds", ",").alias("kinds"))


@query()
def j3_all_unscored_pairs(s, d):
    """j3_unscored_pairs over the whole table, persons included."""
    return resolve.unscored_pairs(_all_blocks(s, d), pairs(s, d))


@query(f"WITH {E_SQL}, {L_SQL} SELECT e.id AS id, coalesce(l.m.c, e.id) AS target_id FROM e LEFT JOIN l ON l.entity_id = e.id")
def j5_resolve_targets(s, d):
    return relate.resolve_targets(entities(s, d).select("id", F.col("id").alias("target_id")), links(s, d)).select("id", "target_id")


@query(f"WITH {E_SQL}, {L_SQL} SELECT extraction_source, coalesce(l.m.c, e.id) AS target_id, min(e.id) AS entity_id FROM e LEFT JOIN l ON l.entity_id = e.id GROUP BY 1, 2")
def j6_first_by_target(s, d):
    return relate.first_by_target(entities(s, d), links(s, d))


@query(f"""WITH {E_SQL}, {C_SQL} SELECT e.id, arg_min(c.id, {{'i': c.chunk_index, 'c': c.id}}) AS chunk_id FROM e JOIN c ON c.source_file = e.source_file AND c.char_start <= e.doc_char_start AND e.doc_char_start < c.char_end GROUP BY 1""")
def j8_mention_chunks(s, d):
    return relate.mention_chunks(entities(s, d), chunks(s, d))


@query(f"WITH {E_SQL} SELECT lower(x.name) AS name, x.id AS id_a, y.id AS id_b FROM e x JOIN e y ON lower(x.name) = lower(y.name) WHERE x.extraction_source LIKE 'pdf:%' AND y.extraction_source LIKE 'github:%'")
def j15_shared_names(s, d):
    return A.shared_names(entities(s, d), "pdf:", "github:")


def _authored(s, d):
    a = papers(s, d).select(F.col("paper_id").alias("source_id"), F.explode("authors").alias("n")).where("n IS NOT NULL")
    return a.select("source_id", F.lit("AUTHORED_BY").alias("type"), X.entity_slug("n").alias("target_id"))


_AUTH_SQL = """ap AS (SELECT * FROM pdf_metadata QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) = 1),
au AS (SELECT paper_id AS source_id, coalesce(nullif(trim(regexp_replace(lower(trim(regexp_replace(replace(n, chr(160), ' '), '\\s+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS target_id FROM (SELECT paper_id, unnest(authors) AS n FROM ap) WHERE n IS NOT NULL)"""


@query(f"WITH {_AUTH_SQL}, u AS (SELECT DISTINCT * FROM au) SELECT x.target_id AS person_a, y.target_id AS person_b, count(*) AS papers FROM u x JOIN u y USING (source_id) WHERE x.target_id < y.target_id GROUP BY 1, 2")
def j16_coauthors(s, d):
    return A.coauthors(_authored(s, d))


# ------------------------------------------------------------------------------------------------ aggregates

_MEN_SQL = """mm AS (SELECT extraction_source, CASE type WHEN 'Person' THEN 'Person' WHEN 'Organization' THEN 'Organization' ELSE NULL END AS type, trim(regexp_replace(replace(name, chr(160), ' '), '\\s+', ' ', 'g')) AS form, doc_char_start, source_file, {'i': id, 't': ingested_at} AS ord FROM entities WHERE name IS NOT NULL AND extraction_source IS NOT NULL),
ms AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(form), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed') AS slug FROM mm WHERE type IS NOT NULL),
fc AS (SELECT extraction_source, type, slug, form, count(*) AS n, min(ord) AS o, arg_min(doc_char_start, ord) AS st FROM ms GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY extraction_source, type, slug ORDER BY n DESC, o) AS r FROM fc)"""


@query(f"""WITH {_MEN_SQL} SELECT extraction_source, type, max(form) FILTER (WHERE r = 1) AS name, coalesce(string_agg(form, '|' ORDER BY form) FILTER (WHERE r > 1), '') AS aliases, sum(n)::BIGINT AS mention_count,
arg_min(st, o) AS doc_char_start, round(least(0.95, 0.6 + 0.05 * (sum(n) - 1))::DOUBLE, 6) AS confidence FROM fr GROUP BY extraction_source, type, slug""")
def a1_collapse_mentions(s, d):
    label = F.when(F.col("type") == "Person", "PERSON").when(F.col("type") == "Organization", "ORG").otherwise("GPE")
    m = table(s, d, "entities").where("name IS NOT NULL AND extraction_source IS NOT NULL").select("extraction_source", F.col("name").alias("text"), label.alias("label"), "doc_char_start", "doc_char_end", "source_file", F.struct("id", "ingested_at").alias("ord"))
    return extract.collapse_mentions(m).select("extraction_source", "type", "name", F.array_join("aliases", "|").alias("aliases"), "mention_count", "doc_char_start", F.round("confidence", 6).alias("confidence"))


@query("SELECT 'GPE' AS label, count(*) AS n FROM entities WHERE type NOT IN ('Person', 'Organization') AND length(regexp_replace(name, '[^A-Za-z]', '', 'g')) >= 2")
def a2_skipped_labels(s, d):
    label = F.when(F.col("type") == "Person", "PERSON").when(F.col("type") == "Organization", "ORG").otherwise("GPE")
    return extract.skipped_labels(table(s, d, "entities").select(F.col("name").alias("text"), label.alias("label")))


@query(f"""WITH {_BLOCKS_SQL}, z AS (SELECT count(*) AS s FROM bk GROUP BY type, kind, value)
SELECT count(*) AS blocks, max(s) AS largest, round_even(avg(s), 2) AS average, count(*) FILTER (WHERE s = 1) AS singletons, sum(s * (s - 1) / 2)::BIGINT AS slots,
(SELECT count(*) FROM (SELECT DISTINCT x.id, y.id AS id2 FROM bk x JOIN bk y USING (type, kind, value) WHERE x.id < y.id)) AS unique_pairs FROM z""")
def a3_block_statistics(s, d):
    return resolve.block_statistics(_blocks(s, d))


@query()
def a3_all_block_statistics(s, d):
    """a3_block_statistics over the whole table, persons included."""
    return resolve.block_statistics(_all_blocks(s, d))


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL} SELECT target_id AS canonical_id, count(DISTINCT source_id) AS mention_count FROM m WHERE target_id IN (SELECT canonical_id FROM resolution_decisions WHERE action IN ('MERGE', 'TENTATIVE'))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a4_most_mentioned(s, d):
    return A.most_mentioned(mentions(s, d), sinks.canonical_rows(decisions(s, d), 0))


@query(f"WITH {L_SQL} SELECT m.c AS canonical_id, count(*) AS alias_count FROM l GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10")
def a5_by_alias_count(s, d):
    return A.by_alias_count(links(s, d))


@query(f"WITH {E_SQL}, {L_SQL}, {M_SQL} SELECT count(*) AS edge_count, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM m")
def a6_edge_statistics(s, d):
    return A.edge_statistics(mentions(s, d), "MENTIONS").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {E_SQL} SELECT type, split_part(extraction_source, ':', 1) AS source_kind, count(*) AS n FROM e GROUP BY 1, 2")
def a7_counts(s, d):
    return A.counts_by(entities(s, d).withColumn("source_kind", F.substring_index("extraction_source", ":", 1)), "type", "source_kind")


@query(f"WITH {E_SQL} SELECT lower(name) AS name, array_to_string(list_sort(list(DISTINCT extraction_source)), ',') AS sources, count(DISTINCT extraction_source)::INT AS n_sources, max(confidence) AS confidence FROM e WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT extraction_source) >= 2")
def a8_names_across_sources(s, d):
    return A.names_across_sources(entities(s, d)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_AUTH_SQL} SELECT source_id, string_agg(target_id, ',' ORDER BY target_id) AS authors FROM au GROUP BY 1")
def a9_author_lists(s, d):
    a = _authored(s, d)
    names = a.select(F.col("target_id").alias("id"), F.col("target_id").alias("name")).distinct()
    return A.author_lists(a, names).withColumn("authors", F.array_join("authors", ","))


@query()
def a10_decisions(s, d):
    return resolve.decide(pairs(s, d)).select("action", "confidence", "canonical_id", "canonical_name", "entity_type", F.array_join("source_ids", ",").alias("members"))


@query(f"""WITH RECURSIVE {P_SQL}, u AS (SELECT a, b FROM p WHERE score >= 0.9 UNION SELECT b, a FROM p WHERE score >= 0.9),
r AS (SELECT a AS id, a AS r FROM u UNION SELECT u.b, r.r FROM r JOIN u ON u.a = r.id) SELECT id, min(r) AS component FROM r GROUP BY 1""")
def a11_connected(s, d):
    return resolve.connected(pairs(s, d).where("score >= 0.9").select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))


@query()
def a12_cohesive_groups(s, d):
    g = resolve.cohesive_groups(pairs(s, d))
    return g.select("id", F.min("id").over(Window.partitionBy("grp")).alias("group_id"))


_RR_SQL = """rr AS (SELECT query_id, source, entity_id, max(CASE WHEN NOT isnan(score) THEN score END) AS score, any_value(target_resolution) AS tr FROM retrieval_results WHERE entity_id IS NOT NULL GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC NULLS LAST, entity_id) AS rank FROM rr)"""


def _lists(s, d):
    r = table(s, d, "retrieval_results").where("entity_id IS NOT NULL")
    ok = F.when(~F.isnan("score"), F.col("score"))
    one = r.groupBy("query_id", "source", "entity_id").agg(F.max(ok).alias("score"), F.first("target_resolution").alias("target_resolution"))
    return retrieve.rank_lists(one, ["query_id"])


@query(f"""WITH {L_SQL}, {_RR_SQL}, k AS (SELECT query_id, source, entity_id, rank, CASE WHEN tr = 'unresolved' THEN coalesce(l.m.c, rk.entity_id) ELSE rk.entity_id END AS fusion_key FROM rk LEFT JOIN l USING (entity_id))
SELECT query_id, fusion_key, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS source_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY 1, 2""")
def a13_rank_fusion(s, d):
    f = retrieve.reciprocal_rank_fusion(_lists(s, d), links(s, d), keys=["query_id"])
    return f.select("query_id", "fusion_key", F.round("score", 9).alias("score"), "source_count", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {E_SQL}, {D_SQL}, {P_SQL}, mb AS (SELECT DISTINCT canonical_id, unnest(source_ids) AS id FROM d WHERE action <> 'NONE'),
g AS (SELECT canonical_id, count(DISTINCT mb.id) AS n, count(DISTINCT e.extraction_source) AS k FROM mb LEFT JOIN e ON e.id = mb.id GROUP BY 1),
o AS (SELECT unnest([a, b]) AS id FROM p WHERE score >= 0.70)
SELECT sum(n)::BIGINT AS members, count(*) AS canonicals, round_even(100 * (1 - count(*) / sum(n)), 4) AS reduction_percent, round_even(sum(n) / count(*), 4) AS mean_aliases, count(*) FILTER (WHERE k > 1) AS cross_source,
(SELECT count(DISTINCT id) FROM o WHERE id NOT IN (SELECT id FROM mb WHERE id IS NOT NULL)) AS orphans FROM g""")
def a14_resolution_metrics(s, d):
    return A.resolution_metrics(decisions(s, d), pairs(s, d), entities(s, d))


@query(f"WITH {P_SQL} SELECT floor(score * 20) / 20 AS bucket, count(*) AS n FROM p GROUP BY 1")
def a16_score_histogram(s, d):
    return A.score_histogram(pairs(s, d))


@query(f"WITH {D_SQL} SELECT len(source_ids)::INT AS cluster_size, count(*) AS n FROM d WHERE action <> 'NONE' GROUP BY 1")
def a14_size_histogram(s, d):
    return A.size_histogram(decisions(s, d))


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, a AS (SELECT DISTINCT target_id FROM m), x AS (SELECT coalesce(l.entity_id, a.target_id) AS t FROM a LEFT JOIN l ON l.m.c = a.target_id)
SELECT (SELECT count(*) FROM a) AS canonical_aware, (SELECT count(DISTINCT t) FROM x) AS naive""")
def a17_distinct_targets(s, d):
    return A.distinct_authors(mentions(s, d).withColumn("type", F.lit("AUTHORED_BY")), links(s, d))


# ------------------------------------------------------------------------------------------------ order, set operations


@query(f"WITH {P_SQL} SELECT a AS id_a, b AS id_b, score FROM p ORDER BY score DESC, a, b LIMIT 50")
def o1_best_pairs(s, d):
    return pairs(s, d).select("id_a", "id_b", "score").orderBy(F.desc("score"), "id_a", "id_b").limit(50)


@query(f"WITH {D_SQL} SELECT canonical_id, action, len(source_ids)::INT AS cluster_size, action = 'TENTATIVE' AND len(source_ids) >= 5 AS priority_review FROM d WHERE action <> 'NONE'")
def o3_review_queue(s, d):
    r = resolve.reviewed(decisions(s, d)).where("action <> 'NONE'")
    return r.orderBy(F.desc("priority_review"), F.desc("cluster_size"), "action", F.desc("confidence"), "canonical_id").select("canonical_id", "action", "cluster_size", "priority_review")


@query(f"WITH {P_SQL} SELECT a AS id_a, b AS id_b, CASE WHEN list_contains(matched_by, 'embedding_similarity') THEN 'embedding' ELSE 'string' END AS matcher FROM p")
def u1_combined_pairs(s, d):
    p = pairs(s, d)
    emb = F.array_contains("matched_by", "embedding_similarity")
    both = resolve.combined_pairs(p.where(~emb).withColumn("matcher", F.lit("string")), p.where(emb).withColumn("matcher", F.lit("embedding")))
    return both.select("id_a", "id_b", "matcher")


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, t AS (SELECT source_id FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT target_id FROM m WHERE source_id IN (SELECT source_id FROM t) GROUP BY 1 HAVING count(DISTINCT source_id) = 2""")
def u3_mentioned_by_all(s, d):
    m = mentions(s, d)
    top = [r[0] for r in m.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(2).collect()]
    return A.mentioned_by_all(m, top)


@query(f"""WITH {P_SQL}, {D_SQL}, o AS (SELECT unnest([a, b]) AS id FROM p WHERE score >= 0.70) SELECT DISTINCT id FROM o WHERE id NOT IN (SELECT unnest(source_ids) FROM d WHERE action <> 'NONE')""")
def u4_cohesion_orphans(s, d):
    live = pairs(s, d).where("score >= 0.70").select(F.explode(F.array("id_a", "id_b")).alias("id"))
    held = decisions(s, d).where("action <> 'NONE'").select(F.explode("source_ids").alias("id"))
    return live.subtract(held)


# ------------------------------------------------------------------------------------------------ resolution, quality, validation


@query()
def r2_candidate_pairs(s, d):
    return resolve.candidate_pairs(resolve.resolvable(entities(s, d))).select("id_a", "id_b", "type", "score", "cross_source", F.array_join("matched_by", ",").alias("matched_by"))


@query()
def r3_embedding_pairs(s, d):
    e = table(s, d, "entities").select("id", "name", "extraction_source", "name_embedding").dropDuplicates(["id"])
    return resolve.embedding_pairs(e, _all_blocks(s, d), 0.75).select("id_a", "id_b", "score")


@query(f"""WITH {D_SQL}, {E_SQL}, x AS (SELECT DISTINCT canonical_id, entity_type, canonical_name, action, unnest(source_ids) AS id FROM d WHERE action <> 'NONE'),
st AS (SELECT DISTINCT canonical_id FROM x JOIN (SELECT id, string_split({NORM.format('name')}, ' ') AS t FROM e WHERE name IS NOT NULL) n USING (id)
  WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1])) > 0 OR (len(t) >= 2 AND len(t) % 2 = 0 AND t[1:len(t) // 2] = t[len(t) // 2 + 1:]))
SELECT 'ner_stutter' AS flag_type, canonical_id FROM st UNION ALL SELECT 'large_tentative_cluster', canonical_id FROM d WHERE action = 'TENTATIVE' AND len(source_ids) >= 5""")
def r8_stutter_and_size_flags(s, d):
    x = decisions(s, d).where("action <> 'NONE'")
    f = quality.stutter_flags(x, entities(s, d).where("name IS NOT NULL").select("id", "name")).select("flag_type", "canonical_id").distinct()
    return f.unionByName(quality.large_flags(x).select("flag_type", "canonical_id"))


@query()
def r8_all_flags(s, d):
    f = quality.flag_decisions(decisions(s, d), pairs(s, d), entities(s, d).where("name IS NOT NULL").select("id", "name"))
    return f.groupBy("flag_type").agg(F.count("*").alias("n"), F.count_distinct("canonical_id").alias("canonicals"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY id, ingested_at, name) AS ord FROM entities),
c AS (SELECT *, coalesce(isnan(confidence) OR confidence < 0 OR confidence > 1, true) AS bad_c, coalesce(trim(name), '') = '' AS bad_n FROM o),
f AS (SELECT *, min(CASE WHEN NOT bad_c AND NOT bad_n THEN ord END) OVER (PARTITION BY id) AS first FROM c)
SELECT r AS reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN bad_c THEN 'confidence outside [0, 1]' END, CASE WHEN bad_n THEN 'missing name' END, CASE WHEN ord > first THEN 'duplicate id' END], lambda x: x IS NOT NULL)) AS r FROM f) GROUP BY 1""")
def v1_entity_errors(s, d):
    e = table(s, d, "entities").select("id", "type", "name", "confidence", "extraction_source", "extraction_method", F.struct("id", "ingested_at", "name").alias("ord"))
    _, bad = validate.split_checked(validate.check_entities(e), "id")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query()
def v3_decision_errors(s, d):
    x = decisions(s, d).withColumn("ord", F.struct("canonical_id", "action", "confidence", F.array_join("source_ids", ",").alias("m")))
    c = validate.check_decisions(x, entities(s, d))
    return c.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, k AS (SELECT id FROM e UNION SELECT canonical_id FROM resolution_decisions)
SELECT count(*) FILTER (WHERE target_id NOT IN (SELECT id FROM k WHERE id IS NOT NULL)) AS orphan_targets, count(*) FILTER (WHERE coalesce(isnan(confidence) OR confidence < 0 OR confidence > 1, true)) AS bad_confidence FROM m""")
def v4_mention_errors(s, d):
    m = mentions(s, d).withColumn("extraction_method", F.lit("rules")).withColumn("ord", F.struct("source_id", "target_id"))
    known = nodes(s, d).select("id")
    c = validate.check_edges(m, m.select(F.col("source_id").alias("id")), known, "MENTIONS")
    return c.agg(F.sum(F.array_contains("reasons", "orphan target").cast("long")).alias("orphan_targets"), F.sum(F.array_contains("reasons", "confidence outside [0, 1]").cast("long")).alias("bad_confidence"))


# ------------------------------------------------------------------------------------------------ relationships


@query()
def l1_author_candidates(s, d):
    return relate.extract_authors(papers(s, d))


@query()
def l2_resolved_authors(s, d):
    hit, lost = relate.resolve_authors(relate.extract_authors(papers(s, d)), entities(s, d).where("type = 'Person'"), links(s, d))
    return hit.select("source_id", "target_id", F.lit(True).alias("live")).unionByName(lost.select("source_id", F.col("person_id").alias("target_id"), F.lit(False).alias("live")))


@query(f"WITH {E_SQL}, {L_SQL}, {M_SQL} SELECT source_id, 'MENTIONS' AS type, target_id, mention_count AS frequency FROM m")
def l4_mention_edges(s, d):
    return mentions(s, d).select("source_id", "type", "target_id", "frequency")


@query(f"WITH {C_SQL} SELECT source_id, id AS target_id, row_number() OVER (PARTITION BY source_id ORDER BY source_file, chunk_index, id) - 1 AS number FROM c")
def l5_has_chunk(s, d):
    return relate.has_chunk(chunks(s, d)).select("source_id", "target_id", F.col("number").cast("long").alias("number"))


# ------------------------------------------------------------------------------------------------ retrieval, planning, explanation


def _hub(s, d) -> str:
    return mentions(s, d).groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()[0]


def _all_nodes(s, d):
    """Nodes of entities, canonicals and the sources that mention them."""
    src = mentions(s, d).select(F.col("source_id").alias("id"), F.lit("Paper").alias("type"), F.col("source_id").alias("name"), F.lit("unresolved").alias("resolution"), "extraction_source").dropDuplicates(["id"])
    return nodes(s, d).unionByName(src)


@query(f"""WITH {E_SQL}, {L_SQL}, {M_SQL}, h AS (SELECT source_id FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT id FROM e UNION SELECT canonical_id FROM resolution_decisions WHERE action IN ('MERGE', 'TENTATIVE'))
SELECT target_id AS entity_id, confidence AS score, 'MENTIONS' AS relationship_type FROM m JOIN h USING (source_id) WHERE target_id IN (SELECT id FROM k)""")
def g1_entity_context(s, d):
    c = retrieve.entity_context(_hub(s, d), _all_nodes(s, d), mentions(s, d), chunks(s, d), ["MENTIONS"], False)
    return c.orderBy(*retrieve.graph_order()).select("entity_id", "score", "relationship_type")


def _first_vector(s, d) -> list[float]:
    return table(s, d, "chunks").where("embedding IS NOT NULL").orderBy("id", "created_at").select("embedding").first()[0]


@query(f"""WITH {C_SQL}, q AS (SELECT embedding AS v FROM chunks WHERE embedding IS NOT NULL ORDER BY id, created_at LIMIT 1)
SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS cosine FROM c WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 ORDER BY cosine DESC, id LIMIT 10""")
def g3_search_by_passage(s, d):
    v = table(s, d, "chunks").where("embedding IS NOT NULL").groupBy("id").agg(F.min_by("embedding", "created_at").alias("v"))
    return retrieve.search_vectors(v, _first_vector(s, d), 10).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {E_SQL}, w AS (SELECT id, regexp_extract_all(lower(full_name), '[\\pL\\pN]+') AS w FROM e WHERE type = 'Person' AND full_name IS NOT NULL), x AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM w WHERE len(w) > 0),
t AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM x GROUP BY 1, 2), n AS (SELECT count(*) AS n, avg(dl) AS mean FROM (SELECT id, any_value(dl) AS dl FROM t GROUP BY 1)),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN ('anna', 'jorge') GROUP BY 1)
SELECT id, 'person' AS index_name, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM t JOIN f USING (term), n GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")
def g4_search_by_keyword(s, d):
    r = retrieve.search_by_keyword(entities(s, d).select("id", "type", "full_name"), "Anna Jorge", 10, ("person",))
    return r.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").select("id", "index_name", "score")


@query()
def g4_search_all_indexes(s, d):
    """g4_search_by_keyword over all four indexes."""
    r = retrieve.search_by_keyword(_keyword_fields(s, d), "Anna Jorge", 10)
    return r.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").select("id", "index_name", "score")


@query()
def g6_neighbourhood(s, d):
    hub = _hub(s, d)
    n, _, cut_off = retrieve.neighbourhood(hub, retrieve.entity_context(hub, _all_nodes(s, d), mentions(s, d), chunks(s, d)), 100)
    return n.crossJoin(cut_off)  # one row on the right


_CLASS_SQL = {c: "|".join(f"(?:{p})" for p in ps).replace("'", "''") for c, ps in classify.SIGNALS.items()}
_SINGLE = " ".join(
    f"WHEN fired = '{c}' THEN CASE WHEN regexp_matches(q, '{classify.COMPOUND}', 'i') OR len(list_filter(list_concat({', '.join('regexp_extract_all(q, ' + repr('(?i)' + p) + ')' for p in classify.SIGNALS[c])}), lambda x: regexp_matches(x, '{classify.AMBIGUOUS}', 'i'))) > 0 THEN 'hybrid' ELSE '{c}' END"
    for c in classify.SIGNALS
)


@query(f"""WITH q AS (SELECT query_id, coalesce(question, '') AS q FROM retrieval_queries), f AS (SELECT query_id, q, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(q, '{p}', 'i') THEN '{c}' END" for c, p in sorted(_CLASS_SQL.items()))}], lambda x: x IS NOT NULL), ',') AS fired FROM q)
SELECT query_id, fired, CASE {_SINGLE} ELSE 'hybrid' END AS category FROM f""")
def q1_classify(s, d):
    c = classify.classify(table(s, d, "retrieval_queries"))
    return c.select("query_id", F.array_join("fired", ",").alias("fired"), "category")


@query("""SELECT query_id, CASE WHEN regexp_matches(question, '\\bwho authored\\b|\\bauthored by\\b|\\bwho wrote\\b', 'i') THEN 'AUTHORED_BY'
WHEN regexp_matches(question, '\\bwhat does .{1,60}\\bmentions?\\b|\\bmentions? (the )?most\\b|\\bmost (frequently )?mentions?\\b', 'i') THEN 'MENTIONS'
WHEN regexp_matches(question, '\\bsame entity\\b|\\bsame as\\b|\\bis .{1,60}\\bthe same\\b|\\baggregat\\w*\\b|\\braw (name )?variants?\\b', 'i') THEN 'SAME_AS' END AS edge_type FROM retrieval_queries""")
def f23_wanted_edges(s, d):
    return table(s, d, "retrieval_queries").select("query_id", classify.wanted_edges().alias("edge_type"))


@query("""SELECT query_id, regexp_replace(question, '([-+&|!(){}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped FROM retrieval_queries""")
def f25_escape_query(s, d):
    return table(s, d, "retrieval_queries").select("query_id", X.escape_query("question").alias("escaped"))


@query("""SELECT result_id, retrieved_at, CASE confidence_method WHEN 'graph_exact_match' THEN 'Exact ID lookup' WHEN 'graph_edge_confidence' THEN 'Graph relationship confidence' WHEN 'graph_evidence_chunk' THEN 'Linked source passage'
WHEN 'cosine_similarity_name' THEN 'Name similarity (embedding)' WHEN 'cosine_similarity_passage' THEN 'Passage similarity (embedding)' WHEN 'lucene_relevance' THEN 'Keyword search relevance' ELSE confidence_method END AS label FROM retrieval_results""")
def f26_confidence_labels(s, d):
    return table(s, d, "retrieval_results").select("result_id", "retrieved_at", explain.confidence_label().alias("label"))


def _results(s, d):
    r = table(s, d, "retrieval_results").groupBy("result_id").agg(F.min_by(F.struct("query_id", "entity_id", "result_type", "score", "source", "matched_text", "target_resolution", "confidence_method", "chunk_id"), "retrieved_at").alias("r")).select("result_id", "r.*")
    c = chunks(s, d).select(F.col("id").alias("entity_id"), "source_id")
    return r.join(c, "entity_id", "left")


@query(f"""WITH {C_SQL}, r AS (SELECT * FROM retrieval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY retrieved_at) = 1),
x AS (SELECT DISTINCT query_id, entity_id FROM r WHERE result_type = 'Chunk')
SELECT result_id, CASE WHEN result_type = 'Chunk' THEN 'chunk_is_answer' WHEN nullif(chunk_id, '') IS NOT NULL THEN 'entity_with_chunk' ELSE 'entity_only' END AS shape,
CASE WHEN result_type = 'Chunk' THEN coalesce(nullif(chunk_id, ''), r.entity_id) WHEN nullif(chunk_id, '') IS NOT NULL THEN chunk_id END AS evidence_chunk,
CASE WHEN result_type = 'Chunk' THEN r.matched_text IS NOT NULL ELSE x.entity_id IS NOT NULL END AS has_text
FROM r LEFT JOIN x ON x.query_id = r.query_id AND x.entity_id = r.chunk_id""")
def e1_evidence(s, d):
    r = _results(s, d)
    titles = papers(s, d).select(F.col("paper_id").alias("id"), "title")
    return explain.evidence(r, r, titles, ["query_id"]).select("result_id", "shape", "evidence_chunk", F.col("evidence_text").isNotNull().alias("has_text"))


@query()
def e2_caveats(s, d):
    e = entities(s, d).select(F.col("id").alias("entity_id"), F.col("type").alias("node_type"), "extraction_source")
    r = _results(s, d).join(e, "entity_id", "left").join(links(s, d).select("entity_id", "decision_action"), "entity_id", "left")
    edge = mentions(s, d).select(F.col("target_id").alias("entity_id"), F.col("type").alias("relationship_type")).distinct()
    return explain.caveats(r.join(edge, "entity_id", "left"), F.col("source") == "graph").select("result_id", F.array_join("caveats", ",").alias("caveats"))


def _documents(s, d):
    """(id, type, name, extraction_source) of papers and Markdown documents; name is the title."""
    p = extract.source_entities(table(s, d, "pdf_metadata"), "Paper", "title")
    m = extract.source_entities(table(s, d, "markdown_docs"), "Markdown", "title")
    both = p.unionByName(m).where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("type", "name", "extraction_source")).alias("r"))
    return both.select("id", "r.*")


def _keyword_fields(s, d):
    """(id, type, name, full_name, description, aliases, title): what the four keyword indexes cover."""
    e = resolve.first_deliveries(table(s, d, "entities"), keep=["type", "name", "full_name", "description", "aliases", "ingested_at"])
    return e.drop("ingested_at").unionByName(_documents(s, d).select("id", "type", F.col("name").alias("title")), allowMissingColumns=True)


def _canonical_vectors(s, d, ev):
    """(id, v): of each canonical, the name vector of its first member that has one."""
    j = links(s, d).join(ev.withColumnRenamed("id", "entity_id"), "entity_id")
    return j.groupBy(F.col("canonical_id").alias("id")).agg(F.min_by("v", "entity_id").alias("v"))


def knowledge_graph(s, d) -> planner.Graph:
    ent = table(s, d, "entities")
    ev = ent.where("name_embedding IS NOT NULL").groupBy("id").agg(F.min_by("name_embedding", "ingested_at").alias("v"))
    lk = links(s, d)
    cv = _canonical_vectors(s, d, ev)
    docs = _documents(s, d)
    known = _all_nodes(s, d).join(docs, "id", "left_anti").unionByName(docs.withColumn("resolution", F.lit("unresolved")))
    ch = table(s, d, "chunks").where("embedding IS NOT NULL").groupBy("id").agg(F.min_by("embedding", "created_at").alias("v"))
    return planner.Graph(
        known, mentions(s, d), chunks(s, d), _keyword_fields(s, d), lk, ev, cv, ch,
        papers(s, d).select(F.col("paper_id").alias("id"), "title"), planner.hashed_embedder(384),
    )


@query()
def q2_hybrid_answer(s, d):
    r = planner.plan_and_retrieve("What is known about Anna, and how does it relate to corpora?", knowledge_graph(s, d), _hub(s, d))
    return r.results.select("rank", "entity_id", F.round("score", 6).alias("score"), "source")


@query()
def e3_explained_answer(s, d):
    return planner.answer('Which entity has the literal string "anna"?', knowledge_graph(s, d)).withColumn("caveats", F.array_join("caveats", ","))


# ------------------------------------------------------------------------------------------------ further operators


@query("""SELECT DISTINCT 'paper_' || trim(regexp_replace(lower(regexp_replace(extraction_source, '^[^:]*:', '')), '[^a-z0-9]+', '_', 'g'), '_') AS id, 'Paper' AS type,
coalesce(nullif(title, ''), trim(regexp_replace(lower(regexp_replace(extraction_source, '^[^:]*:', '')), '[^a-z0-9]+', '_', 'g'), '_')) AS name FROM pdf_metadata""")
def pr4_source_entities(s, d):
    return extract.source_entities(table(s, d, "pdf_metadata"), "Paper", "title").select("id", "type", "name")


@query("SELECT CASE type WHEN 'Person' THEN 'person' WHEN 'Organization' THEN 'org' ELSE 'other' END AS prefix, count(*) AS n FROM entities GROUP BY 1")
def pr3_prefixes(s, d):
    p = F.when(F.col("type") == "Person", "person").when(F.col("type") == "Organization", "org").otherwise("other")
    return A.counts_by(table(s, d, "entities").select(p.alias("prefix")), "prefix")


@query("SELECT id, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) > 1")
def k13_broken_uniqueness(s, d):
    return sinks.check_unique(table(s, d, "entities"))


@query(f"""WITH {E_SQL}, {D_SQL}, x AS (SELECT DISTINCT canonical_id, action, unnest(source_ids) AS t FROM d WHERE action IN ('MERGE', 'TENTATIVE'))
SELECT (SELECT count(DISTINCT canonical_id) FROM x) AS canonicals, (SELECT count(DISTINCT (canonical_id, t)) FROM x WHERE t IN (SELECT id FROM e)) AS edges""")
def k11_write_resolution(s, d):
    e, x = entities(s, d), decisions(s, d)
    # the graph holds the merged decisions already; the others come in and the merged ones are merged again
    held = x.where("action = 'MERGE'")
    c, r = sinks.write_resolution(e, sinks.canonical_rows(held, 0), sinks.same_as_rows(held, e, 0), x, 1)
    return c.agg(F.count("*").alias("canonicals")).crossJoin(r.agg(F.count("*").alias("edges")))  # one row by one row


@query()
def f18_embedded_names(s, d):
    n = table(s, d, "entities").select("name").distinct()
    return planner.embed_column(n, "name", planner.hashed_embedder(64)).select("name", F.size("v").alias("dim"), F.round(S.dot(F.col("v"), F.col("v")), 4).alias("norm"))


@query()
def f24_name_terms(s, d):
    @F.pandas_udf("string")
    def term(q: pd.Series) -> pd.Series:
        return q.map(lambda x: None if x is None else classify.name_term(x))

    return table(s, d, "retrieval_queries").select("query_id", term("question").alias("term"))


@query(f"""WITH q AS (SELECT name_embedding AS v FROM entities WHERE name_embedding IS NOT NULL AND list_sum(list_transform(name_embedding, lambda x: abs(x))) > 0 ORDER BY id, ingested_at LIMIT 1),
v AS (SELECT id, arg_min(name_embedding, ingested_at) AS v FROM entities WHERE name_embedding IS NOT NULL GROUP BY 1)
SELECT id, round(list_cosine_similarity(v::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS cosine FROM v WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0 ORDER BY cosine DESC, id LIMIT 5""")
def g2_search_by_name(s, d):
    ent = table(s, d, "entities").where("name_embedding IS NOT NULL")
    q = ent.where(F.exists("name_embedding", lambda x: x != 0)).orderBy("id", "ingested_at").select("name_embedding").first()[0]
    v = ent.groupBy("id").agg(F.min_by("name_embedding", "ingested_at").alias("v"))
    return retrieve.search_by_name(v, v.limit(0), q, 5).select("id", F.round("cosine", 6).alias("cosine"))


@query()
def g2_search_all_names(s, d):
    """g2_search_by_name over entities and canonicals."""
    ent = table(s, d, "entities").where("name_embedding IS NOT NULL")
    q = ent.where(F.exists("name_embedding", lambda x: x != 0)).orderBy("id", "ingested_at").select("name_embedding").first()[0]
    v = ent.groupBy("id").agg(F.min_by("name_embedding", "ingested_at").alias("v"))
    return retrieve.search_by_name(v, _canonical_vectors(s, d, v), q, 5).select("id", F.round("cosine", 6).alias("cosine"), "target_resolution")


@query("""WITH c AS (SELECT least(id_a, id_b) AS a, max(score) AS s FROM candidate_pairs WHERE score >= 0 AND NOT isnan(score) GROUP BY 1) SELECT a AS id, s AS best FROM c""")
def s9_best_scores_by_sql(s, d):
    text = "SELECT least(id_a, id_b) AS id, max(score) AS best FROM pairs WHERE score >= 0 AND NOT isnan(score) GROUP BY 1"
    return graph.run_query(s, text, {"pairs": table(s, d, "candidate_pairs")})


#: Decisions of one JSON document, about.
ARTIFACT_ROWS = 10_000


@query()
def s10_json_artifact(s, d):
    """All decisions written as JSON documents by the executors, each a list of its part, and read again."""
    import uuid

    path = f"{shared_dir(s)}/decisions-{uuid.uuid4().hex}"
    x = decisions(s, d)
    part = F.pmod(F.xxhash64("canonical_id", "source_ids"), F.lit(max(1, -(-x.count() // ARTIFACT_ROWS))))
    rows = x.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*x.columns)).alias("decisions"))
    rows.select(F.lit("x").alias("stage"), "decisions").write.option("ignoreNullFields", "false").json(path)
    kind = f"stage string, decisions {rows.schema['decisions'].dataType.simpleString()}"
    read = s.read.schema(kind).json(path).select(F.explode("decisions").alias("r")).select("r.*")
    return read.select("action", F.round("confidence", 6).alias("confidence"), "canonical_id", "canonical_name", "entity_type", F.array_join("source_ids", ",").alias("source_ids"))


@query("SELECT strftime(ingested_at, '%Y-%m-%d') AS day, extraction_source, count(*) AS n FROM markdown_docs GROUP BY 1, 2")
def d1_streamed_arrivals(s, d):
    """Documents per day and source, counted by a stream over the table's files that ends when it has read them."""
    import uuid

    from loomgraph.streaming import ingest

    src = table(s, d, "markdown_docs")
    name = f"arrivals_{uuid.uuid4().hex}"
    stream = s.readStream.schema(src.schema).parquet(f"{d}/markdown_docs.parquet*")
    q = ingest.arrival_counts(stream, delay="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "extraction_source", "n")


# ------------------------------------------------------------------------------------------------ the pipeline in one


@query("""WITH e AS (SELECT p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, p_partkey, p_name FROM part),
n AS (SELECT slug, min(p_name) AS name, count(DISTINCT p_brand) AS brands FROM e GROUP BY 1),
s AS (SELECT slug, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN e ON p_partkey = l_partkey GROUP BY 1)
SELECT slug, name, brands, suppliers FROM n JOIN s USING (slug) ORDER BY suppliers DESC, slug LIMIT 20""")
def flagship_part_mentions(s, d):
    """Part names as entities across brands, ranked by the distinct suppliers whose lines mention them."""
    e = table(s, d, "part").select("p_partkey", "p_brand", "p_name", X.slug("p_name").alias("slug"))
    n = e.groupBy("slug").agg(F.min("p_name").alias("name"), F.count_distinct("p_brand").alias("brands"))
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    sup = li.join(e.select("p_partkey", "slug"), "p_partkey").select("slug", "l_suppkey").distinct().groupBy("slug").agg(F.count("*").alias("suppliers"))
    return n.join(sup, "slug").orderBy(F.desc("suppliers"), "slug").limit(20).select("slug", "name", "brands", "suppliers")


flagship = flagship_part_mentions

ORACLES.update(oracles(E_SQL, D_SQL, L_SQL, P_SQL, C_SQL, M_SQL, _BLOCKS_SQL, NORM))
