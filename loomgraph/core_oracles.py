"""SQL for the queries of the core whose rows need longer SQL: similarity by dynamic programming, bylines, flags."""

from __future__ import annotations

#: White space at the ends of names and lines, as the text functions have it.
SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
GRADES = "('ieee', 'member', 'senior member', 'life fellow', 'fellow', 'student member', 'life member', 'senior fellow')"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def names(x: str) -> str:
    """The names in a comma-separated field."""
    part = f"regexp_replace({stripped('y')}, '^\\s*and\\s+', '', 'i')"
    return f"list_filter(list_transform(string_split({x}, ','), lambda y: {part}), lambda z: z <> '' AND lower(z) NOT IN {GRADES})"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence: one list_reduce over the rows of the table, one within a row."""
    row = f"list_reduce(range(1, length({a}) + 1), lambda r, i: list_append(r, CASE WHEN substr({a}, i, 1) = c THEN w[i] + 1 ELSE greatest(w[i + 1], r[i]) END), [0::BIGINT])"
    zeros = f"list_transform(range(0, length({a}) + 1), lambda x: 0::BIGINT)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(regexp_extract_all({b}, '(?s).'), lambda w, c: {row}, {zeros})[-1] END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({common(a, b)}) / (length({a}) + length({b})) END"


def in_order(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def oracles(e: str, d: str, links: str, pairs: str, chunks: str, mentions: str, blocks: str, norm: str) -> dict[str, str]:
    """SQL by query; the arguments are the shared common table expressions."""
    risky = "(len({0}) <= 3 OR len(list_filter({0}, lambda x: length(x) <> 1)) = 0)"
    named = pairs.replace("score, type, matched_by FROM", "score, type, matched_by, CASE WHEN trim(id_a, w) > trim(id_b, w) THEN name_b ELSE name_a END AS na, CASE WHEN trim(id_a, w) > trim(id_b, w) THEN name_a ELSE name_b END AS nb FROM")
    stutter = "(len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1])) > 0 OR (len(t) >= 2 AND len(t) % 2 = 0 AND t[1:len(t) // 2] = t[len(t) // 2 + 1:]))"
    papers = "ap AS (SELECT * FROM pdf_metadata QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) = 1)"
    lines = f"list_filter(list_transform(regexp_split_to_array(split_part(text, '--- Page 2 ---', 1), '\\r\\n|[\\n\\r\\x{{000B}}\\x{{000C}}\\x{{001C}}-\\x{{001E}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]'), lambda y: {stripped('y')}), lambda z: z <> '' AND NOT starts_with(z, '---'))"
    authors = f"""{papers}, raw AS (SELECT paper_id, extraction_source, coalesce(trim(authors[1]), '') AS raw, text FROM ap),
ln AS (SELECT *, {lines}[2:] AS ln FROM raw), st AS (SELECT *, list_position(list_transform(ln, lambda x: starts_with(lower(x), 'abstract')), true) AS stop FROM ln),
nm AS (SELECT paper_id, extraction_source, len({names('raw')}) > 0 AS meta, CASE WHEN len({names('raw')}) > 0 THEN {names('raw')} ELSE {names("array_to_string(CASE WHEN stop > 0 THEN ln[1:stop - 1] ELSE ln END, ', ')")} END AS n FROM st),
au AS (SELECT paper_id AS source_id, extraction_source, meta, unnest(n) AS target_name FROM nm)"""
    slug = f"coalesce(nullif(trim(regexp_replace(lower(trim(regexp_replace(target_name, '{SPACE}+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unnamed')"
    person = f"'person_' || {slug} || '__' || trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(extraction_source, '^[^:]*:', ''), '{SPACE}+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '_')"
    every = blocks.replace("type <> 'Person' AND ", "")
    return {
        "k7_set_vectors": f"WITH {e}, v AS (SELECT id, min(len(name_embedding))::INT AS dim FROM entities WHERE name_embedding IS NOT NULL GROUP BY 1) SELECT e.id, v.dim FROM e LEFT JOIN v USING (id)",
        "f11_similarity": f"""WITH {named}, n AS (SELECT a, b, {norm.format('na')} AS x, {norm.format('nb')} AS y FROM p WHERE na IS NOT NULL AND nb IS NOT NULL), s AS (SELECT *, {in_order('x')} AS xs, {in_order('y')} AS ys FROM n)
SELECT a AS id_a, b AS id_b, round_even(greatest({ratio('x', 'y')}, {ratio('xs', 'ys')}), 4) AS similarity FROM s""",
        "r8_all_flags": f"""WITH {d}, {e}, {named}, x AS (SELECT DISTINCT canonical_id, canonical_name, entity_type, action, unnest(source_ids) AS id FROM d WHERE action <> 'NONE'),
t AS (SELECT * FROM x WHERE action = 'TENTATIVE'), q AS (SELECT a, b, string_split({norm.format('na')}, ' ') AS ta, string_split({norm.format('nb')}, ' ') AS tb FROM p WHERE list_contains(matched_by, 'embedding_similarity')),
f1 AS (SELECT DISTINCT 'short_name_embedding' AS flag_type, t.canonical_id, t.canonical_name, t.entity_type FROM q JOIN t ON t.id = q.a JOIN t u ON u.id = q.b AND u.canonical_id = t.canonical_id WHERE {risky.format('ta')} OR {risky.format('tb')}),
f2 AS (SELECT DISTINCT 'ner_stutter' AS flag_type, x.canonical_id, x.canonical_name, x.entity_type FROM x JOIN (SELECT id, string_split({norm.format('name')}, ' ') AS t FROM e WHERE name IS NOT NULL) n USING (id) WHERE {stutter}),
f3 AS (SELECT 'large_tentative_cluster' AS flag_type, canonical_id, canonical_name, entity_type FROM d WHERE action = 'TENTATIVE' AND len(source_ids) >= 5),
c AS (SELECT DISTINCT {norm.format('canonical_name')} AS norm, canonical_id, canonical_name, entity_type FROM d WHERE action <> 'NONE'),
f4 AS (SELECT DISTINCT 'cross_type_collision' AS flag_type, c.canonical_id, c.canonical_name, c.entity_type FROM c WHERE norm <> '' AND norm IN (SELECT norm FROM c GROUP BY 1 HAVING count(DISTINCT entity_type) > 1)
  AND EXISTS (SELECT 1 FROM c o WHERE o.norm = c.norm AND (o.canonical_id <> c.canonical_id OR o.entity_type <> c.entity_type)))
SELECT flag_type, count(*) AS n, count(DISTINCT canonical_id) AS canonicals FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4) GROUP BY 1""",
        "l1_author_candidates": f"WITH {authors} SELECT source_id, extraction_source, target_name, 'AUTHORED_BY' AS type, CASE WHEN meta THEN 0.98 ELSE 0.96 END::DOUBLE AS confidence, CASE WHEN meta THEN 'metadata' ELSE 'byline' END AS evidence FROM au",
        "l2_resolved_authors": f"""WITH {authors}, {e}, {links}, k AS (SELECT source_id, {person} AS pid FROM au), h AS (SELECT k.*, pid IN (SELECT id FROM e WHERE type = 'Person') AS live FROM k)
SELECT source_id, CASE WHEN live THEN coalesce(l.m.c, pid) ELSE pid END AS target_id, live FROM h LEFT JOIN l ON h.live AND l.entity_id = h.pid""",
        "r3_embedding_pairs": f"""WITH {every}, v AS (SELECT id, any_value(name_embedding) AS v FROM entities WHERE name_embedding IS NOT NULL GROUP BY id), q AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bk x JOIN bk y USING (type, kind, value) WHERE x.id < y.id)
SELECT a AS id_a, b AS id_b, round_even(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 4) AS score FROM q JOIN v x ON x.id = a JOIN v y ON y.id = b
WHERE list_sum(list_transform(x.v, lambda z: abs(z))) > 0 AND list_sum(list_transform(y.v, lambda z: abs(z))) > 0 AND round_even(list_cosine_similarity(x.v::DOUBLE[], y.v::DOUBLE[]), 4) >= 0.75""",
        "s10_json_artifact": f"WITH {d} SELECT action, round(confidence, 6) AS confidence, canonical_id, canonical_name, entity_type, array_to_string(source_ids, ',') AS source_ids FROM d",
        "r2_candidate_pairs": f"""WITH {every}, q AS (SELECT x.id AS a, y.id AS b, any_value(x.type) AS type, list_sort(list(DISTINCT x.kind)) AS kinds FROM bk x JOIN bk y USING (type, kind, value) WHERE x.id < y.id GROUP BY 1, 2),
n2 AS (SELECT q.*, {norm.format('s.name')} AS x, {norm.format('u.name')} AS y, s.extraction_source <> u.extraction_source AS cross_source FROM q JOIN e s ON s.id = a JOIN e u ON u.id = b),
s2 AS (SELECT *, {in_order('x')} AS xs, {in_order('y')} AS ys FROM n2 WHERE 2.0 * least(length(x), length(y)) / (length(x) + length(y)) >= 0.8499),
z AS (SELECT *, {ratio('x', 'y')} AS r, {ratio('xs', 'ys')} AS t FROM s2)
SELECT a AS id_a, b AS id_b, type, round_even(greatest(r, t), 4) AS score, cross_source, array_to_string(kinds, ',') || CASE WHEN t > r THEN ',token_sort_ratio' ELSE ',ratio' END AS matched_by FROM z WHERE greatest(r, t) >= 0.85""",
        "e2_caveats": f"""WITH {e}, {links}, {mentions}, r AS (SELECT * FROM retrieval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY retrieved_at) = 1), t AS (SELECT DISTINCT target_id FROM m),
j AS (SELECT r.*, e.type, e.extraction_source AS src, t.target_id IS NOT NULL AS mentioned, l.m.a AS act FROM r LEFT JOIN e ON e.id = r.entity_id LEFT JOIN t ON t.target_id = r.entity_id LEFT JOIN l ON l.entity_id = r.entity_id)
SELECT result_id, array_to_string(list_filter([CASE WHEN target_resolution = 'unresolved' THEN 'unresolved' END, CASE WHEN target_resolution = 'unresolved' AND mentioned THEN 'unresolved_mention' END, CASE WHEN source = 'graph' THEN 'one_hop' END,
CASE WHEN act = 'TENTATIVE' THEN 'tentative' END, CASE WHEN type = 'Person' AND src LIKE 'pdf:%' THEN 'pdf_person' END, CASE WHEN type IN ('Technology', 'Language') THEN 'rare_type' END], lambda x: x IS NOT NULL), ',') AS caveats FROM j""",
        "g2_search_all_names": f"""WITH {links}, q AS (SELECT name_embedding AS v FROM entities WHERE name_embedding IS NOT NULL AND list_sum(list_transform(name_embedding, lambda x: abs(x))) > 0 ORDER BY id, ingested_at LIMIT 1),
v AS (SELECT id, arg_min(name_embedding, ingested_at) AS v FROM entities WHERE name_embedding IS NOT NULL GROUP BY 1), cv AS (SELECT l.m.c AS id, arg_min(v.v, v.id) AS v FROM l JOIN v ON v.id = l.entity_id GROUP BY 1),
b AS (SELECT id, v, 'unresolved' AS target_resolution FROM v UNION ALL SELECT id, v, 'canonical' FROM cv)
SELECT id, round(list_cosine_similarity(v::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS cosine, target_resolution FROM b WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0 ORDER BY cosine DESC, id LIMIT 5""",
    }
