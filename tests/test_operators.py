import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import aggregates as A
from loomgraph.operators import chunking, extract, quality, relate, resolve, retrieve, validate
from loomgraph.plans import classify, explain, planner
from loomgraph.sources import sinks

PAIR = "id_a string, id_b string, name_a string, name_b string, type string, score double, cross_source boolean, matched_by array<string>, matcher string"


def pair(a, b, s, emb=False, na=None, nb=None):
    return (a, b, na or a, nb or b, "Person", s, False, ["embedding_similarity" if emb else "ratio"], "m")


@pytest.mark.parametrize(("n", "want"), [(60, [(0, 60)]), (61, [(0, 60), (45, 61)]), (105, [(0, 60), (45, 105)]), (106, [(0, 60), (45, 105), (90, 106)])])
def test_windows(spark, n, want):
    text = "  ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "id int, text string")
    rows = chunking.passages(df).orderBy("chunk_index").collect()
    assert [(int(r.content.split()[0][1:]), int(r.content.split()[-1][1:]) + 1) for r in rows] == want
    for r in rows:
        assert " ".join(text[r.char_start : r.char_end].split()) == r.content and r.id == 1 and r.page_markers == [1]
    assert chunking.blank_texts(df).count() == 2
    with pytest.raises(ValueError):
        chunking.chunk_texts(df, 10, 10)


def test_chunk_pages(spark):
    text = "--- Page 1 ---\na b\n--- Page 3 ---\nc d"
    row = chunking.chunk_texts(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert row.page_markers == [1, 3]


def test_collapse_mentions(spark):
    rows = [("pdf:x", "Ann  Lee", "PERSON", 5, 12, "f", 1), ("pdf:x", "ann lee", "PERSON", 30, 37, "f", 2), ("pdf:x", "ANN LEE", "PERSON", 50, 57, "f", 3), ("pdf:x", "Ann Lee", "PERSON", 70, 77, "f", 4), ("pdf:x", "Rome", "GPE", 1, 5, "f", 5)]
    m = spark.createDataFrame(rows, "extraction_source string, text string, label string, doc_char_start long, doc_char_end long, source_file string, ord int")
    e = extract.collapse_mentions(m).collect()
    assert len(e) == 1
    assert (e[0].id, e[0].name, e[0].aliases, e[0].mention_count, e[0].doc_char_start) == ("person_ann_lee__x", "Ann Lee", ["ANN LEE", "ann lee"], 4, 5)
    assert abs(e[0].confidence - 0.75) < 1e-9
    assert extract.skipped_labels(m).collect()[0]["label"] == "GPE"


def test_candidate_pairs_by_brute_force(spark):
    names = ["Anna Bell", "Anna Bel", "Bell, Anna", "Carl Dorn", "Karl Dorn", "Anna Bell", "", "The", "Zed"]
    df = spark.createDataFrame([(f"e{i}", "Person", n, f"s{i % 2}") for i, n in enumerate(names)] + [("o1", "Organization", "Anna Bell", "s0")], "id string, type string, name string, extraction_source string")
    got = {(r.id_a, r.id_b): r.score for r in resolve.candidate_pairs(df).collect()}
    assert set(got) == {("e0", "e1"), ("e0", "e2"), ("e0", "e5"), ("e1", "e2"), ("e1", "e5"), ("e2", "e5"), ("e3", "e4")}
    assert got["e0", "e2"] == 1.0


def test_connected_against_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(f"v{r.randrange(60):02d}", f"v{r.randrange(60):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.id: x.component for x in resolve.connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {v: find(v) for v in root}


def test_cohesion_and_decisions(spark):
    pairs = spark.createDataFrame([
        pair("person_a__1", "person_b__2", 0.86, na="aaaa", nb="aaab"), pair("person_b__2", "person_c__3", 0.86, na="aaab", nb="zzab"),
        pair("person_k__1", "person_k__2", 0.95, na="Kim Lee", nb="Kim Lee"), pair("person_m__1", "person_m__2", 0.95, True), pair("person_x__1", "person_y__2", 0.5),
    ], PAIR)
    d = {tuple(r.source_ids): r for r in resolve.decide(pairs).collect()}
    assert set(d) == {("person_a__1", "person_b__2"), ("person_k__1", "person_k__2"), ("person_m__1", "person_m__2"), ("person_x__1", "person_y__2")}
    k = d["person_k__1", "person_k__2"]
    assert (k.action, k.canonical_id, k.canonical_name, k.confidence) == ("MERGE", "person_kim_lee", "Kim Lee", 0.95)
    assert d["person_m__1", "person_m__2"].action == "TENTATIVE" and d["person_x__1", "person_y__2"].action == "NONE"


def test_flags(spark):
    d = spark.createDataFrame([("TENTATIVE", "c1", "Rdf Rdf", "Person", ["a", "b"]), ("TENTATIVE", "c2", "Big", "Person", list("vwxyz")), ("MERGE", "c3", "big", "Organization", ["p", "q"])], "action string, canonical_id string, canonical_name string, entity_type string, source_ids array<string>")
    p = spark.createDataFrame([pair("a", "b", 0.91, True)], PAIR)
    names = spark.createDataFrame([("a", "Rdf Rdf"), ("b", "one")], "id string, name string")
    got = {(r.flag_type, r.canonical_id) for r in quality.flag_decisions(d, p, names).collect()}
    assert got == {("short_name_embedding", "c1"), ("ner_stutter", "c1"), ("large_tentative_cluster", "c2"), ("cross_type_collision", "c2"), ("cross_type_collision", "c3")}


def test_entity_and_edge_checks(spark):
    cols = "ord int, id string, type string, name string, confidence double, extraction_source string, extraction_method string"
    e = spark.createDataFrame([
        (1, "a", "Person", "A", 1.5, "s", "m"), (2, "a", "Person", "A", 0.5, "s", "m"), (3, "a", "Person", "A", 0.5, "s", "m"), (4, "b", "Person", "", 0.5, "s", "m"), (5, "c", "Person", "C", -0.1, "", "m"),
        (6, None, "Person", "D", 0.5, "s", "m"), (7, "d", "Alien", "D", 0.5, "s", "m"), (8, "e", "Paper", "E", 0.5, "s", "m"),
    ], cols)
    edges = spark.createDataFrame([(1, "e", "MENTIONS", "a", 0.5, "s", "m"), (2, "e", "MENTIONS", "a", 0.5, "s", "m"), (3, "e", "USES", "a", 0.5, "s", "m"), (4, "e", "MENTIONS", "zz", 2.0, "s", "m"), (5, "e", "MENTIONS", "e", 0.5, "s", "m")], "ord int, source_id string, type string, target_id string, confidence double, extraction_source string, extraction_method string")
    good, good_edges, errors = validate.check_graph(e, edges)
    assert sorted((r.ord, r.id) for r in good.collect()) == [(2, "a"), (8, "e")]
    assert [r.ord for r in good_edges.collect()] == [1]
    assert {r.reason for r in errors.collect()} >= {"duplicate id", "missing id", "missing name", "unknown type", "confidence outside [0, 1]", "duplicate edge", "orphan target", "self-loop"}


def test_decision_overlap_is_sequential(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c", "d"]), (4, ["x", "y"]), (5, ["x"])]
    d = spark.createDataFrame([(o, "MERGE", "Person", 0.9, f"c{o}", "n", m) for o, m in rows], "ord int, action string, entity_type string, confidence double, canonical_id string, canonical_name string, source_ids array<string>")
    got = {r.ord: r.reasons for r in validate.check_decisions(d).collect()}
    assert got == {1: [], 2: ["overlapping cluster"], 3: [], 4: [], 5: ["fewer than two members"]}


def test_mentions_collapse_to_canonicals(spark):
    e = spark.createDataFrame([("p1", "pdf:x", 0.7, 3), ("p2", "pdf:x", 0.8, 4), ("p3", "web:x", 0.8, 4)], "id string, extraction_source string, confidence double, mention_count long")
    lk = spark.createDataFrame([("can", "p1", "MERGE"), ("can", "p2", "MERGE")], "canonical_id string, entity_id string, decision_action string")
    assert [(r.source_id, r.target_id, r.frequency) for r in relate.resolve_mentions(e, lk).collect()] == [("paper_x", "can", 3)]


def test_range_join_takes_the_first_chunk(spark):
    c = spark.createDataFrame([("c0", "f", 0, 0, 3000), ("c1", "f", 1, 2500, 6000)], "id string, source_file string, chunk_index long, char_start long, char_end long")
    e = spark.createDataFrame([("a", "f", 2600), ("b", "f", 3000), ("c", "f", 6000), ("d", "g", 1), ("e", "f", None)], "id string, source_file string, doc_char_start long")
    assert {r.id: r.chunk_id for r in relate.mention_chunks(e, c).collect()} == {"a": "c0", "b": "c1"}


def test_fusion(spark):
    r = spark.createDataFrame([("can", "graph", 1, "canonical"), ("al", "vector", 3, "unresolved"), ("al", "keyword", 1, "unresolved")], "entity_id string, source string, rank int, target_resolution string")
    lk = spark.createDataFrame([("can", "al")], "canonical_id string, entity_id string")
    (x,) = retrieve.reciprocal_rank_fusion(r, lk).collect()
    assert (x.fusion_key, x.source_count, x.representative) == ("can", 3, "can") and abs(x.score - (2 / 61 + 1 / 63)) < 1e-12


def test_edge_statistics(spark):
    e = spark.createDataFrame([("MENTIONS", 0.5)], "type string, confidence double")
    assert tuple(A.edge_statistics(e, "CITES").first()) == (0, None, None, None)
    with pytest.raises(ValueError):
        A.edge_statistics(e, "USES")


QUESTIONS = {
    "Who authored the survey?": "graph", "What does the paper mention most?": "hybrid", 'Find the literal string "x"': "keyword", "Which entity is similar to RDF?": "vector_name", "How does fusion work?": "vector_passage",
    "Who is X?": "hybrid", "What does the paper say about graphs, and how does it end?": "hybrid", "Which names are raw variants of Ann?": "graph", "": "hybrid",
}


def test_classifier_both_ways(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    got = {r.question: (r.category, set(r.fired)) for r in classify.classify(df).collect()}
    for q, want in QUESTIONS.items():
        assert got[q] == classify.classify_one(q)
        assert got[q][0] == want, q
    assert classify.name_term("Which is best matching 'knowledge graph'?") == "knowledge graph"
    assert classify.name_term("Who is Jose Gayo, and is his name affected?") == "Jose Gayo"
    assert classify.edges_for("what does it depend on") is None


def graph(spark):
    nodes = spark.createDataFrame([("p", "Paper", "P", "unresolved", "pdf:x"), ("a", "Person", "Ann", "unresolved", "pdf:x"), ("c", "Person", "Cee", "canonical", "r")], "id string, type string, name string, resolution string, extraction_source string")
    edges = spark.createDataFrame([("p", "AUTHORED_BY", "a", 0.9, "pdf:x", None), ("p", "MENTIONS", "c", 0.8, "pdf:x", "k"), ("c", "SAME_AS", "a", 0.7, "r", None)], "source_id string, type string, target_id string, confidence double, extraction_source string, evidence_chunk_id string")
    chunks = spark.createDataFrame([("k", "p", 0, "text of the chunk")], "id string, source_id string, chunk_index long, content string")
    v = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<float>")
    return planner.Graph(nodes, edges, chunks, nodes.withColumn("full_name", F.col("name")), spark.createDataFrame([("c", "a", "MERGE")], "canonical_id string, entity_id string, decision_action string"), v, v.withColumn("id", F.lit("c")), v.withColumn("id", F.lit("k")), spark.createDataFrame([("p", "Title")], "id string, title string"), lambda _: [1.0, 0.1])


def test_graph_context_and_planner(spark):
    g = graph(spark)
    rows = retrieve.entity_context("p", g.nodes, g.edges, g.chunks).orderBy(*retrieve.graph_order()).collect()
    assert [r.entity_id for r in rows] == ["p", "a", "c", "k"] and rows[-1].result_type == "Chunk"
    assert retrieve.entity_context("nobody", g.nodes, g.edges, g.chunks).count() == 0
    with pytest.raises(ValueError):
        retrieve.entity_context("p", g.nodes, g.edges, g.chunks, ["USES"])
    with pytest.raises(ValueError):
        planner.plan_and_retrieve("Who authored P?", g)
    r = planner.plan_and_retrieve("Who authored P?", g, "p")
    assert r.edge_types == ["AUTHORED_BY"] and [x.entity_id for x in r.results.collect()] == ["a"]
    (x,) = planner.answer("How does it work?", g).collect()
    assert (x.shape, x.evidence_title, x.routing) == ("chunk_is_answer", "Title", "vector_passage")
    h = planner.plan_and_retrieve("Ann", g, "a")
    assert h.category == "hybrid" and h.results.count() > 0
    assert planner.entity_detail("c", g.nodes, g.links).first().aliases[0]["alias"] == "Ann"


def test_caveats(spark):
    df = spark.createDataFrame([("unresolved", "MENTIONS", "TENTATIVE", "Person", "pdf:x"), ("canonical", None, None, None, None)], "target_resolution string, relationship_type string, decision_action string, node_type string, extraction_source string")
    got = [r.caveats for r in explain.caveats(df, True).collect()]
    assert got == [["unresolved", "unresolved_mention", "one_hop", "tentative", "pdf_person"], ["one_hop"]]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("b", None, 9), ("c", "z", 3)], "id string, name string, n int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["id"]).collect()} == {("a", "x", 1), ("b", None, 9), ("c", "z", 3)}
    assert {tuple(r) for r in sinks.merge_properties(old, new, ["id"]).collect()} == {("a", "x", 1), ("b", "y", 9), ("c", "z", 3)}
    path = str(tmp_path / "t")
    assert sinks.commit(old, path) == 2 and sinks.commit(new, path) == 2
    assert {r.id for r in spark.read.parquet(path).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        sinks.commit(old.withColumn("bad", F.create_map(F.lit("k"), F.lit("v"))), path)


def test_streaming_merge(spark, tmp_path):
    from loomgraph.streaming import ingest

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "id string, text string"
    for batch in ([("d1", "a b c")], [("d1", "x y"), ("d2", "q")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        ingest.merge_chunks(ingest.read_documents(spark, src, schema), out, ck).awaitTermination(60)
    assert {(r.id, r.content) for r in spark.read.parquet(out).collect()} == {("d1", "x y"), ("d2", "q")}


def _members(spark, names):
    return resolve.block_members(spark.createDataFrame(names, "id string, type string, name string"))


def _blocked(members):
    """Brute force: the kinds of blocks that two ids share, by pair."""
    keys = {}
    for r in members.where("type IS NOT NULL").collect():
        keys.setdefault(r.id, set()).add((r.type, r.kind, r.value))
    return {(a, b): sorted({k[1] for k in keys[a] & keys[b]}) for a in keys for b in keys if a < b and keys[a] & keys[b]}


_MANY = [(f"{k:03}", ("Person", "Organization", None)[k % 7 % 3], f"{'JAB'[k % 3]} {('Anna', 'Bo', 'B')[k // 3 % 3]} {'xyz'[k // 9 % 3]} {('Berg', 'Alm', 'Anna')[k // 5 % 3]}") for k in range(90)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _after_join(df):
    """The plan above the self join of the blocks: what the pairs pass."""
    lines = _plan(df).split("== Initial Plan ==")[0].split("\n")
    at = next(i for i, x in enumerate(lines) if "Join" in x and "id_a" in x)
    return "\n".join(lines[:at])


def test_blocked_pairs_need_no_shuffle(spark, monkeypatch):
    members = _members(spark, _MANY)
    want = _blocked(members)
    assert max(len(k) for k in want.values()) == 3
    for part in (resolve.BLOCK_PART, 4):  # blocks of more rows are joined in parts
        monkeypatch.setattr(resolve, "BLOCK_PART", part)
        df = resolve.blocked_pairs(members)
        got = [(r.id_a, r.id_b, r.kinds) for r in df.collect()]
        assert len(got) == len(want) and {(a, b): k for a, b, k in got} == want
        assert "Exchange" not in _after_join(df)


def test_unscored_pairs_are_left_out_where_pairs_are_made(spark):
    members = _members(spark, _MANY)
    want = _blocked(members)
    held = [p[:: 1 - 2 * (i % 2)] for i, p in enumerate(sorted(want)) if i % 3 == 0] * 2 + [("none", "000"), ("000", "none")]
    df = resolve.unscored_pairs(members, spark.createDataFrame(held, "id_a string, id_b string"))
    got = [(r.id_a, r.id_b) for r in df.collect()]
    assert sorted(got) == [p for i, p in enumerate(sorted(want)) if i % 3]
    assert "Exchange" not in _after_join(df)


def test_block_statistics_count_without_pairs(spark):
    members = _members(spark, _MANY)
    df = resolve.block_statistics(members)
    assert df.first().unique_pairs == len(_blocked(members))
    assert "id_a" not in _plan(df)
    many = spark.range(60_000).selectExpr("string(id) AS id", "'Person' AS type", "'Anna B Berg' AS name")  # pairs that can't be expanded here
    assert resolve.block_statistics(resolve.block_members(many)).first().unique_pairs == 60_000 * 59_999 // 2
    assert resolve.block_statistics(members.where("false")).first().unique_pairs == 0


def test_letters_bound_the_ratios(spark):
    names = ["anna berg", "berg anna", "anna bergh", "bo alm", "aaaa", "aaab", "x", "😀ß a", "neuneurygeul systems", "neuneurygeul system", "seuheuniator analytics"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    df = df.withColumn("u", S.upper_bound(F.length("a"), F.length("b"), S.letters("a"), S.letters("b"))).withColumn("s", F.greatest(*S.name_scores(F.col("a"), F.col("b"))))
    rows = df.collect()
    assert all(r.u >= r.s for r in rows)
    assert next(r.u for r in rows if (r.a, r.b) == ("neuneurygeul systems", "seuheuniator analytics")) < 0.85  # by lengths alone it was 0.95


def test_embedding_pairs_by_products_of_matrices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 24))
    v = {r[0]: (base[k % 9] + rng.normal(size=24) * 0.45).astype("float32").tolist() for k, r in enumerate(_MANY)}
    v["003"], v["006"], v["009"], v["012"], v["015"] = None, [0.0] * 24, v["000"], v["000"][:20], [None, *v["000"][1:]]
    e = spark.createDataFrame([(*r, "pdf:x", v[r[0]]) for r in _MANY], "id string, type string, name string, extraction_source string, name_embedding array<float>")
    members = resolve.block_members(e)
    want = {}
    for (a, b), kinds in _blocked(members).items():
        x, y = v[a], v[b]
        if x and y and None not in x + y and len(x) == len(y) and any(x) and any(y):
            x, y = np.array(x, "float64"), np.array(y, "float64")
            if round(c := float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 4) >= 0.75:
                want[a, b] = (round(c, 4), [*kinds, "embedding_similarity"])
    assert 50 < len(want) < len(_blocked(members))
    for part in (resolve.BLOCK_PART, 4):
        monkeypatch.setattr(resolve, "BLOCK_PART", part)
        df = resolve.embedding_pairs(e, members, 0.75)
        got = [((r.id_a, r.id_b), (r.score, r.matched_by)) for r in df.collect()]
        assert len(got) == len(want) and dict(got) == want
    assert "MapInArrow" in _plan(df)  # cosines of all blocked pairs by expressions took 40 microseconds a pair
