import datetime
from itertools import combinations

from pyspark.sql import functions as F

from loomgraph import core_queries as Q
from loomgraph.functions import text as X

AT = datetime.datetime(2024, 1, 1)
ENTITIES = (
    "id string, type string, base_type string, name string, confidence double, extraction_source string, extraction_method string, mention_count long, doc_char_start long, doc_char_end long, "
    "source_file string, aliases array<string>, full_name string, description string, name_embedding array<float>, ingested_at timestamp"
)


def entity(i, kind, name, vector=None, aliases=None):
    return (i, kind, None, name, 0.9, "pdf:x.pdf", "ner", 1, 0, 5, "x.pdf", aliases, name if kind == "Person" else None, None, vector, AT)


def write_entities(spark, d, rows):
    spark.createDataFrame(rows, ENTITIES).write.parquet(f"{d}/entities.parquet")


def test_blocks_hold_persons(spark, tmp_path):
    names = [("p1", "Person", "Anna Berg"), ("p2", "Person", "Anna Lund"), ("p3", "Person", "Bo Alm"), ("o1", "Organization", "Anna Labs"), ("o2", "Organization", "Berg Labs")]
    write_entities(spark, tmp_path, [entity(*n, [1.0, 0.1]) for n in names])
    e = spark.createDataFrame(names, "id string, type string, name string")
    form = F.explode(X.name_forms(X.normalized("name")))
    keys = {}
    for r in e.select("id", "type", form.alias("form")).select("id", "type", X.block_keys(F.col("form")).alias("b")).collect():
        keys.setdefault((r.id, r.type), set()).update((r.type, b["kind"], b["value"]) for b in r.b)
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(keys, 2) if keys[a] & keys[b]}
    assert ("p1", "p2") in want
    got = {(r.id_a, r.id_b) for r in Q.QUERIES["j1_all_blocked_pairs"](spark, str(tmp_path)).collect()}
    assert got == want
    assert Q.QUERIES["a3_all_block_statistics"](spark, str(tmp_path)).first().unique_pairs == len(want)
    assert {(r.id_a, r.id_b) for r in Q.r3_embedding_pairs(spark, str(tmp_path)).collect()} == want


def test_artifact_holds_all_decisions(spark, tmp_path):
    rows = [(("NONE", "MERGE", "TENTATIVE")[i % 3], 0.5, f"c{i}", "n", "Person", [f"a{i}", f"b{i}"]) for i in range(360)]
    spark.createDataFrame(rows, "action string, confidence double, canonical_id string, canonical_name string, entity_type string, source_ids array<string>").write.parquet(f"{tmp_path}/resolution_decisions.parquet")
    got = Q.s10_json_artifact(spark, str(tmp_path)).collect()
    assert {(r.action, r.canonical_id, r.source_ids) for r in got} == {(r[0], r[2], ",".join(r[5])) for r in rows} and len(got) == 360


def test_keyword_indexes_hold_aliases_and_titles(spark, tmp_path):
    write_entities(spark, tmp_path, [entity("t1", "Technology", "Spark", None, ["zeppelin"]), entity("o1", "Organization", "Labs", None, ["quokka"])])
    at = "extraction_source string, title string"
    spark.createDataFrame([("pdf:a.pdf", "On walrus")], at).write.parquet(f"{tmp_path}/pdf_metadata.parquet")
    spark.createDataFrame([("md:b.md", "Of narwhals")], at).write.parquet(f"{tmp_path}/markdown_docs.parquet")
    fields = Q._keyword_fields(spark, str(tmp_path))
    r = Q.retrieve.search_by_keyword(fields, "zeppelin quokka walrus narwhals").collect()
    assert {(x.id, x.index_name) for x in r} == {("t1", "technology"), ("o1", "organization"), ("paper_a_pdf", "document"), ("markdown_b_md", "document")}


def test_blocks_without_persons(spark, tmp_path):
    names = [(f"{kind[:1]}{k:02}", kind, f"{('Anna', 'Bo')[k % 2]} {('Labs', 'Berg', 'Works')[k % 3]}") for k in range(12) for kind in ("Person", "Organization", "Dataset")]
    write_entities(spark, tmp_path, [entity(*n) for n in names])
    keys = {i: (kind, name.split()) for i, kind, name in names if kind != "Person"}
    same = lambda x, y: x[0] == y[0] and any((x[1][0] == y[1][0], x[1][1] == y[1][1], sorted(t[0] for t in x[1]) == sorted(t[0] for t in y[1])))
    want = {(a, b) for a in keys for b in keys if a < b and same(keys[a], keys[b])}
    df = Q.a3_block_statistics(spark, str(tmp_path))
    assert df.first().unique_pairs == len(want)
    assert "id_a" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r.id_a, r.id_b) for r in Q.j1_blocked_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_unscored_pairs_of_all_entities(spark, tmp_path):
    write_entities(spark, tmp_path, [entity("p1", "Person", "Anna Berg"), entity("p2", "Person", "Anna Lund"), entity("p3", "Person", "Anna Alm"), entity("o1", "Organization", "Anna Labs")])
    rows = [(" p2", "p1\u00a0", "b", "a", "Person", 0.9, False, ["ratio"], "m", AT), ("p1", "p3", "a", "c", "Person", None, False, ["ratio"], "m", AT)]
    spark.createDataFrame(rows, "id_a string, id_b string, name_a string, name_b string, type string, score double, cross_source boolean, matched_by array<string>, matcher string, scored_at timestamp").write.parquet(f"{tmp_path}/candidate_pairs.parquet")
    df = Q.QUERIES["j3_all_unscored_pairs"](spark, str(tmp_path))
    assert sorted((r.id_a, r.id_b) for r in df.collect()) == [("p1", "p3"), ("p2", "p3")]
    assert "held" in df._jdf.queryExecution().executedPlan().toString()  # scored pairs are left out in the join, not after a shuffle of all pairs
