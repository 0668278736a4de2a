"""Nulls, very long texts, repeats and columns whose names clash with those that the operators add."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import abuse, components, encoding, markup, names, neighbours, packing, rank_fusion, survivors, tokens

CLASH = ("u", "v", "c", "p", "n", "s", "d", "e", "f", "k", "norm", "rank", "ids", "shard", "terms", "home", "own", "cell", "markup", "record_id", "cluster", "kind", "name", "place", "source_kind")


def noisy(df):
    """``df`` with further columns and each row twice."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df.unionByName(df)


@pytest.mark.parametrize("text", ["*" * 20000, "[" * 20000, "<pre>" * 4000, "$a " * 6000, "{{a " * 5000, "a\n" * 10000, "x" * 40000, "\\[" * 10000, "<a href='" * 3000, "|" * 20000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    markup.markup_kinds(text)
    markup.to_blocks(text)
    abuse.score_texts([text], abuse.Scorer(abuse.train_chain([], [], [])))
    encoding.repair_sequences(text.replace("a", "Ã"))
    assert time.time() - began < 10


def test_clashing_columns(spark):
    pairs = noisy(spark.createDataFrame([("a", "b", 0.9), (None, None, None)], "id_a string, id_b string, score double"))
    assert {tuple(r) for r in components.consolidate(pairs).collect()} == {("a", "a"), ("b", "a")}
    res = noisy(spark.createDataFrame([(1, "e", "Entity", 0.5, "graph", "m"), (None, None, None, None, None, None)], "query_id long, entity_id string, result_type string, score double, source string, confidence_method string"))
    q = noisy(spark.createDataFrame([(1, 2)], "query_id long, n_wanted long"))
    assert [tuple(r) for r in rank_fusion.best_supported(res, q).collect()] == [(1, "e")]
    docs = noisy(spark.createDataFrame([(1, "hello world", "s"), (2, None, None)], "doc_id long, text string, source string"))
    assert tokens.encode_corpus(docs).count() == 4 and packing.pack_documents(docs, 16).count() == 4
    assert abuse.score_documents(docs, abuse.train_chain([], [], [])).count() == 4
    md = noisy(spark.createDataFrame([("m", "# H"), (None, None)], "markdown_id string, text string"))
    assert markup.records_with_markup(md, "markdown_id", "t").count() == 1 and markup.convert_markup(md).count() == 4
    pdf = noisy(spark.createDataFrame([("p", "GrÃ¶ÃŸe", None, "pdf:x", ["Ann Lee", None])], "paper_id string, title string, text string, extraction_source string, authors array<string>"))
    assert [tuple(r) for r in encoding.garbled_fields(encoding.restore_fields(pdf)).collect()] == [("p", "title")]
    ent = noisy(spark.createDataFrame(
        [("i", "Person", "Ann Lee", 0.5, "pdf:x", "D", None, None, [1.0, 2.0]), ("j", "Person", None, None, None, None, None, None, [1.0, 2.1])],
        "id string, type string, name string, confidence double, extraction_source string, description string, homepage string, category string, name_embedding array<float>",
    ).withColumn("observed_at", F.lit(None).cast("timestamp")).withColumn("ingested_at", F.lit(None).cast("timestamp")))
    m = names.entity_mentions(ent).unionByName(names.author_mentions(pdf))
    assert {tuple(r) for r in names.mention_pairs(names.linked_mentions(m)).collect()} == {("i", "p#0")}
    near = neighbours.neighbour_pairs(neighbours.nearest(neighbours.usable_vectors(ent, "k", "id", "name_embedding")))
    assert near.count() <= 1
    dec = noisy(spark.createDataFrame([("MERGE", "can", ["i", "j"]), (None, None, None)], "action string, canonical_id string, source_ids array<string>"))
    trust = noisy(spark.createDataFrame([("pdf", 0.9)], "source_kind string, trust double"))
    assert {(r.field_name, r.entity_id) for r in survivors.checked(survivors.survivors(dec, ent, trust)).collect()} == {("name", "i"), ("description", "i")}
