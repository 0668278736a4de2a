import pytest
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.functions import text as X

NAMES = {
    "AIDAN HOGAN": "aidan hogan", "OpenAI Inc.": "openai", "Google LLC": "google", "Acme Co., Ltd.": "acme", "Co": "co", "Ltd Industries": "ltd industries", "Wikidata's": "wikidata",
    "OpenAI’s": "openai", "Hogan, Aidan": "hogan aidan", "RDF-star": "rdf star", "knowledge_graph": "knowledge graph", "Óscar Corcho": "oscar corcho", "𝐸. Negative": "e negative",
    "The RDF4J Client": "rdf4j client", "The Acme Co.": "acme", "A. Smola": "a smola", "The": "the",
}


def column(spark, values, expr, extra=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select(F.col("i"), expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normalized_names(spark):
    assert column(spark, list(NAMES), X.normalized) == list(NAMES.values())
    assert column(spark, [None, "", "  "], X.normalized) == [None, "", ""]


def test_name_forms(spark):
    got = column(spark, ["christopher d manning", "a smola", "t m hospedales", ""], X.name_forms)
    assert got == [["christopher d manning", "christopher manning"], ["a smola"], ["t m hospedales"], []]


def test_slug_and_source_nodes(spark):
    assert column(spark, ["  A--b  C! ", "", "!!", None], X.slug) == ["a_b_c", "unnamed", "unnamed", "unnamed"]
    assert column(spark, ["pdf:Some File.pdf", "md:x.md", "github:a-b", "web:q"], X.source_node_id) == ["paper_some_file_pdf", "markdown_x_md", "repo_a_b", None]


def test_stutter_and_risk(spark):
    assert column(spark, ["a a b", "rdf reading rdf reading", "one two", "x", "ab ab"], X.has_stutter) == [True, True, False, False, True]
    assert column(spark, ["a b c", "a b c d", "aa b c d"], X.is_risky) == [True, True, False]


def test_noise_and_markdown(spark):
    assert column(spark, ["=>", "a1", "ab", " http://x", "WWW.site"], X.is_noise) == [True, True, False, True, True]
    assert column(spark, ["# T\n**b** [l](u) `c` ![i](s) <br>x"], X.clean_markdown) == ["T\nb l   x"]


def test_byline_and_author_split(spark):
    text = "--- Page 1 ---\nJOURNAL HEADER 2021\nA Title\nAnna Bell, and Carl Dorn, Member, IEEE\nAbstract\nno\n--- Page 2 ---\nEve Faux"
    assert column(spark, [text], X.byline) == [["A Title", "Anna Bell", "Carl Dorn"]]
    assert column(spark, ["x, , senior member,  and Y Z"], X.split_names) == [["x", "Y Z"]]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_ratio_against_table():
    import random

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randrange(12))) for _ in "ab")
        assert S._common(a, b) == lcs(a, b) == S._common(b, a)


@pytest.mark.parametrize(("a", "b", "want"), [("rdf", "rdfs", 0.8571), ("erik cambria", "e cambria", 0.8571), ("z zhang", "z zhan", 0.9231), ("aidan hogan", "hogan aidan", 1.0)])
def test_string_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(S.string_similarity(F.col("a"), F.col("b"))).first()[0] == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.70710678) < 1e-6 and got[1] is None and got[2] is None
