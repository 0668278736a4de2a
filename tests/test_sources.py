import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import files, graph, sinks


def test_markdown_and_repository(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "docs" / "a.md").write_bytes(b"intro\n## The *Title*\n`code` **bold** \xff")
    (tmp_path / "docs" / "empty.md").write_text("```\nonly code\n```")
    (tmp_path / "docs" / "b.rst").write_text("plain rst")
    (tmp_path / "docs" / "big.md").write_text("x" * 200_001)
    (tmp_path / "node_modules" / "c.md").write_text("skipped")
    md = {Path(r.file_path).name: r for r in files.read_markdown(spark, str(tmp_path / "docs")).collect()}
    assert md["a.md"].title == "The *Title*" and "bold" in md["a.md"].text and "code" not in md["a.md"].text and len(md["a.md"].file_hash) == 64
    repo = files.read_repository(spark, str(tmp_path), "r", "u", "sha").collect()
    assert {Path(r.path).name for r in repo} == {"a.md", "b.rst"} and repo[0].commit_sha == "sha"


def test_pdf_with_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|  |three")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b" | ")
    (tmp_path / "d.txt").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"boom")

    def parse(b):
        if b == b"boom":
            raise ValueError("broken")
        return b.decode().split("|"), "T", None

    good, bad = files.read_pdf(spark, str(tmp_path), parse)
    (g,) = good.collect()
    assert (g.title, g.page_count, g.text, g.authors) == ("T", 3, "--- Page 1 ---\none\n--- Page 3 ---\nthree", [])
    assert {Path(r.file_path).name: r.reason for r in bad.collect()} == {"c.pdf": "no text", "d.txt": "not a .pdf file", "e.pdf": "ValueError: broken"}


def test_web_and_titles(spark):
    p = spark.createDataFrame([("http://a.example/x", "<html><title> T </title><script>no()</script><p>Hi <b>you</b></p>")], "url string, html string")
    r = files.read_web(p).first()
    assert (r.domain, r.title, r.text) == ("a.example", "T", "Hi you")
    d = spark.createDataFrame([("a", None, "N"), ("b", "", None), ("c", "C", "x")], "id string, title string, name string")
    assert {(x.id, x.title) for x in graph.source_titles(d, d).collect()} == {("a", "N"), ("c", "C")}


def test_queries_with_parameters_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert graph.run_query(spark, "SELECT * FROM t WHERE n > :k", {"t": df}, {"k": 1}).count() == 1
    (tmp_path / "a.json").write_text('{"x": 1,\n "rows": [{"a": 1}, {"a": 2}]}')
    assert graph.read_artifact(spark, str(tmp_path / "a.json"), "rows").count() == 2


def test_constraints_and_vectors(spark):
    a = spark.createDataFrame([("a", "x")], "id string, name string")
    with pytest.raises(ValueError):
        sinks.create_nodes(a, a)
    assert sinks.create_nodes(a, a.withColumn("id", F.lit("b"))).count() == 2
    v = spark.createDataFrame([("a", [1.0]), ("zz", [2.0])], "id string, v array<float>")
    assert [tuple(r) for r in sinks.set_vectors(a, v, "embedding").collect()] == [("a", "x", [1.0])]
    with pytest.raises(ValueError):
        sinks.set_vectors(a, v, "name")


def test_clear_source(spark):
    n = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", None)], "id string, extraction_source string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "source_id string, target_id string")
    kept, edges, gone = sinks.clear_source(n, e, "s1")
    assert {r.id for r in kept.collect()} == {"b", "c"} and edges.count() == 1 and gone.first().removed == 1


def test_core_needs_no_training_data_package():
    root = str(Path(__file__).resolve().parent.parent)
    code = "import sys; sys.path.insert(0, %r); sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('p1_') for k in q)" % root
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
