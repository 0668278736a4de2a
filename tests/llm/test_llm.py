import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import abuse, components, encoding, markup, names, neighbours, packing, rank_fusion, survivors, tokens


# 1. one ranking ------------------------------------------------------------------------------------------------

RES = "query_id long, entity_id string, result_type string, score double, source string, confidence_method string"


def results(spark, rows):
    return spark.createDataFrame([(q, e, "Entity", s, src, src) for q, e, s, src in rows], RES)


def test_no_range_decides_alone(spark):
    rows = [(1, f"e{i}", 0.9 - i * 0.05, "graph") for i in range(8)] + [(1, f"e{i}", 0.8 - i * 0.04, "vector") for i in range(8)]
    rows += [(1, f"e{i}", 9.0 - i, "keyword") for i in range(8)] + [(1, "spam", 5000.0, "keyword"), (1, "nan", float("nan"), "keyword"), (1, "none", None, "graph"), (1, "inf", float("inf"), "vector")]
    rows += [(1, "e0", 0.9, "graph")]
    r = {x.entity_id: x["rank"] for x in rank_fusion.fused_ranking(results(spark, rows)).collect()}
    assert [r[f"e{i}"] for i in range(4)] == [1, 2, 3, 4] and r["spam"] > 4 and not {"nan", "none", "inf"} & set(r)


def test_ranking_does_not_change_with_scale(spark):
    rng = random.Random(5)
    base = [(1, f"e{i}", rng.random(), s) for i in range(20) for s in ("graph", "vector", "keyword")]
    other = [(q, e, s * 1000 - 7 if src == "keyword" else s, src) for q, e, s, src in base]
    a, b = ({x.entity_id: x["rank"] for x in rank_fusion.fused_ranking(results(spark, r)).collect()} for r in (base, other))
    assert a == b


def test_ties_and_empty_lists(spark):
    rows = [(1, "b", 1.0, "graph"), (1, "a", 1.0, "graph")]
    assert [x.entity_id for x in rank_fusion.fused_ranking(results(spark, rows)).orderBy("rank").collect()] == ["a", "b"]
    q = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "query_id long, n_wanted long")
    assert [tuple(x) for x in rank_fusion.best_supported(results(spark, rows), q).collect()] == [(1, "a")]
    assert rank_fusion.best_supported(results(spark, []), q).count() == 0


# 2. markup -----------------------------------------------------------------------------------------------------

PLAIN = [
    "It costs $5 today and $7 next year.", "Multiply x * y * z before rounding.", "Range 3 -- 5 (roughly ~5 %).", "a < b and c > d", "Paths such as C:\\temp\\new are rejected.", "Use 2 ** 8 buckets.",
    "See [12] and [14, 15].", "The operator == differs from =", "Write a | b.", "f(x) = x^2", "The array a[i](x) call", "The C# client is #4", "lo <= x <= hi", "List<String> and Map<String, Long>", "a->b and <-", "{0, 1} and |x|",
    "max_batch_size and _raw or _old", "R&D and Q&A; done", "don't 'quote' \"this\"", "see http://a.example/x?y=1&z=2", "", "  ", None,
]
MARKED = [
    "<p>x", "a<br/>b", "<TABLE BORDER=1><TR><TD>x", "<!-- c -->", "R&amp;D", "&#8217;tis", "We&nbsp;x", "&lt;p&gt;x", "# Head", "Head\n====", "x\n\n```py\ny\n```", "run `x()` now", "**b**", "an *em* word", "_never_ x", "~~x~~", "[t](http://u)", "![a](b.png)",
    "<https://x.example>", "[x]: https://y", "a[^1]", "- [ ] task", "- item", "1 | 2\n---|---\n3 | 4", "> Quote", "'''b'''", "''i''", "[[A|b]]", "{{cite}}", "{|\n|-\n| x\n|}", "== H ==", "[https://x.example y]", "\\section{X}", "\\textbf{x}", "x~\\cite{y}", "$x_{1}$", "\\(y\\)", "\\[z\\]", "$$\nx\n$$",
    "5\\% of", "``q''", "% draft here", "{\\em x}", "\\begin{itemize}\n\\item x\n\\end{itemize}", "a\r\n# H\r\nb", "<img src='fig.png' alt='figure'",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert markup.markup_kinds(text) == []
    assert markup.clean_text(text) is None if text is None else True


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_removed(text):
    assert markup.markup_kinds(text), text
    left = set(markup.markup_kinds(markup.clean_text(text)))
    assert not left - {"tex_math", "tex_command"}, (text, markup.clean_text(text))


def test_structure_is_kept():
    t = "# Title\n\nPara **one** <b>x</b>.\n\n* first\n* second\n\n```py\na = b * c * d  # <keep>\n```\n\n$$\n\\frac{a}{b}\n$$\n\n\\section{Two}\n\\begin{itemize}\n\\item three\n\\end{itemize}\nThe loss is $x_1$."
    assert [(k, b) for k, _, b in markup.to_blocks(t)] == [
        ("heading", "Title"), ("paragraph", "Para one x."), ("item", "first"), ("item", "second"), ("code", "a = b * c * d  # <keep>"), ("formula", "\\frac{a}{b}"), ("heading", "Two"), ("item", "three"), ("paragraph", "The loss is x_1."),
    ]


def test_tag_paths_drop_menus():
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(15))
    body = "".join(f"<p>Sentence number {i}, which has words, <b>commas</b> and a full stop at its end. And another one.</p>" for i in range(8))
    for top in (f"<nav><ul>{menu}</ul></nav>", f"<div>{menu.replace('li', 'div')}</div>"):
        text, n = markup.content_text(markup.tag_tree(f"<html><body>{top}<main><h2>H</h2>{body}<ul><li>one</li></ul></main></body></html>"))
        clean = markup.clean_text(text)
        assert n == 15 and "m7" not in clean and clean.count("commas") == 8 and "one" in clean and "H" in clean
    # a fragment: a row of links beside prose, without any html element
    text = "First sentence of the page, with a comma. " * 4 + "<div>" + "".join(f"<a href='{i}'>go</a> " for i in range(9)) + "</div>"
    assert "go" not in markup.clean_text(text) and "First" in markup.clean_text(text)


@pytest.mark.parametrize("text", ["[[%s]]", "a $x = %s$ b", "a **%s** b", "a *%s* b", "'" * 3 + "%s" + "'" * 3, "`%s`", "[%s](http://u)", "{{cite %s}}", "<a title='%s'>x</a>", "~~%s~~", "``%s''", "\\emph{%s}"])
def test_constructs_of_any_length_are_found(text):
    body = "word " * 200 + "end"
    kinds = markup.markup_kinds(text % body)
    assert kinds and kinds == markup.markup_kinds(text % "word end") and not markup.markup_kinds(body)
    assert "word word" in markup.clean_text(text % body) or "cite" in text or "title" in text


def test_markup_rows(spark):
    df = spark.createDataFrame([("a", "<p>x</p>"), ("a", "<p>x</p>"), ("b", None), ("c", "plain"), (None, "<p>")], "markdown_id string, text string")
    assert [tuple(r) for r in markup.records_with_markup(df, "markdown_id", "t").collect()] == [("t", "a")]
    assert markup.convert_markup(df).count() == 5 and markup.records_with_markup(df.limit(0), "markdown_id", "t").count() == 0


# 3. vectors ----------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(0)
    centre = r.standard_normal((60, 48))
    x = np.repeat(centre, 8, axis=0) + 0.7 * r.standard_normal((480, 48))
    rows = [(f"v{i:03d}", [float(z) for z in v]) for i, v in enumerate(x)] + [("n", None), ("z", [0.0] * 48), (None, [1.0] * 48), ("v000", [float(z) for z in x[0]]), ("bad", [float("nan")] * 48)]
    df = spark.createDataFrame(rows, "id string, e array<float>")
    near = neighbours.nearest(neighbours.usable_vectors(df, "k", "id", "e"))
    got = {tuple(p)[1:] for p in neighbours.neighbour_pairs(near).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 3 * np.eye(480)
    want = {tuple(sorted((f"v{i:03d}", f"v{j:03d}"))) for i in range(480) for j in np.argsort(-s[i])[:5]}
    assert len(want & got) / len(want) > 0.9 and all(a < b for a, b in got)
    assert neighbours.nearest(neighbours.usable_vectors(df.limit(0), "k", "id", "e")).count() == 0


def test_many_equal_vectors(spark):
    df = spark.range(300).select(F.format_string("i%04d", "id").alias("id"), F.array(*[F.lit(float(k % 3)).cast("float") for k in range(8)]).alias("e"))
    got = neighbours.neighbour_pairs(neighbours.nearest(neighbours.usable_vectors(df, "k", "id", "e"))).collect()
    linked = {x for p in got for x in (p.id_a, p.id_b)}
    assert len(linked) == 300 and len(got) <= 1500


def test_a_run_holds_all_rows_of_its_key():
    import pyarrow as pa

    keys = np.repeat([1, 2, 3], [70_000, 5, 20_000])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10_000])], ["cell"]) for i in range(0, len(keys), 10_000)]
    assert [t.num_rows for t in neighbours._runs(iter(batches), ["cell"])] == [70_000, 5, 20_000]


def test_large_cells_are_searched_whole():
    # two rows of nearly equal vectors, first and last of a cell beyond 30,000 rows, are found by its search
    import pyarrow as pa

    x = np.random.default_rng(3).standard_normal((40_000, 16)).astype(np.float32)
    x[-1] = x[0]
    x[-1, 0] += 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, fine = neighbours.Hashes(16, 1, 0).apply(x, 0)
    at = {"cell": pa.array(np.zeros(len(x), np.int64)), "g": pa.array(np.arange(len(x))), "fine": pa.array([f.tobytes() for f in fine], pa.binary()), "q": pa.array([q.tobytes() for q in neighbours.quantised(x)], pa.binary())}
    found = pa.Table.from_batches(list(neighbours._search(5)(iter(pa.table(at).to_batches(max_chunksize=10_000)))))
    assert (0, len(x) - 1) in set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))


def test_every_row_has_k_neighbours(spark):
    # unrelated vectors, and 15 equal ones whose members are each other's neighbours
    rng = np.random.default_rng(4)
    rows = [("x", f"r{i:03d}", v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)))]
    same = rng.standard_normal(16).tolist()
    rows += [("x", f"s{i:02d}", same) for i in range(15)]
    near = neighbours.nearest(spark.createDataFrame(rows, "kind string, id string, v array<float>")).collect()
    by = {}
    for r in near:
        by.setdefault(r.id, []).append(r.neighbour)
    assert len(by) == 315 and all(len(set(n)) == 5 for n in by.values())
    for i in range(15):
        assert sorted(by[f"s{i:02d}"]) == [f"s{j:02d}" for j in range(15) if j != i][:5]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [("x", f"r{i:03d}", rng.standard_normal(12).tolist()) for i in range(60)] + [("x", f"l{i}", rng.standard_normal(20).tolist()) for i in range(9)] + [("x", "s", [1.0, 2.0])]
    near = neighbours.nearest(spark.createDataFrame(rows, "kind string, id string, v array<float>")).collect()
    v = np.array([r[2] for r in rows[:60]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = {(r.id, r.neighbour): r.cosine for r in near}
    assert len({a for a, _ in cos}) == 60 and all(a[0] == b[0] == "r" for a, b in cos)
    assert all(abs(c - v[int(a[1:])] @ v[int(b[1:])]) < 0.02 for (a, b), c in cos.items())


def test_cells_are_of_like_size():
    x = np.random.default_rng(5).standard_normal((64_000, 24)).astype(np.float32) + 0.8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = neighbours.Hashes(24, 2, 4, x[:4096])
    for t in (0, 1):
        cell, _ = h.apply(x, t)
        assert len(np.unique(cell)) > 10 and np.bincount(cell.astype(int)).max() < 64_000 * 0.2


def test_many_cells_lose_no_neighbours(spark, monkeypatch):
    # small cells stand for many rows: what the borders of 60 times as many cells part must be met all the same
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    r = np.random.default_rng(8)
    n = 6007
    x = np.repeat(r.standard_normal((n // 8 + 1, 64)), 8, axis=0)[:n] + 0.65 * r.standard_normal((n, 64))
    df = spark.createDataFrame([("x", f"v{i:05d}", v) for i, v in enumerate(x.tolist())], "kind string, id string, v array<float>")
    got = {(a.id, a.neighbour) for a in neighbours.nearest(df).collect()}
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = u @ u.T - 3 * np.eye(n, dtype=np.float32)
    want = {(f"v{i:05d}", f"v{j:05d}") for i, t in enumerate(np.argpartition(-s, 5, axis=1)[:, :5]) for j in t}
    assert len(want & got) / len(want) > 0.92


def test_probed_cells_are_the_nearest():
    margin = np.random.default_rng(3).standard_normal((50, 7))
    cell = (margin > 0) @ (1 << np.arange(7))
    got = neighbours.probed_cells(cell, margin, 5)
    flips = (np.arange(128)[:, None] >> np.arange(7)) & 1
    want = cell[:, None] ^ np.argsort(margin**2 @ flips.T, axis=1)[:, :5]
    assert (got == want).all()


def test_plans_reach_their_share_at_any_number_of_rows():
    for n in (10_000, 200_000, 3_000_000, 50_000_000):
        coarse, copies, tables, reach = neighbours.plan(n)
        shares = neighbours.shared_cells(coarse, copies)
        assert n * copies / 2**coarse <= neighbours.CELL_ROWS
        assert (shares * (1 - reach) ** np.arange(len(shares))).sum() ** tables <= neighbours.MISSED + 1e-6


def test_a_hundred_thousand_rows_are_sent_once():
    # six copies of the vectors were sent to cells at every size
    for n in (60_000, 115_000):
        coarse, copies, tables, _ = neighbours.plan(n)
        assert coarse == 0 and copies * tables == 1


def test_candidates_are_ranked_by_exact_cosines(spark):
    # vectors off every grid of one byte, of cosines closer than that grid tells apart, beside some on a grid
    r = np.random.default_rng(12)
    x = np.concatenate([r.standard_normal(32) + 0.12 * r.standard_normal((300, 32)), r.integers(-9, 10, (40, 32))]).astype(np.float32)
    near = neighbours.nearest(spark.createDataFrame([("x", f"v{i:03d}", v) for i, v in enumerate(x.tolist())], "kind string, id string, v array<float>")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T - 3 * np.eye(len(x))
    want = {(f"v{i:03d}", f"v{j:03d}"): s[i, j] for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = {(n.id, n.neighbour): n.cosine for n in near}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def test_grid_vectors_are_packed_exactly():
    k = np.random.default_rng(1).integers(-31, 32, (50, 100)).astype(np.float32)
    k[:, 0] = 32
    q = neighbours.quantised(k / np.linalg.norm(k, axis=1, keepdims=True)).astype(np.float32)
    assert np.allclose(q / np.linalg.norm(q, axis=1, keepdims=True), k / np.linalg.norm(k, axis=1, keepdims=True), atol=1e-6)


def test_probe_sets_grow_in_cost():
    s = neighbours.probe_sets(6, 10)
    assert s[0] == (1,) and len(set(s)) == 10 and all(13 - j not in x for x in s for j in x)


# 4. encodings --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page", ["cp1252", "cp437", "mac_roman", "cp1251"])
def test_sequences_round_trip(page):
    text = "Größe und Länge, été «là» — “naïve” … 20 €"
    try:
        bad = text.encode().decode(page)
    except UnicodeDecodeError:
        bad = text.replace("”", "").encode().decode(page, "ignore")
        text = None
    fixed, n = encoding.repair_sequences(bad)
    assert n > 0 and (text is None or fixed == text)


def test_double_damage_and_controls():
    bad = "powtórzone źródła".encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.repair_sequences(bad)[0] == "powtórzone źródła"
    for ok in ("NÃO HÁ DADOS", "La cote « Ã » renvoie", "ÄÖÜ ÇÑ ÂÊÎ", "├── data\n│   └── raw", "Таблица «МИР» и «Р»", "漢字とかな", "20 °C ± 2 µm", "σ ≤ 0.5 ⇒ ∀x", ""):
        assert encoding.restore(ok, None) == (ok, 0, 0), ok
    for lost in ("Gr��e", "Provenance â?? a", "NastÄ?pny"):
        assert encoding.restore(lost, None)[2] > 0


def test_swaps_are_learned_per_source(spark):
    clean = [("p%d" % i, "Über größere Bestände und mögliche Dubletten", "Für jede Prüfung löscht die Übernahme ähnliche Einträge. Überprüft größere Bestände.", "pdf:%d" % i) for i in range(60)]
    bad = [("bad", None, clean[0][2].encode("mac_roman").decode("cp1252", "replace"), "pdf:bad"), ("utf", clean[0][1].encode().decode("latin-1"), "", "pdf:utf"), (None, "x", "y", None), ("nul", None, None, None)]
    df = spark.createDataFrame(clean + bad, "paper_id string, title string, text string, extraction_source string")
    r = encoding.restore_fields(df)
    rows = {(x.paper_id, x.field_name): x for x in r.collect()}
    assert {tuple(x) for x in encoding.garbled_fields(r).collect()} == {("bad", "text"), ("utf", "title")}
    assert rows["utf", "title"].restored_text == clean[0][1]
    assert rows["bad", "text"].restored_text == clean[0][2]
    assert encoding.restore_fields(df.limit(0)).count() == 0


# 5. names ------------------------------------------------------------------------------------------------------


def test_one_edit():
    assert all(names.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abc", "abxc"), ("abc", "axc")))
    assert not any(names.one_edit(a, b) for a, b in (("abc", "cab"), ("abcd", "badc"), ("a", "abc")))


def test_variants_link(spark):
    first = ["Margaret", "Edward", "Patricia", "Tariq", "Jorge", "Elena", "Oskar", "Leila"]
    last = ["Krovoputrel", "Zaheruzon", "Stupegokel", "Negredabak", "Hamotradres", "Vibridripol", "Skukenukam", "Greribrufo", "Lilukreror", "Meskegrubek"]
    base = [(f"b{i}", "Person", f"{f} {n}") for i, (f, n) in enumerate((f, n) for f in first for n in last if hash_of(f, n) % 4)]
    have = {x[2] for x in base} | {"Margaret Krovoputrel"}
    more = ["Margaret Krovoputrel", "Krövoputrel, M.", "Krovoputrel Margaret", "Meg Krovoputrel", "M. Krovoputrel", "Margaret Margaret Krovoputrel", "Dr. Margaret Krovoputrel", "MARGARET KROVOPUTREL", "MargaretKrovoputrel", "Margaret_Krovoputrel", "Margaret Krovoputrel’s", "Margaret Krovopurtel", "Margaret Krovoputrel Jr."]
    orgs = ["National Library of Zaibaum", "Natl. Lib. of Zaibaum", "Zaibaum National Library", "Zaibaum Foundation"]
    rows = [r for r in base if not r[2].endswith("Krovoputrel")] + [(f"m{i}", "Person", n) for i, n in enumerate(more)] + [(f"o{i}", "Organization", n) for i, n in enumerate(orgs)] + [("e", "Person", ""), ("d", "Person", "...")]
    assert have
    got = {r.id: r.cluster for r in names.linked_mentions(spark.createDataFrame(rows, "id string, kind string, name string")).collect()}
    assert len({got[f"m{i}"] for i in range(len(more))}) == 1, {more[i]: got[f"m{i}"] for i in range(len(more))}
    assert got["o0"] == got["o1"] == got["o2"] != got["o3"] and "e" not in got and "d" not in got
    assert len({c for i, c in got.items() if i[0] == "b"}) == len({r[2] for r in rows if r[0][0] == "b"})


def hash_of(*x):
    import zlib

    return zlib.crc32("".join(x).encode())


def test_rare_pairs_against_brute_force(spark):
    r = random.Random(2)
    words = {"".join(r.choice(["kru", "sto", "ba", "di", "le", "mo"]) for _ in range(3)) for _ in range(120)}
    words |= {w[:3] + w[4:] for w in list(words)[:40]} | {w[:2] + w[3] + w[2] + w[4:] for w in list(words)[:40]}
    words = sorted(words | {"".join(r.choice("abc") for _ in range(r.randrange(2, 6))) for _ in range(60)})
    df = spark.createDataFrame([("Person", w, 1) for w in words], "kind string, t string, n int")
    got = {(x.a, x.b) for x in names.rare_token_pairs(df).collect()}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if names.one_edit(a, b)}
    assert want <= got


def test_names_without_a_rare_part_and_in_other_scripts(spark):
    rows = [("a", "Person", "Иван Петров"), ("b", "Person", "иван петров"), ("c", "Organization", "Institute of Applied Science"), ("d", "Organization", "Inst. of Applied Science"), ("e", "Organization", "Karlsruhe Berlin Institute"), ("f", "Organization", "Karlsruhe Munich Institute"), ("g", "Organization", "Institute of Applied Science")]
    got = {r.id: r.cluster for r in names.linked_mentions(spark.createDataFrame(rows, "id string, kind string, name string")).collect()}
    assert got["a"] == got["b"] and got["c"] == got["g"] and got["e"] != got["f"]


# 6. survivors --------------------------------------------------------------------------------------------------


def test_survivors(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2025, 1, d)
    e = spark.createDataFrame([
        ("a", "Ann", "n/a", None, "x", 85.0, "pdf:1", t(2), t(3)), ("a", "Ann", "n/a", None, "x", 85.0, "pdf:1", t(2), t(4)), ("b", "Anne", "real", " ", "TBD", 0.9, "pdf:2", t(1), t(3)),
        ("c", "Ann", "other", "http://h", "unknown", 0.99, "web:1", t(9), t(9)), ("d", " ", None, None, None, -0.1, "zzz:1", t(1), t(1)),
    ], "id string, name string, description string, homepage string, category string, confidence double, extraction_source string, observed_at timestamp, ingested_at timestamp")
    d = spark.createDataFrame([("MERGE", "can", ["a", "b", "c", "c", "gone", None]), ("TENTATIVE", "two", ["d"]), ("NONE", "", ["a", "b"])], "action string, canonical_id string, source_ids array<string>")
    trust = spark.createDataFrame([("pdf", 0.85), ("web", 0.3)], "source_kind string, trust double")
    fused = survivors.survivors(d, e, trust)
    got = {(r.canonical_id, r.field_name): (r.entity_id, r.value) for r in survivors.checked(fused).collect()}
    assert got == {("can", "name"): ("b", "Anne"), ("can", "description"): ("b", "real"), ("can", "homepage"): ("c", "http://h"), ("can", "category"): ("a", "x")}
    assert survivors.checked(survivors.survivors(d.limit(0), e, trust)).count() == 0


def test_the_standing_needs_no_fusion(spark, tmp_path, monkeypatch):
    import datetime as dt

    from loomgraph.llm import queries

    t = lambda d: dt.datetime(2025, 1, d)
    r = random.Random(4)
    members = [(f"e{i:02d}", r.choice(["Ann", "Anne", " ", None]), r.choice(["x", "n/a", "y"]), None, r.choice(["c", "d"]), r.choice([0.5, 90.0, None]), r.choice(["pdf:1", "web:1", "zzz"]), t(r.randint(1, 3)), t(5)) for i in range(40)]
    tables = {
        "entities": spark.createDataFrame(members, "id string, name string, description string, homepage string, category string, confidence double, extraction_source string, observed_at timestamp, ingested_at timestamp"),
        "resolution_decisions": spark.createDataFrame([("MERGE", f"k{j}", [f"e{i:02d}" for i in range(j, 40, 8)]) for j in range(8)], "action string, canonical_id string, source_ids array<string>"),
        "source_trust": spark.createDataFrame([("pdf", 0.85), ("web", 0.3)], "source_kind string, trust double"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    fused = survivors.survivors(tables["resolution_decisions"], tables["entities"], tables["source_trust"])
    want = {tuple(x) for x in survivors.checked(fused).select("canonical_id", "field_name", "entity_id").collect()}
    monkeypatch.setattr(survivors, "estimate_sources", lambda *a, **k: pytest.fail("p6_found estimates sources that change nothing"))
    got = [tuple(x) for x in queries.p6_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 20 and set(got) == want


def claims_of(spark, groups):
    """Claims of one field from {group: [(source kind, value)]}; trust pdf 0.8, github 0.7, md 0.6, web 0.55."""
    import datetime as dt

    trust = {"pdf": 0.8, "github": 0.7, "md": 0.6, "web": 0.55}
    rows = [(g, f"{g}-{i}", f"{k}:{g}{i}", trust[k], 0.9, dt.datetime(2025, 1, 1), "category", v) for g, members in groups.items() for i, (k, v) in enumerate(members)]
    df = spark.createDataFrame(rows, "canonical_id string, entity_id string, extraction_source string, trust double, confidence double, observed_at timestamp, field_name string, value string")
    kinds, trusts = survivors.source_kinds(spark.createDataFrame(list(trust.items()), "source_kind string, trust double"))
    values = survivors.value_counts(df, kinds).cache()
    return values, survivors.estimate_sources(values, kinds, trusts)


def test_independent_votes_overrule_and_copied_votes_lose(spark):
    r = random.Random(6)
    groups = {}
    # pdf, github and md err independently; web takes over the errors of md
    for i in range(300):
        true = f"t{r.randrange(40)}"
        say = lambda p, true=true: true if r.random() < p else f"f{r.randrange(40)}"
        md = say(0.6)
        groups[f"g{i}"] = [("pdf", say(0.8)), ("github", say(0.75)), ("md", md), ("web", md if r.random() < 0.9 else say(0.5))]
    groups["votes"] = [("pdf", "alone"), ("github", "both"), ("md", "both")]
    groups["copies"] = [("pdf", "alone"), ("md", "copied"), ("web", "copied")]
    values, src = claims_of(spark, groups)
    at = {k: i for i, k in enumerate(src.kinds)}
    md_web, pdf_md = (tuple(sorted((at[a], at[b]))) for a, b in (("md", "web"), ("pdf", "md")))
    assert src.dependence["category"][md_web] > 0.99 and src.dependence["category"][pdf_md] < 0.1
    got = {x.canonical_id: (x.value, x.ahead["value"]) for x in survivors.fuse_values(values, src).collect()}
    assert got["votes"] == ("both", "alone") and got["copies"] == ("alone", "alone")


# 7. components -------------------------------------------------------------------------------------------------


def test_boruvka_against_union_find(spark):
    r = random.Random(9)
    rows = [(f" v{r.randrange(80)}", f"v{r.randrange(80)}\t", r.choice([0.7, 0.9, 0.69, None, float("nan")])) for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}", 0.8) for i in range(70)] + [("hub", f"h{i}", 0.9) for i in range(50)] + [(None, "x", 0.9), ("", "y", 0.9), ("s", "s", 1.0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, s in rows:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b and a != b and s is not None and s >= 0.7:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(rows, "id_a string, id_b string, score double")
    got = {x.id: x.group_id for x in components.consolidate(df).collect()}
    assert got == {v: find(v) for v in root}
    assert components.consolidate(df.limit(0)).count() == 0


# 8. tokenizer --------------------------------------------------------------------------------------------------


def test_encoding_equals_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.load_ranks()
    e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "Hello  world's\n\n  x", "aaaaaaaa" * 400, "<|endoftext|>", "漢字 Ðorfin 1234567", "x" * 5000, "ab" * 3000, "don't   stop\t", "é́ ﬁ 😀"]
    enc = tokens.SliceEncoder(ranks)
    assert enc.encode(texts) == [e.encode_ordinary(t) for t in texts]
    assert enc.encode([None, "", "Hello"]) == [[], [], e.encode_ordinary("Hello")]


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect()) == [(1, [64, 275]), (2, []), (3, []), (3, [])]


# 9. packing ----------------------------------------------------------------------------------------------------


def test_packing(spark):
    r = random.Random(4)
    words = ["graph", "paper", "index", "entity", "résumé", "zebra"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 90)))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, 128).collect()
    size = {}
    for x in got:
        assert (x.container_id is None) == (x.n_tokens == 0)
        size[x.container_id] = size.get(x.container_id, 0) + x.n_tokens
    assert all(v <= 128 for v in size.values())
    parts = {}
    for x in got:
        parts.setdefault(x.doc_id, []).append((x.part, x.n_tokens))
    enc = {x.doc_id: len(x.ids) for x in tokens.encode_corpus(df).collect()}
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == enc
    assert all(len(p) == max(1, -(-enc[d] // 128)) for d, p in parts.items())
    total = sum(enc.values())
    assert total / (128 * len([c for c in size if c])) > 0.95
    assert packing.pack_documents(df.limit(0), 128).count() == 0


def test_neighbours_by_any_term(spark):
    # the seed's 20 rarest words are its own; it shares two less rare words with a document smaller than the others
    own = " apple river stone cloud winter summer horse garden music bread silver window market forest bridge castle doctor planet island dragon"
    rows = [(1, own + " ocean mountain"), (2, " ocean mountain dog"), (3, " red blue green white"), (4, " seven eight nine ten")]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 26).collect()
    box = {r.doc_id: r.container_id for r in packed}
    assert [r.n_tokens for r in sorted(packed, key=lambda r: r.doc_id)] == [22, 3, 4, 4]
    assert box[1] == box[2] != box[3]


def test_neighbours_share_a_container():
    t = [np.array([1, 2]), np.array([1, 2]), np.array([3, 4]), np.array([3, 4])]
    w = [np.array([2.0, 2.0])] * 4
    box = packing.pack_shard([1, 2, 3, 4], [0] * 4, [50, 50, 50, 50], t, w, 100)
    assert box[0] == box[1] != box[2] == box[3]


# 10. abuse -----------------------------------------------------------------------------------------------------

BAD = ["You are a complete idiot and everybody knows it.", "Get lost, you m.o.r.o.n", "This was written by an 1d10t", "Show me your tits now.", "Halt die Fresse, du Vollidiot.", "Connard, ferme ta gueule.", "Vete al infierno, pedazo de mierda."]
FINE = ["Kill the child process and burn the old index.", "The term “moron” is an entry of the lexicon.", "My patch was stupid, sorry, I forgot the test.", "We measured recall of 0.9 on sparse graphs.", "The breast cancer registry links patients to trials.", "This garbage collector is stupidly fast."]


def labelled(n, bad_share=5, word=None, wrong=0.03):
    rng = random.Random(1)
    texts, label = [], []
    for i in range(n):
        bad = i % bad_share == 0
        body = [rng.choice(FINE).replace("0.9", str(rng.random())) for _ in range(4)] + ([rng.choice(BAD) if word is None or rng.random() < 0.5 else f"You {word}, {rng.choice(['go', 'leave', 'shut', 'be quiet'])} {rng.randrange(9)}."] if bad else [])
        rng.shuffle(body)
        texts.append(" ".join(body))
        label.append(int(bad if rng.random() > wrong else not bad))
    return texts, label


def test_trained_chain():
    texts, label = labelled(400)
    m = abuse.Scorer(abuse.train_chain(texts, label, ["insult" if x else None for x in label]))
    held = abuse.score_texts(BAD + FINE, m)[:, -1] >= 0.65
    assert held[: len(BAD)].all() and not held[len(BAD) :].any()
    assert (abuse.score_texts([None, "", "  "], m) == 0).all()
    assert (abuse.score_texts(BAD, abuse.Scorer(abuse.train_chain([], [], [])))[:, -1] < 1e-6).all()
    assert (abuse.score_texts(BAD, abuse.Scorer(abuse.train_chain(FINE, [0] * len(FINE), [None] * len(FINE))))[:, -1] < 1e-6).all()


def test_a_new_word_is_learned_from_labels_alone():
    texts, label = labelled(400, word="zorbliger")
    chain = abuse.train_chain(texts, label, [None] * len(label))
    m = abuse.Scorer(chain)
    p = abuse.score_texts(["You zorbliger, never come back.", "You z.o.r.b.l.i.g.e.r, never come back.", "You z0rbl1ger, leave.", "You reviewer, the tables come later."], m)[:, -1]
    assert "zorbliger" in chain.lexicon and (p[:3] >= 0.65).all() and p[3] < 0.65


def test_abuse_rows(spark):
    docs = spark.createDataFrame([(1, FINE[0], "s"), (2, BAD[0], "s"), (3, None, None), (4, "x " * 20000, "s")], "doc_id long, text string, source string")
    texts, label = labelled(200, wrong=0)
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "train") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(1, 0, None), (2, 1, "insult"), (9, 1, "hate"), (None, 1, None)] + [(100 + i, a, None) for i, a in enumerate(label)], "doc_id long, abusive long, category string")
    s = abuse.score_documents(docs, abuse.train_from_tables(docs, labels)).where("doc_id < 100")
    assert {r.doc_id for r in s.where("abusive >= 0.65").collect()} == {2}
    assert {(r.source, r.n_docs, r.n_abusive) for r in abuse.rates_by_source(s, 0.65).collect()} == {("s", 3, 1), (None, 1, 0)}
    assert abuse.score_documents(docs.limit(0), abuse.train_from_tables(docs, labels.limit(0))).count() == 0
