"""Exchanges, flow, repairs, compile decisions, schedules and containment on small cases, nulls and empty inputs among them."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import compile as compiling
from foliospark.operators import components, containment, exchange, flow, masking, repair, schedule
from foliospark.sources import shared, sinks


def test_numbered_answers(spark):
    items = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("a", 3, "three"), ("b", 1, "only"), ("c", 1, "x"), ("c", 2, "y")], "k string, i long, text string")
    replies = spark.createDataFrame([("a", "@@@0001@@@ first @@@END0001@@@\n@@@0003@@@old@@@END0003@@@ @@@0003@@@new\nline@@@END0003@@@ @@@0002@@@  @@@END0002@@@"), ("b", ""), ("c", "p\n\nq")], "k string, reply string")
    out = {(x.k, x.i): x.answer for x in exchange.answers(items, replies, "k").collect()}
    assert out == {("a", 1): "first", ("a", 2): "two", ("a", 3): "new\nline", ("b", 1): "only", ("c", 1): "x", ("c", 2): "y"}
    by_place = {(x.k, x.i): x.answer for x in exchange.answers(items, replies, "k", positional=True).collect()}
    assert by_place == out | {("c", 1): "p", ("c", 2): "q"}
    assert exchange.prompt(items.filter("k = 'c'"), "k").first().prompt == "@@@0001@@@\nx\n@@@END0001@@@\n@@@0002@@@\ny\n@@@END0002@@@"


def test_models_are_asked_only_where_needed(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, q string")
    out = {x.id: x.r for x in exchange.asked(rows, "q", "r", lambda q: q * 2, F.col("id") < 3).collect()}
    assert out == {1: "aa", 2: None, 3: None}
    tried = exchange.with_retries(rows, "q", lambda q, k: q if k else "no", lambda t, a: a == "no").collect()
    assert {(x.id, x.answer, x.attempts) for x in tried} == {(1, "a", 2), (2, None, 3), (3, "c", 2)}


def test_preserved_and_nested_tokens(spark, value):
    m = value(lambda t: masking.numbered_mask(t, masking.PRESERVED, "__PRESERVE_%__"), x="DNA is in [1, 2] and $x$, Dna is not")
    assert m.masked == "__PRESERVE_0__ is in __PRESERVE_1__ and __PRESERVE_2__, Dna is not" and m.kept == ["DNA", "[1, 2]", "$x$"]
    kept = F.array(*map(F.lit, m.kept))
    assert value(lambda t: masking.numbered_unmask(t, kept, "__PRESERVE_%__"), x="__PRESERVE_2__ __PRESERVE_0__ __PRESERVE_9__") == "$x$ DNA __PRESERVE_9__"
    tokens = F.array(*[F.struct(F.lit(t).alias("token"), F.lit("K").alias("kind"), F.lit(o).alias("original")) for t, o in (("<<A_0>>", "a"), ("<<B_1>>", "b<<A_0>>"), ("<<C_2>>", "c<<B_1>><<Z_9>>"))])
    assert value(lambda t: masking.restored(t, tokens), x="<<C_2>>|<<A_0>>|<<Q_1>>") == "cba<<Z_9>>|a|<<Q_1>>"


def test_contained(spark):
    texts = spark.createDataFrame([(1, "hello brave new world of text"), (2, "xalpha betay and gamma"), (3, None), (4, ""), (5, "a  b c d")], "doc_id long, text string")
    probes = spark.createDataFrame([(1, "brave new world"), (2, "alpha beta"), (3, "gam"), (4, ""), (5, None), (6, "o brave new world o"), (7, "of"), (8, "a b c d"), (9, "a  b c")], "item_id long, probe string")
    found = {(x.doc_id, x.item_id) for x in containment.contained(texts, "doc_id", "text", probes, "item_id", "probe").collect()}
    assert found == {(1, 1), (2, 2), (2, 3), (1, 6), (1, 7), (5, 9)}
    assert containment.contained(texts.limit(0), "doc_id", "text", probes, "item_id", "probe").count() == 0
    assert containment.contained(texts, "doc_id", "text", probes.limit(0), "item_id", "probe").count() == 0


def test_flow(spark):
    rows = spark.createDataFrame([(0, 10.0, 1, True, "E=mc"), (0, 12.0, 2, True, "F=ma"), (0, 14.0, 3, False, "(1)"), (0, 16.0, 4, False, " [2] "), (0, 90.0, 5, True, "far"), (0, 200.0, 6, False, "(3)")], "page int, y0 double, key long, is_equation boolean, text string")
    assert {(x.key, x.number) for x in flow.equation_numbers(rows, "page", ["y0"]).collect()} == {(1, "(1)"), (2, "[2]"), (5, None)}
    lines = spark.createDataFrame(list(enumerate(["intro", "References", "noise", "[1] First", "goes on", "", "[2] Second", "Appendix A", "[3] none"])), "i int, text string").withColumn("doc", F.lit("d"))
    assert {(x.number, x.text) for x in flow.references(lines, "doc", ["i"]).collect()} == {("[1]", "First goes on"), ("[2]", "Second")}
    notes = spark.createDataFrame([(0, 1, "body", 100.0), (0, 2, "* note", 700.0), (0, 3, "more", 710.0), (0, 4, "NIPS 2017", 720.0), (0, 5, "lost", 730.0), (0, 6, "† other", 740.0)], "page int, i int, text string, y1 double")
    assert {(x.marker, x.text) for x in flow.footnotes(notes, "page", ["i"], 792.0).collect()} == {("*", "* note more"), ("†", "† other")}
    tables = spark.createDataFrame([(0, 1, 100.0), (0, 2, 110.0), (0, 3, 0.0)], "page int, table long, y0 double")
    images = spark.createDataFrame([(0, 7, 105.0), (0, 8, 300.0)], "page int, image long, y0 double")
    assert {(x.table, x.image) for x in flow.table_images(tables, images).collect()} == {(1, 7), (2, 8)}
    with pytest.raises(Exception, match="no page 9"):
        flow.only_page(images, 9).collect()


def test_repairs_twice(spark):
    tex = "\\newcommand{\\C}{x}\n\\documentclass{a}\n\\includegraphics{f}\n\\begin{document}\n\\section{A\n"
    errors = ["! LaTeX Error: Command \\C already defined.", "! Undefined control sequence.", "Runaway argument?"]
    rows = spark.createDataFrame([(tex, errors), ("fine", []), ("fine", None), (None, errors)], "tex string, errors array<string>")
    once = repair.repaired(rows, "tex", "errors").collect()
    assert once[0].rules == [1, 12, 19, 37] and [x.tex for x in once[1:]] == ["fine", "fine", None]
    assert once[0].tex == "\\renewcommand{\\C}{x}\n\\documentclass{a}\n\\includegraphics{f}\n\\usepackage{graphicx}\n\\begin{document}\n\\section{A}\n"
    again = repair.repaired(spark.createDataFrame([(once[0].tex, errors)], "tex string, errors array<string>"), "tex", "errors").first()
    assert again.tex == once[0].tex and [r.number for r in repair.REPAIRS] == list(range(1, 55))


def test_compile_decisions(value):
    tex = "\\documentclass{a}\n\\usepackage[utf8]{inputenc}\n\\usepackage{babel}\nשלום"
    out = value(compiling.unicode_preamble, x=tex)
    assert "% \\usepackage[utf8]{inputenc}" in out and "% \\usepackage{babel}" in out and "\\setdefaultlanguage{hebrew}" in out and out.startswith("\\documentclass{a}\n\\usepackage{fontspec}")
    assert value(compiling.unicode_preamble, x=out) == out and value(compiling.unicode_preamble, x="\\documentclass{a}\nplain") == "\\documentclass{a}\nplain"
    assert [value(compiling.next_engine, x=e) for e in ("pdflatex", "xelatex", "lualatex")] == ["xelatex", "lualatex", None]
    assert value(lambda x: compiling.left_behind(x, "translated"), x="translated_fixed_2.aux") and not value(lambda x: compiling.left_behind(x, "translated"), x="translated.aux")


def test_schedules(spark):
    runs = spark.createDataFrame([("a", 1, False, 10.0), ("a", 2, True, 5.0), ("a", 3, False, 1.0), ("b", 1, False, 99.0)], "run string, t int, failed boolean, s double")
    assert {(x.run, x.t) for x in schedule.until_first_failure(runs, "run", ["t"], F.col("failed")).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert {(x.run, x.t) for x in schedule.within_budget(runs, "run", ["t"], F.col("s"), 12.0).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert [x[0] for x in runs.orderBy("run", "t").select(schedule.retry_pass(F.col("s"), 4.0)).collect()] == [2, 1, 0, None]


def test_sinks(value, spark):
    assert value(sinks.size_gate, x=None) == "list"
    assert value(lambda x: sinks.block_ladder(F.lit(None).cast("string"), x, F.lit("e"), F.lit("n")), x="p") == ("permanent", "p")
    rows = spark.createDataFrame([("p", "a.bbl", "\\bibitem{a}"), ("p", "b.bbl", "\\bibitem{a} longer"), ("p", "c.bbl", "no items, but the longest of all")], "paper string, path string, content string")
    assert sinks.installed_bbl(rows, "paper", "t").collect() == [("p", "t.bbl", "\\bibitem{a} longer")]


def test_components_and_shared_folder(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {x.node: x.root for x in components.components(edges).collect()}
    assert roots == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    monkeypatch.setattr(components, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError):
        components.components(edges)
    assert shared.shared_dir(spark).startswith("file:")


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
