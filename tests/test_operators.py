"""Chunking, masking, glossaries, layout, caches, sources, sinks and streams on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import cache, chunking, glossary, layout, masking, report
from foliospark.sources import files, sinks
from foliospark.streaming import progress


@pytest.mark.parametrize("tex,stat,count,token", [
    ("Hello world % This is a comment\nNext line", "comments", 1, "<<COMMENT_0>>"), ("Let $x^2 + y^2 = z^2$ be the equation.", "math_inline", 1, "<<MATH_INLINE_0>>"), ("a\n$$\nE = mc^2\n$$\nb", "math_display", 1, "<<MATH_DISP_0>>"),
    ("\\begin{tikzpicture}\\begin{scope}\\end{scope}\\end{tikzpicture}", "specialized", 1, "<<TIKZ_0>>"), ("\\citep[a][b]{k}", "commands", 1, "<<CMD_0>>[b]{k}"), ("\\verb|a$b| and \\lstinline!x!", "verbatim", 2, "<<CODE_1>>"),
    ("$a$ $b$", "math_inline", 2, "<<MATH_INLINE_0>> <<MATH_INLINE_1>>"), ("price \\$5 and 5\\% of $$q$$", "math_inline", 0, "\\$5"), ("\\includegraphics[w]{a{b}c}", "images", 1, "<<IMG_0>>"),
])
def test_masks(tex, stat, count, token):
    masked, tokens, stats = masking.mask_text(tex)
    assert stats[stat] == count and token in masked
    while any(t in masked for t, _, _ in tokens):
        for t, _, original in tokens:
            masked = masked.replace(t, original)
    assert masked == tex


def test_nested_environments_are_one_token():
    tex = "\\begin{align}a\\begin{align}b\\end{align}c\\end{align} tail"
    masked, tokens, _ = masking.mask_text(tex)
    assert masked == "<<MATH_DISP_0>> tail" and len(tokens) == 1


def test_round_trip(spark):
    tex = ["\\begin{equation} x % note\n\\end{equation} $a$ \\cite{k}", "", None, "plain", "<<MATH_9>> stays"]
    rows = spark.createDataFrame(list(enumerate(tex)), "id int, tex string")
    out = masking.masked(rows, "id", "tex").withColumn("back", masking.restored(F.col("masked"), F.col("tokens"))).withColumn("left", masking.leftovers(F.col("back"))).orderBy("id").collect()
    assert [x.back for x in out] == tex and out[4].left == ["<<MATH_9>>"]


def test_chunks(spark):
    tex = "\\documentclass{a}\n\\begin{document}\nIntro\n\n\\section{One}\ntext\n\n\\section{Two}\nmore\n\\begin{thebibliography}{9}\n\\bibitem{a} A\n\\bibitem{b} B\n\\end {thebibliography}\n\\appendix\nEnd\n\\end{document}"
    rows = spark.createDataFrame([(1, tex), (2, "no begin\n\nsecond\n\nthird"), (3, "")], "id int, tex string")
    out = chunking.chunks(rows, "id", "tex").orderBy("id", "ord").collect()
    first = [x for x in out if x.id == 1]
    assert [x.kind for x in first] == ["preamble", "intro", "section", "section", "bib", "paragraph"]
    assert [x.title for x in first if x.kind == "section"] == ["One", "Two"] and "appendix" not in first[4].text and first[4].text.endswith("\\end {thebibliography}")
    assert [x.text for x in out if x.id == 2] == ["no begin\n\nsecond\n\nthird\n\n"] and not [x for x in out if x.id == 3]
    small = chunking.chunks(rows, "id", "tex", 2).filter("id = 2").orderBy("ord").collect()
    assert [x.text for x in small] == ["no begin\n\n", "second\n\nthird\n\n"] and [x.chunk_id for x in small] == ["chunk_0_paragraph", "chunk_1_paragraph"]
    bib = chunking.chunks(rows.filter("id = 1"), "id", "tex", 8).filter("kind = 'bib'").orderBy("ord").collect()
    assert "".join(x.text for x in bib) == "\\begin{thebibliography}{9}\n\\bibitem{a} A\n\\bibitem{b} B\n\\end {thebibliography}" and len(bib) == 2


def test_assembled(spark):
    rows = spark.createDataFrame([("d", 1, "Hello <<MATH_0>>"), ("d", 0, "Start")], "id string, ord int, text string")
    tokens = F.array(F.struct(F.lit("<<MATH_0>>").alias("token"), F.lit("MATH").alias("kind"), F.lit("$x$").alias("original")))
    text = chunking.assembled(rows, "id").select(masking.restored(F.col("full_text"), tokens)).first()[0]
    assert text == "Start\n\nHello $x$"


def test_glossary(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"Machine Learning": "машинное обучение", "deep learning": {"ru": "глубокое", "zh": "深度"}, "n": 5, "éthe": "x"}, ensure_ascii=False))
    terms = files.glossary(spark, str(path))
    assert {(x.term, x.lang) for x in terms.collect()} == {("machine learning", None), ("deep learning", "ru"), ("deep learning", "zh"), ("éthe", None)}
    docs = spark.createDataFrame([(1, "this uses Machine Learning."), (2, "xdeep learnings"), (3, None), (4, "the éthe")], "id int, t string")
    assert {(x.id, x.term) for x in glossary.relevant_terms(docs, terms.unionByName(spark.createDataFrame([("the", None, "y")], terms.schema)), "id", "t").collect()} == {(1, "machine learning"), (4, "éthe"), (4, "the")}
    assert {x.term: x.translation for x in glossary.chosen(terms, "zh-CN").collect()} == {"deep learning": "深度"}


def test_cache(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string")
    kept = spark.createDataFrame([("a", "A")], "key string, reply string")
    assert {x.key: x.reply for x in cache.probed(asked, kept, "record").collect()} == {"a": "A", "b": None}
    assert {x.reply for x in cache.probed(asked, kept, "off").collect()} == {None}
    with pytest.raises(Exception, match="no cached reply for b"):
        cache.probed(asked, kept, "replay").collect()
    assert {x.key: x.reply for x in cache.translated(asked, kept, str.upper).collect()} == {"a": "A", "b": "Y"}


def test_layout(spark):
    rows = [(0, 3, "plain_text", 50.0, 700.0, 300.0, 780.0, "the text goes on-"), (1, 0, "page_header", 50.0, 5.0, 300.0, 20.0, "a header of the page"), (1, 1, "plain_text", 52.0, 30.0, 300.0, 90.0, "and ends on this page."), (1, 2, "plain_text", 52.0, 100.0, 300.0, 110.0, "another one, later")]
    df = spark.createDataFrame(rows, "page int, idx int, class_name string, x0 double, y0 double, x1 double, y1 double, text string")
    links = layout.continuations(df, 612.0, 792.0).collect()
    assert [(x.a_idx, x.b_idx, x.continuity, x.confidence) for x in links] == [(3, 1, "sentence", 1.0)]
    unit = layout.units(df, layout.continuations(df, 612.0, 792.0)).first()
    assert unit.full_text == "the text goes onand ends on this page." and unit.elements == 2
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 100.0, 100.0), (0, 2, 5.0, 5.0, 90.0, 90.0), (0, 3, 200.0, 0.0, 200.0, 50.0), (1, 4, 0.0, 0.0, 9.0, 9.0)], "page int, vec_id int, x0 double, y0 double, x1 double, y1 double")
    assert {x.vec_id for x in layout.distinct_images(boxes).collect()} == {1, 3, 4}


def test_reports(spark):
    rows = spark.createDataFrame([(1, ["b", "a"], True, "smoke"), (2, ["a", "cli_output_tail: x"], False, None), (3, ["b"], False, " Smoke ")], "id int, reasons array<string>, ok boolean, tier string")
    assert [(x.value, x.n) for x in report.histogram(rows, "reasons", "id").collect()] == [("b", 2), ("a", 2)]
    assert report.totals(rows).first().asDict() == {"total": 3, "passed": 1, "failed": 2}
    assert {x.id for x in report.in_tier(rows, "smoke").collect()} == {1, 3} and report.in_tier(rows, "all").count() == 3
    with pytest.raises(ValueError):
        report.in_tier(rows, "other")


def test_sources(spark, tmp_path):
    import io
    import tarfile

    archive = tmp_path / "p.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        for name, text in (("main.tex", "\\documentclass{a} \\input{sec/one} \\include{gone}"), ("sec/one.tex", "ONE \\input{two.tex}"), ("two.tex", "TWO"), ("../bad.tex", "no")):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    members = files.archive_members(spark, str(archive)).cache()
    assert {x.member for x in members.collect()} == {"main.tex", "sec/one.tex", "two.tex"}
    mains = files.main_files(members)
    assert files.flattened(members, mains).first().text == "\\documentclass{a} ONE TWO \\include{gone}"

    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/k1.json").write_text(json.dumps({"translated_content": "t", "input_tokens": 3}))
    (tmp_path / "cache/k2.json").write_text("{broken")
    assert [(x.key, x.translated_content, x.input_tokens) for x in files.cached_results(spark, str(tmp_path / "cache")).collect()] == [("k1", "t", 3)]

    (tmp_path / "c.json").write_text(json.dumps({"paper_id": "p", "lang": "ru", "masked_sha256": "s", "translated_by_index": {"0": {"order": 0, "text": "a", "type": "intro"}, "x": {"order": 1, "text": "b", "type": "intro"}}}))
    assert [(x.idx, x.text) for x in files.checkpoint(spark, str(tmp_path / "c.json"), "p", "RU", "s").collect()] == [(0, "a")]
    assert files.checkpoint(spark, str(tmp_path / "c.json"), "p", "ru", "other").count() == 0

    log = tmp_path / "run.log"
    log.write_text("Pipeline start\nTranslation complete: 9 input tokens, 9 output tokens\nPipeline start\nx Translation complete: 2361 input tokens, 2363 output tokens\n")
    cost = files.run_costs(spark, str(log), "Pipeline start").first()
    assert (cost.input_tokens, cost.output_tokens) == (2361, 2363) and float(cost.cost) == pytest.approx(2361e-6 * 1.25 + 2363e-5)

    (tmp_path / "bib").mkdir()
    for name, text in (("a.bbl", "\\bibitem{x}"), ("b.bbl", "\\bibitem{x} longer"), ("main.bbl", "\\bibitem{x} the longest of all"), ("c.bbl", "much longer but without any item")):
        (tmp_path / "bib" / name).write_text(text)
    (tmp_path / "bib/bad.txt").write_bytes(b"a\xffb")
    read = files.whole_files(spark, str(tmp_path / "bib"))
    assert files.fallback_bibliography(read, "main").first().path.endswith("/b.bbl")
    assert read.filter("path LIKE '%bad.txt'").select("text", files.utf8_or_latin1(F.col("content")).alias("l")).first()[:] == ("a\ufffdb", "aÿb")


def test_sinks(spark, tmp_path, value):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "paper string, idx int, text string")
    for _ in range(2):
        sinks.append_finished(rows, f"{tmp_path}/done", "paper", "idx")
    assert spark.read.parquet(f"{tmp_path}/done").count() == 2
    sinks.cache_results(spark.createDataFrame([("abc", "r")], "key string, reply string"), f"{tmp_path}/replies")
    assert (tmp_path / "replies/prefix=ab").exists()
    assert value(sinks.image_name(F.lit(2), F.lit(0), F.lit("x"), F.lit("png"))) == "img_p2_0_9dd4e461.png"
    assert value(sinks.storage(F.lit(6 * 1024 * 1024))) == "file.io"
    shown = value(sinks.page_properties(F.array(*[F.lit(f"a{k}") for k in range(12)]), F.lit("x" * 2100), F.array(F.lit("c"))))
    assert shown.authors.endswith("a9 and 2 more") and len(shown.abstract) == 2000
    known = spark.createDataFrame([("1", "k")], "arxiv_id string, label string")
    fresh = spark.createDataFrame([("1", "a", "article"), ("3", "b", "article"), ("2", "c", "odd")], "arxiv_id string, label string, documentclass string")
    assert {x.arxiv_id for x in sinks.upsert_new(known, fresh, "arxiv_id", ["article"], 5).collect()} == {"1", "3"}


def test_streams(spark, tmp_path):
    source, out, points = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/points"
    schema = "key string, ts timestamp"
    spark.sql("SELECT 'a' AS key, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:10:00'").write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    progress.resumable(stream(), lambda df: df.withColumn("n", F.lit(1)), out, points).awaitTermination()
    spark.sql("SELECT 'b' AS key, timestamp'2024-01-01 02:00:00' AS ts").write.mode("append").parquet(source)
    progress.resumable(stream(), lambda df: df.withColumn("n", F.lit(1)), out, points).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    for name, rows, mode in (("counts", progress.counts(stream(), "ts", "key"), "complete"), ("sessions", progress.sessions(stream(), "ts", "key"), "complete"), ("seen", progress.first_seen(stream(), "key", "ts"), "append")):
        query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(x.key, x.n) for x in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
    assert {(x.key, x.n) for x in spark.table("sessions").collect()} == {("a", 2), ("b", 1)}
    assert {x.key for x in spark.table("seen").collect()} == {"a", "b"}
    asked = progress.answered(stream(), spark.createDataFrame([("a", "r")], "key string, reply string"))
    asked.writeStream.format("memory").queryName("asked").trigger(availableNow=True).start().awaitTermination()
    assert {(x.key, x.reply) for x in spark.table("asked").collect()} == {("a", "r"), ("b", None)}
