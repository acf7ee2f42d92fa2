"""Fingerprints, sharding, lines, mixing and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import fingerprints, line_dedup, mixing, sharding

ROWS = [(4, "One line. Second sentence.\nNext line", "a"), (1, "", "b"), (9, None, None), (7, "é中😀" * 9, "a"), (2, "same text here", "c"), (3, "same text here", "c"), (None, "no id", None), (4, "One line. Second sentence.\nNext line", "a"), (4, "other text", "a"), (12, "word " * 3000, "d")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "no": F.lit("x"), "size": F.lit(2), "bucket": F.lit(3)})


def test_fingerprints(spark):
    got = fingerprints.merkle_fingerprints(frame(spark)).collect()
    assert len(got) == len(ROWS)
    texts = {}
    for i, t, _ in ROWS:
        texts.setdefault((i, t or ""), None)
    by = defaultdict(set)
    for x in got:
        by[(x.doc_id, x.n_chars)].add((x.edited_sha256, x.fingerprint))
    assert all(len(v) == 1 for k, v in by.items() if k[0] != 4)
    ids = sorted({i for i, _, _ in ROWS if i is not None and i != 4})
    order = [i for i in ids if i < 4] + [4] + [i for i in ids if i > 4] + [None]
    text = {i: t or "" for i, t, _ in ROWS}
    for x in got:
        k = order.index(x.doc_id)
        if x.doc_id == 4 or order[(k + 1) % len(order)] == 4:
            continue
        own, after = text[x.doc_id], text[order[(k + 1) % len(order)]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (x.fingerprint == x.edited_fingerprint) == (edited == own)
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    assert fingerprints.merkle_fingerprints(frame(spark).limit(0)).count() == 0
    alone = fingerprints.merkle_fingerprints(frame(spark, [(1, "a b. c d.", "x")])).first()
    assert alone.near_next == 1 and alone.next_id == 1


def brute_paragraphs(text):
    text = text.replace("\x01", "\x01\x02")
    out = []
    for p in re.split(r"(?<=\n)|(?<=[.!?][ \t-\r])(?=[^ \t-\r])", text):
        if len(p) <= 100:
            out.append(p)
            continue
        piece = ""
        for k, t in enumerate(re.findall("[\u2e80-\U0010ffff]|[^\x20\x09-\x0D\u2e80-\U0010ffff]{1,64}[\x20\x09-\x0D]{0,64}|[\x20\x09-\x0D]{1,64}", p)):
            piece += t
            if (ord(t[0]) + len(t)) % 8 == 0 or k % 64 == 63:
                out.append(piece)
                piece = ""
        out.append(piece)
    assert "".join(out) == text
    return [p for p in out if p]


def brute_fingerprint(text):
    """The tree from its leaves upwards."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    runs, run = [], []
    for p in brute_paragraphs(text):
        run.append(sha(p))
        if run[-1][-1] in "01":
            runs, run = runs + [run], []
    if run or not runs:
        runs.append(run)
    sections = [sha(",".join(r)) for r in runs]
    return sha(",".join(sections)) + ";" + ";".join(f"{h}:" + ",".join(leaf[:12] for leaf in r) for h, r in zip(sections, runs))


def test_tree_and_likeness(spark):
    rows = [(x.text,) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [("",), ("\n\n",), ("a.\nb! c? d",)]
    rows += [("word " * 3000,), ("x" * 9000,), ("中文" * 300 + " end\x01\x02 of it " * 30,), (" \t" * 900,), ("a\x01b" * 60,)]
    rows = [r for r in rows if r[0] is not None]
    out = spark.createDataFrame(rows, "text string").select("text", fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    trees = [(x.f, brute_fingerprint(x.text)) for x in out]
    for got, want in trees:
        assert got == want
        heads = ",".join(s.split(":")[0] for s in got.split(";")[1:])
        assert got[:64] == hashlib.sha256(heads.encode()).hexdigest()  # the root from its children
    long = "".join(f"Sentence number {k} here. " for k in range(60))
    changed = long.replace("number 30 here", "number 30 there")
    row = spark.createDataFrame([(long, changed)], "a string, b string")
    fa, fb = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    x = row.select(fingerprints.likeness(fa, fb).alias("near"), fingerprints.changes(fa, fb).alias("c"), fingerprints.changes(fa, fa).alias("same"), fa.alias("fa"), fb.alias("fb")).first()
    assert x.near == pytest.approx(59 / 60) and x.c.leaves == 1 and x.c.sections in (1, 2) and x.same == (0, 0, None)
    section, leaf = map(int, x.c.first.split("/"))
    before = sum(len(s.split(",")) for s in x.fa.split(";")[1 : 1 + section])
    assert before + leaf == 30 and x.fa[:64] != x.fb[:64]


def test_edits_in_long_lines_are_located(spark):
    """A long line, text of wide characters and one repeated word: half of the text changed leaves about half of the leaves."""
    r = random.Random(3)
    line = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(3000))
    wide = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(3000))
    for text in (line, wide):
        a, b = (spark.createDataFrame([(x,)], "t string") for x in (text, text[: len(text) // 2] + text[: len(text) // 2][::-1]))
        fa, fb = (d.select(fingerprints.fingerprint(F.col("t"))).first()[0] for d in (a, b))
        near = spark.range(1).select(fingerprints.likeness(F.lit(fa), F.lit(fb))).first()[0]
        assert 0.4 < near < 0.6
        assert max(map(len, brute_paragraphs(text))) < 1200


def test_permutation():
    for rows in (1, 2, 3, 10, 1000, 4097):
        image = sharding.permute(np.arange(rows), rows, seed=5)
        assert sorted(image) == list(range(rows))
        assert (sharding.permute(image, rows, seed=5, inverse=True) == np.arange(rows)).all()
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).any()


def test_shards(spark):
    got = sharding.feistel_shards(frame(spark), shards=4).collect()
    assert len(got) == len(ROWS)
    count = Counter(x.shard for x in got)
    assert set(count) == {0, 1, 2, 3} and max(count.values()) - min(count.values()) <= 1
    for shard in count:
        assert sorted(x.slot for x in got if x.shard == shard) == list(range(count[shard]))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == expected
    again = sharding.feistel_shards(frame(spark, ROWS[::-1]).repartition(3), shards=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.feistel_shards(frame(spark).limit(0)).count() == 0


def test_lines(spark):
    r = random.Random(0)
    sites = [f"s{k}" for k in range(12)]
    rows = [(k, "\n".join([r.choice(("Cookie notice", " Cookie  notice ", "Sign up")), f"unique text number {k} that is long", "", f"shared by few {k % 6 // 5}"]), sites[k % 12]) for k in range(48)]
    rows += [(100 + k, "Cookie notice\nSign up", sites[k % 12]) for k in range(5)] + [(200, None, "s1"), (201, "", None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"line": F.lit(1), "gone": F.lit(2), "n_lines": F.lit("x")})
    spread = defaultdict(set)
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    for _, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            spread[plain(line)].add(s)
    expected = Counter()
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        bad = [plain(x) != "" and len(spread[plain(x)]) >= 8 for x in lines]
        cut = sum(len(x) for x, b in zip(lines, bad) if b) <= 0.5 * sum(map(len, lines))
        gone = [b and cut for b in bad]
        expected[(i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone))] += 1
    got = Counter((x.doc_id, x.text, x.n_lines, x.n_removed) for x in line_dedup.line_dedup(df, most=0.5).collect())
    assert got == expected and sum(k[3] for k in got) > 0
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_of_any_share(spark):
    """Boilerplate that is most of a document goes; the text that many sites copy keeps its lines, but not those of other texts."""
    copied = "An article\nthat ten sites have\nCookie notice"
    rows = [(k, f"Cookie notice of this site\nown {k}", f"s{k}") for k in range(9)] + [(20 + k, copied, f"s{k}") for k in range(10)]
    rows += [(40 + k, f"Cookie notice\n{k}", f"s{k}") for k in range(8)] + [(60, "Cookie notice", "s0"), (61, "that ten sites have\nalone", "s1")]
    out = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    expected = {k: (f"own {k}", 2, 1) for k in range(9)} | {20 + k: ("An article\nthat ten sites have", 3, 1) for k in range(10)}
    assert out == expected | {40 + k: (f"{k}", 2, 1) for k in range(8)} | {60: ("", 1, 1), 61: ("alone", 2, 1)}


def test_pipeline_cuts_lines_of_any_share(spark):
    import corpus_pipeline as P

    rows = [(k, f"Cookie notice of this site\nown {k}", "en", f"s{k}", 0) for k in range(9)]
    got = P.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert {(x.doc_id, x.text, x.n_chars) for x in got} == {(k, f"own {k}", 5) for k in range(9)}


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= epochs * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(epochs * sizes[s])
            rest -= target[s]
        free -= over
    return target


def test_mix(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" * r.randrange(0, 40)), r.choice(["a", "b", "b", "b", "c", "d", None])) for k in range(400)] + [(1000, None, "e"), (1001, "x " * 5, "f"), (3, "repeat me", "a"), (3, "repeat me", "a"), (None, "p q", "a")]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for x in got:
        assert x.target == pytest.approx(target[x.source]) and x.source_size == sizes[x.source]
        assert x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 25 for s in sizes)
    assert Counter((x.doc_id, x.taken) for x in mixing.mix(frame(spark, rows).repartition(7)).collect()) == Counter((x.doc_id, x.taken) for x in got)
    assert mixing.mixed_documents(frame(spark, rows)).count() == sum(x.repeats for x in got)
    assert mixing.mix(frame(spark).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version over its own input."""
    import corpus_pipeline as P
    import public_tokenizers
    import tiktoken

    from foliospark.llm import bpe, near_dedup

    from test_dedup import brute_near

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(5000, None, "en", "src1", 0), (5001, "!! 12", "en", None, 5), (None, "the text without a number is here", None, "src2", 33)]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    inputs = []
    for name, stage in P.STAGES:
        inputs.append(now)
        out = f"{tmp_path}/{name}"
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(out)
        now = spark.read.parquet(out)
        if name != "bpe":
            assert now.columns == P.COLUMNS
    assert {x.doc_id for x in inputs[0].select("doc_id").collect()} - {x.doc_id for x in inputs[1].select("doc_id").collect()} == {5000, 5001}
    before = [(x.doc_id, x.text) for x in inputs[2].collect()]
    keep = {x[0] for x in brute_near(before, 80) if x[3]}
    assert Counter(x.doc_id for x in inputs[3].select("doc_id").collect()) == Counter(keep)
    repeats = {x.doc_id: x.repeats for x in mixing.mix(inputs[3]).collect()}
    assert Counter(x.doc_id for x in inputs[4].select("doc_id").collect()) == Counter({k: v for k, v in repeats.items() if v})
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.Vocabulary(f.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {x.doc_id: x.text for x in inputs[4].collect()}
    final = now.collect()
    assert len(final) == inputs[4].count() and all(x.round_trip and x.ids == library.encode_ordinary(text[x.doc_id]) for x in final)
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0 and near_dedup.BANDS == 40


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as P

    words = lambda a: " ".join(f"w{a + k}" for k in range(60))
    rows = [(3, words(0)), (3, words(100)), (4, words(200)), (4, words(200) + " more"), (5, words(100) + " more"), (6, words(300)), (6, words(300)), (None, words(0))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((x.doc_id, x.text.split()[0]) for x in P.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(3, "w0"), (3, "w100"), (4, "w200"), (6, "w300"), (None, "w0")])


def test_tables_are_written_in_few_files(spark):
    """However many the shuffle partitions; a file starts processes that count with their executor's whole memory."""
    from foliospark.llm import store
    from foliospark.operators import components

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 120)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(600).selectExpr("id + 1 AS a", "id - id % 3 AS b")
        out = store.save(edges.groupBy("a").agg(F.min("b").alias("b")), "few")
        roots = store.save(components.components(edges), "few-roots")
        most = max(4 * spark.sparkContext.defaultParallelism, 15)
        assert out.select(F.input_file_name()).distinct().count() <= most and roots.select(F.input_file_name()).distinct().count() <= most
        assert sorted(out.collect()) == sorted(edges.collect()) and roots.count() == 601
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline_sets_batches_of_whole_texts(spark):
    import corpus_pipeline as P

    from foliospark.llm import store

    docs = spark.createDataFrame([(1, "some words", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(P.STAGES)
    for name in ("language_id", "near_dedup", "bpe"):
        for key in store.ARROW:
            spark.conf.unset(key)
        stages[name](spark, docs, "")
        assert {k: spark.conf.get(k) for k in store.ARROW} == {k: ours for k, (_, ours) in store.ARROW.items()}, name


def test_a_worker_keeps_one_operators_tables():
    from foliospark.llm import store

    store.kept("bpe")["a"] = 1
    assert store.kept("bpe") == {"a": 1}
    store.kept("language")["m"] = 2
    assert store.KEPT == {"language": {"m": 2}} and store.kept("bpe") == {}


def test_registry():
    from foliospark.llm import registry

    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_pipeline_on_empty_and_odd_tables(spark):
    """No rows, columns of clashing names, nulls in every column and a very long text."""
    import corpus_pipeline as P

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("x") for c in ("key", "h", "g", "row", "repeats", "lang_pred", "score", "n_lines", "ids", "size", "bucket", "kept")}
    long = " ".join(f"word{k % 977} of line {k}" for k in range(9_000))
    odd = [(1, long, None, None, None), (None, None, None, None, None), (2, None, "en", "s", 1), (None, "some words in a row without a number", "en", None, 5), (3, "", "en", "s", 0), (4, long + " end", "en", "t", None)]
    for rows in ([], odd):
        now = spark.createDataFrame(rows, shape)
        for name, stage in P.STAGES:
            now = stage(spark, now.withColumns({k: v for k, v in clash.items() if k not in now.columns}), "")
            if name != "bpe":
                assert now.columns == P.COLUMNS
                now = spark.createDataFrame(now.collect(), shape)
        out = now.collect()
        ids = {x.doc_id for x in out}
        assert all(x.round_trip for x in out) and ({1} <= ids <= {1, None} if rows is odd else not ids)  # 4 copies 1; 2 and 3 have no letter


def test_very_long_texts(spark):
    """A document of a hundred thousand words, forty thousand lines, among short ones."""
    from foliospark.llm import language, near_dedup

    long = "\n".join(f"own line {k}\nshared by sites" for k in range(20_000))
    rows = [(k, f"shared by sites\nshort {k}", f"s{k}") for k in range(9)] + [(100, long, "s0"), (101, long + " more", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert cut[100].n_removed == 20_000 and cut[100].text == "\n".join(f"own line {k}" for k in range(20_000)) and cut[3].text == "short 3"
    near = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()}
    assert near[101] == near[100] == 100
    parser = language.CrossParser({"a": ["own line shared by sites"], "b": ["eigene zeile"]})
    assert parser.predict([long, "eigene zeile"])[0] == ["a", "b"]
