"""BPE against the reference tokenizer library; language identification on held-out rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foliospark.llm import bpe, language

DOCS = "/root/testdata/sf0.001/documents.parquet"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def random_text(r, most=60):
    alphabet = "aab  bc'ltsé\n\t0ñ中😀.,!THEthe-_=   "
    return "".join(r.choice(alphabet) for _ in range(r.randrange(0, most)))


def test_encoding_equals_library(vocabulary, library):
    encoder, r = bpe.Encoder(vocabulary), random.Random(1)
    for text in [random_text(r) for _ in range(400)] + ["x" * 5000, "<|endoftext|>", "ab" * 3000, ""]:
        assert np.frombuffer(encoder.encode(text), dtype=np.int32).tolist() == library.encode_ordinary(text)


def test_appends_and_edits(vocabulary, library):
    r = random.Random(2)
    for _ in range(300):
        text = random_text(r)
        k = r.randrange(0, len(text) + 1)
        document = bpe.DocumentEncoding(vocabulary, text[:k])
        document.append(text[k:])
        assert document.tokens() == library.encode_ordinary(text)
        data = text.encode()
        a = r.randrange(0, len(data) + 1)
        b, new = r.randrange(a, len(data) + 1), random_text(r, 9).encode()
        piece = bpe.PrefixEncoding(vocabulary, data)
        piece.edit(a, b, new)
        assert piece.data == data[:a] + new + data[b:]
        assert piece.last == bpe.PrefixEncoding(vocabulary, piece.data).last


def test_edit_is_local(vocabulary):
    piece = bpe.PrefixEncoding(vocabulary, b"abcdefghijklmnopqrstuvwxyz" * 400)
    assert piece.edit(100, 101, b"Q") < 200


def test_operator(spark, library):
    rows = spark.read.parquet(DOCS).select("doc_id", "text", F.lit(1).alias("ids"), "lang").unionByName(spark.createDataFrame([(-1, None, 1, None), (-2, "", 1, "x")], "doc_id long, text string, ids int, lang string"))
    out = bpe.decode(bpe.encode(rows, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == rows.count()
    both = bpe.recode(rows, PATH, public_tokenizers.PATTERN)
    assert sorted(map(str, both.collect())) == sorted(map(str, out))
    for row in out:
        assert row.ids == library.encode_ordinary(row.text or "") and bytes(row.decoded) == (row.text or "").encode()
    assert bpe.encode(rows.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def brute_phrases(text, sample):
    """Greedy parse of the whole normalised text by substring search."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_parse_equals_substring_search():
    samples = {"x": ["the cat sat on the mat, the end"], "y": ["la casa del gato en la mesa"]}
    parser = language.CrossParser(samples)
    r = random.Random(4)
    texts = ["the cat on the table", "el gato!! en casa 12", "zzz", "The The the " * 400, "q", "", "the cat sat on the mat, the end" * 60, "za" * 2000]
    texts += [" ".join(r.choice(["the", "cat", "gato", "en", "la", "zz", "mat"]) for _ in range(2500))]
    total, lengths = parser.phrases(texts)
    for k, name in enumerate(parser.languages):
        sample = "".join(map(chr, parser.symbols("\n".join(samples[name]))))
        for i, text in enumerate(texts):
            plain = "".join(map(chr, parser.symbols(text)))
            assert lengths[i] == len(plain) and total[k, i] == brute_phrases(plain, sample)


def test_large_alphabets():
    """Every sampled letter keeps its own symbol, those beyond U+FFFF too: languages of thousands of letters are told apart."""
    r = random.Random(7)
    han, hangul, gothic = ([chr(a + k) for k in range(n)] for a, n in ((0x4E00, 3000), (0xAC00, 3000), (0x10330, 17)))
    words = {name: ["".join(r.choice(letters) for _ in range(2)) for _ in range(800)] for name, letters in (("han", han), ("han2", han), ("hangul", hangul), ("gothic", gothic))}
    text = lambda name, n: " ".join(r.choice(words[name]) for _ in range(n))
    samples = {name: [text(name, 2000)] for name in words}
    parser = language.CrossParser(samples)
    sampled = {c for texts in samples.values() for c in texts[0] if c != " "}
    assert len({int(parser.symbol[ord(c)]) for c in sampled}) == len(sampled) > 250
    names = list(words) * 5
    texts = [text(name, 60) for name in names]
    assert parser.predict(texts)[0] == names and (parser.predict(texts)[1] > 0).all()
    total, lengths = parser.phrases(texts)
    for k, name in enumerate(parser.languages):
        sample = "".join(map(chr, parser.symbols(samples[name][0])))
        assert [brute_phrases("".join(map(chr, parser.symbols(t))), sample) for t in texts] == total[k].tolist()


def test_predictions_and_ties_equal_plain_ones():
    """The fewest bits win; of equal ones the longer matches over all places, then the first by name."""
    r = random.Random(5)
    words = ["ab", "abc", "bca", "cab", "a", "c", "cc", "ba"]
    samples = {name: [" ".join(r.choice(words) for _ in range(12))] for name in "zyx"}
    samples["w"] = samples["x"]
    parser = language.CrossParser(samples)
    plain = lambda t: "".join(map(chr, parser.symbols(t)))
    normal = {name: plain("\n".join(t)) for name, t in samples.items()}

    def judge(text):
        p, scored = plain(text), {}
        for name, own in normal.items():
            bits = brute_phrases(p, own) * float(np.log2(len(own)))
            match = sum(next(n for n in range(len(p) - i, -1, -1) if p[i : i + n] in own) for i in range(len(p)))
            scored[name] = (bits, -match, name)
        return min(scored, key=scored.get)

    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(150)] + [samples["x"][0], "a" * 300]
    assert parser.predict(texts)[0] == [judge(t) for t in texts]


def test_queries_of_tokens_and_languages(spark, library):
    """op5 and op6 as registered, over the whole table."""
    import hashlib

    text = {x.doc_id: x.text or "" for x in spark.read.parquet(DOCS).select("doc_id", "text").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = bpe.op5_bpe_codec(spark, DOCS.rsplit("/", 1)[0]).collect()
    assert sorted(x.doc_id for x in out) == sorted(text)
    for x in out:
        ids = library.encode_ordinary(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text[x.doc_id].encode()))
    out = language.op6_language_id(spark, DOCS.rsplit("/", 1)[0])
    assert dict(out.dtypes)["held_out"] == "boolean" and dict(out.dtypes)["score"] == "double"
    rows = out.collect()
    assert sorted(x.doc_id for x in rows) == sorted(text)
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in text[x.doc_id]))


def test_many_languages_share_the_sample(spark, monkeypatch):
    rows = [(k, f"word{k % 7} " * 200, f"l{k % 7}") for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "ALL_CHARS", 7 * 600)
    assert max(len(x) for x in [language.fit(df).bits]) == 7
    monkeypatch.setattr(language, "ALL_CHARS", 700)
    with pytest.raises(ValueError):
        language.fit(df)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.fit(docs)).withColumn("held", language.held_out(F.col("doc_id"))).filter("held").collect()
    assert all((zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert sum(x.lang == x.lang_pred for x in out) / len(out) > 0.97
    assert all(0 <= x.score <= 1 for x in out)


def test_language_edges(spark):
    rows = [(1, "hello there world", "en"), (2, "bonjour le monde", "fr"), (3, None, "en"), (4, "12 34 !!", None), (5, "", None), (6, "the world", None), (None, "le monde", None), (6, "the world", None)]
    df = spark.createDataFrame(rows * 1, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = [(x.doc_id, x.text, x.lang_pred, x.score) for x in language.identify(df, language.fit(df)).collect()]
    assert len(out) == len(rows)
    assert all(p == "und" and s == 0 for _, t, p, s in out if not t or not any(c.isalpha() for c in t))
    assert language.identify(df.limit(0), language.fit(df.limit(0))).count() == 0
    assert {x.lang_pred for x in language.identify(df, language.fit(df.limit(0))).collect()} == {"und"}
