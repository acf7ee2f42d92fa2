"""Deduplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, near_dedup, repeats, store, substring_dedup, suffix_array_dedup
from foliospark.operators import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(row):
    return tuple((x is None, str(x)) for x in row)


def corpus(seed):
    """Documents of shared pieces, with copies, repeated rows, nulls, empty and periodic texts."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)] + ["é", "ñ中", "a", "the"]
    pool = [[r.choice(vocab) for _ in range(r.randrange(5, 80))] for _ in range(6)]
    rows = []
    for k in range(100):
        w = []
        for _ in range(r.randrange(0, 4)):
            p, a = (q := r.choice(pool)), r.randrange(0, len(q))
            w += p[a : a + r.randrange(1, 60)] if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        if r.random() < 0.1:
            w = ["x"] * r.randrange(0, 60)
        text = " ".join(w)
        rows.append((k, text.replace(" ", "\n\t", 3) if r.random() < 0.2 else text))
    return rows + [(500 + j, rows[j * 3][1]) for j in range(8)] + [(None, rows[3][1]), (None, None), (7, rows[9][1]), (900, ""), (901, None), rows[5]]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"kb": F.lit("extra"), "least": F.lit(1), "n": F.lit(2)})  # names that the operators use themselves


def brute_words(rows, width):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for s in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[s : s + width])
            least[key] = min(least.get(key, 1 << 60), i)
    out = []
    for i, w in docs:
        gone = {j for s in range(len(w) - width + 1 if i is not None else 0) if least[tuple(w[s : s + width])] < i for j in range(s, s + width)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone).encode()))
    return sorted(out, key=order)


def brute_bytes(rows, width):
    docs = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + width] for _, b in docs for s in range(len(b) - width + 1))
    out = []
    for i, b in docs:
        gone = {j for s in range(len(b) - width + 1) if count[b[s : s + width]] > 1 for j in range(s, s + width)}
        spans = sum(j in gone and j - 1 not in gone for j in range(len(b)))
        out.append((i, len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone)))
    return sorted(out, key=order)


def wide_corpus(seed):
    """corpus() with a very long text, one long word and texts of some shared words."""
    rows = corpus(seed)
    long = " ".join(t or "" for _, t in rows)
    return [*rows, (950, long * 6), (951, "z" * 40_000 + " " + long), (952, "\x00 \x00" * 90)]


@pytest.mark.parametrize("seed,width,prefixes,most", [(1, 12, (4, 8), 2 << 20), (2, 20, (10,), 2 << 20), (5, 12, (4, 6, 9), 600), (6, 20, (10, 15), 0)])
def test_substrings(spark, monkeypatch, seed, width, prefixes, most):
    """Groups that fit, groups that need longer prefixes, and windows that are their own prefix."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", most)
    monkeypatch.setattr(repeats, "TOGETHER", 50)
    rows = wide_corpus(seed)
    got = [(x.doc_id, x.n_units, x.n_removed, bytes(x.kept)) for x in substring_dedup.substring_dedup(frame(spark, rows), width, prefixes).collect()]
    assert sorted(got, key=order) == brute_words(rows, width)


@pytest.mark.parametrize("seed,width,grams,most", [(3, 40, (10, 20), 2 << 20), (4, 60, (25,), 2 << 20), (7, 40, (10, 15, 30), 600), (8, 60, (25, 40), 0)])
def test_suffix_arrays(spark, monkeypatch, seed, width, grams, most):
    monkeypatch.setattr(repeats, "GROUP_BYTES", most)
    monkeypatch.setattr(suffix_array_dedup, "SHARD", 16)
    rows = wide_corpus(seed)
    got = [(x.doc_id, x.n_units, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_array_dedup.suffix_array_dedup(frame(spark, rows), width, grams).collect()]
    assert sorted(got, key=order) == brute_bytes(rows, width)


def test_planted_passages_of_bytes(spark, tmp_path):
    """The query at its 400 bytes: `n_removed` tells planted documents from clean ones, whatever their length (`n_bytes`)."""
    r = random.Random(9)
    words = lambda n, size: " ".join("".join(r.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    long, short = words(60, 7), words(60, 5)  # over 50 words both, of 479 and of 359 bytes
    planted = {k: long if k % 3 == 0 else short if k % 3 == 1 else "" for k in range(60)}
    rows = [(k, " ".join([words(r.randrange(5, 200), 6), p, words(r.randrange(5, 200), 6)])) for k, p in planted.items()]
    path = f"{tmp_path}/documents.parquet"
    frame(spark, rows).repartition(3).write.parquet(path)
    got = [tuple(x) for x in suffix_array_dedup.op7_suffix_array_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=order) == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_bytes(rows, 400)]
    assert {x[0] for x in got if x[2] > 0} == {k for k, p in planted.items() if p == long}
    assert all(x[1] == len(rows[x[0]][1]) for x in got)


def test_windows_too_long_for_a_place(spark):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(frame(spark, corpus(1)), 2000, (10, 25))
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(frame(spark, corpus(1)), 20, (20,))


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_subtrees():
    """Preorder, parting depths and deep internal nodes against sorted suffixes."""
    import numpy as np

    r = random.Random(9)
    for _ in range(30):
        texts = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 9))]
        texts += [t[:] for t in texts[:2]]
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes) - sizes
        suffix = {int(first[k]) + j: t[j:] for k, t in enumerate(texts) for j in range(len(t))}
        leaves = np.array(sorted(suffix))
        at, parting = substring_dedup.subtree(np.concatenate([np.array(t, dtype=np.uint64) for t in texts]), sizes, leaves)
        assert sorted(at) == leaves.tolist() and parting[0] == 0
        assert [suffix[i] for i in at] == sorted(suffix.values())
        assert parting[1:].tolist() == [common(suffix[a], suffix[b]) for a, b in zip(at, at[1:])]
        node = substring_dedup.deep_nodes(parting, 4)
        groups = {}
        for k, i in enumerate(at):
            groups.setdefault(int(node[k]), []).append(suffix[i])
        for own in groups.values():
            assert len(own) == 1 or len({tuple(s[:4]) for s in own}) == 1
        deep = [tuple(s[:4]) for own in groups.values() for s in own[:1] if len(s) >= 4]
        assert len(deep) == len(set(deep))


def test_transform_and_merge():
    """Shard transforms against sorted rotations, the merged one against the transform of all rows at once, common prefixes against plain ones."""
    import numpy as np

    r = np.random.default_rng(0)
    rows = r.integers(1, 3, (70, 9))
    rows[40:60] = rows[:20]
    shards = [rows[:30], rows[30:31], rows[31:]]
    rotations = [[(tuple(np.roll([*x, 0], -k)), i, k) for i, x in enumerate(part) for k in range(10)] for part in shards]
    for part, rot in zip(shards, rotations):
        before, begins = suffix_array_dedup.transform(part)
        ranked = sorted(rot)
        assert before.tolist() == [x[0][-1] for x in ranked] and begins.tolist() == [i if k == 0 else -1 for _, i, k in ranked]
    at, shared = suffix_array_dedup.merge([suffix_array_dedup.transform(p)[0] for p in shards])
    flat = [x[0] for rot in rotations for x in sorted(rot)]
    merged = [flat[i] for i in at]
    assert merged == sorted(flat)
    assert [min(int(x), 10) for x in shared[1:]] == [common(a, b) for a, b in zip(merged, merged[1:])]
    assert [flat[i][-1] for i in at] == suffix_array_dedup.transform(rows)[0].tolist()


def test_merged_orders():
    import numpy as np

    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 99, 24, dtype=np.uint8)) for _ in range(300)]
    texts += texts[:50] + [t[:9] + bytes(15) for t in texts[:50]]
    symbols = np.frombuffer(b"".join(texts), dtype=">u8").reshape(-1, 3).astype(np.uint64)
    at, shared = suffix_array_dedup.merged_order(symbols, shard=40)
    ordered = [texts[i] for i in at]
    assert ordered == sorted(texts)
    assert shared[1:].tolist() == [common(a, b) for a, b in zip(ordered, ordered[1:])]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_near(rows, num):
    sets, parent = [shingles(t) for _, t in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and (a == b or 100 * common >= num * (len(sets[i]) + len(sets[j]) - common)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)], key=order)


@pytest.mark.parametrize("num,bucket,block", [(85, 32, 256), (80, 3, 3)])
def test_near_duplicates(spark, monkeypatch, num, bucket, block):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(num)
    vocab = [f"W{k}" for k in range(300)] + ["é", "the", "a"]
    texts = []
    for size, copies in ((3, 2), (6, 5), (30, 4), (120, 30), (200, 12), (200, 1)):
        base = [r.choice(vocab) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w[r.randrange(0, 2) :]))
    r.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (9000, None), (9001, " \n "), (9002, texts[5].upper())]
    rows.append(rows[3])
    got = sorted([tuple(x) for x in near_dedup.near_duplicates(frame(spark, rows), num).collect()], key=order)
    assert got == brute_near(rows, num)


def test_sketches_fill_and_estimate():
    import numpy as np

    r = np.random.default_rng(1)
    shared, x, y = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate((shared, x))), np.unique(np.concatenate((shared, y))), np.array([5], dtype=np.uint64)]
    owner = np.repeat([0, 1, 2], [len(s) for s in sets])
    sketch = near_dedup.sketches(np.concatenate(sets), owner, 4, 256)
    assert (sketch[:3] != near_dedup.EMPTY).all() and (sketch[3] == near_dedup.EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e for e in edges if e[0] != e[1])}


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    return Counter((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t])) for (i, _), t in zip(rows, norm))


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, tmp_path, weak):
    """Also with a digest of few values, so that different texts meet and full bytes decide."""
    rows = corpus(6)
    path = f"{tmp_path}/documents.parquet"
    frame(spark, rows).repartition(5).write.parquet(path)
    digest = (lambda norm: (F.crc32(norm.cast("binary")) % 7).cast("string")) if weak else exact_dedup.sha
    out = exact_dedup.exact_dedup(spark, path, digest, files_per_batch=2).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size) for x in out) == brute_exact(rows)
    kept = Counter(x.text_sha256 for x in out if x.kept)
    assert set(kept.values()) == {1} and len(kept) == len({x.text_sha256 for x in out})


def test_exact_goes_on_from_its_state(spark, tmp_path):
    """A second run over a table that has grown takes only the new files through the stream, and agrees with a run over all."""
    rows = corpus(8)
    path, state = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    frame(spark, rows[:60]).repartition(3).write.parquet(path)
    first = exact_dedup.exact_dedup(spark, path, state=state).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size) for x in first) == brute_exact(rows[:60])
    frame(spark, rows[60:]).repartition(2).write.mode("append").parquet(path)
    both = exact_dedup.exact_dedup(spark, path, state=state).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size) for x in both) == brute_exact(rows)
    assert len(list((tmp_path / "state" / "changes").glob("changes=*"))) == 2


def test_shuffled_branches_agree(spark, tmp_path, monkeypatch):
    """What is broadcast while small is joined by shuffles beyond the bound, with the same rows."""
    rows = corpus(9)
    path = f"{tmp_path}/documents.parquet"
    frame(spark, rows).repartition(3).write.parquet(path)
    runs = []
    for bound in (store.BROADCAST_BYTES, 0):
        monkeypatch.setattr(store, "BROADCAST_BYTES", bound)
        near = near_dedup.near_duplicates(frame(spark, rows[:60]), 85).collect()
        runs.append([sorted(map(str, x)) for x in (exact_dedup.exact_dedup(spark, path).collect(), near, substring_dedup.substring_dedup(frame(spark, rows), 12, (4, 8)).collect())])
    assert runs[0] == runs[1]


def test_recall_at_the_threshold():
    """Pairs of sets just at the threshold share a band and pass the sketch filter."""
    import numpy as np

    r = np.random.default_rng(4)
    for num in (85, 80):
        share, found, pairs = num / 100, 0, 1000
        for _ in range(pairs // 50):
            sets = []
            for _ in range(50):
                union = r.integers(0, 1 << 63, 400, dtype=np.uint64)
                own = (400 - 4 * num) // 2
                sets += [np.unique(union[: 400 - own]), np.unique(union[own:])]
            owner = np.repeat(np.arange(100), [len(s) for s in sets])
            width = near_dedup.rows_for(share)
            sketch = near_dedup.sketches(np.concatenate(sets), owner, 100, max(near_dedup.BANDS * width, near_dedup.FILTER))
            keys = near_dedup.band_keys(sketch[:, : near_dedup.BANDS * width], near_dedup.BANDS, width)
            marks = sketch[:, : near_dedup.FILTER]
            alike = (marks[::2] == marks[1::2]).mean(axis=1) >= share - 6 * float(np.sqrt(share * (1 - share) / near_dedup.FILTER))
            found += int(((keys[::2] == keys[1::2]).any(axis=1) & alike).sum())
        assert found / pairs > 0.99


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    path = f"{tmp_path}/documents.parquet"
    none.write.parquet(path)
    assert exact_dedup.exact_dedup(spark, path).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_array_dedup.suffix_array_dedup(none).count() == 0
