"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has a coordinate for each of t bins. In each of the first t rounds every shingle is hashed to a bin and a
value; a bin keeps the least value of the first round that reached it. Bins still empty then take, in t more rounds,
the least value of all shingles, so every coordinate fills, and the estimate is concentrated as if shingles were
sampled without replacement. Documents with an equal band of coordinates are candidates, and a link is confirmed on
the full shingle sets.

Equal sets are one node. Candidates of a bucket are not paired off: all are compared with one of them, and only where
the bucket still holds several components are members of different components compared, until every such pair of a
bucket has been compared or joined. A pair whose sketches agree far less than linked sets' would (six standard errors
under the threshold) is let go without its sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store, vectors
from foliospark.operators import components
from foliospark.sources.shared import few_files

WIDTH = 5
BANDS = 40
#: Coordinates of a sketch, a byte of each, by which pairs are let go.
FILTER = 128
#: Buckets up to this size are compared at once; in larger ones rounds of one against all come first, then blocks against blocks.
SMALL_BUCKET = 32
ROUNDS = 2
BLOCK = 256
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their documents. A to Z count as a to z."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    at, to, doc = vectors.words(lower, starts, ends)
    values = vectors.word_hashes(lower, at, to)
    count = np.bincount(doc, minlength=len(starts)) if len(doc) else np.zeros(len(starts), dtype=np.int64)
    n = len(values)
    grams, owner = vectors.window_hashes(values, width, vectors.ITEM_BASE), doc[: max(n - width + 1, 0)]
    inside = owner == doc[width - 1 :] if n >= width else np.zeros(0, dtype=bool)
    grams, owner = grams[inside], owner[inside]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # fewer words: the whole sequence
        first = np.cumsum(count) - count
        whole = vectors.range_hashes(values, first[short], first[short] + count[short], vectors.ITEM_BASE)
        grams, owner = np.concatenate((grams, vectors.mix64(whole))), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def sketches(sets: np.ndarray, owner: np.ndarray, documents: int, size: int) -> np.ndarray:
    """documents x size coordinates; a document without shingles keeps EMPTY in all."""
    out = np.full(documents * size, EMPTY, dtype=np.uint64)
    for k in range(2 * size):
        if not len(sets):
            break
        hashed = vectors.mix64(sets ^ vectors.mix64(np.array([k + 1], dtype=np.uint64))[0])
        bins = (hashed >> np.uint64(32)) % np.uint64(size) if k < size else np.full(len(sets), k - size, dtype=np.uint64)
        value = np.uint64(k) << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)
        np.minimum.at(out, owner * size + bins.astype(np.int64), value)
        lacking = (out.reshape(documents, size) == EMPTY).any(axis=1)
        if k < 2 * size - 1:
            more = lacking[owner]
            sets, owner = sets[more], owner[more]
    return out.reshape(documents, size)


def rows_for(share: float) -> int:
    """Coordinates a band, so that BANDS bands miss a pair at the threshold less than once in 100,000."""
    return max(1, int(np.log(1 - 1e-5 ** (1 / BANDS)) / np.log(share))) if share < 1 else 16


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))
    for k in range(rows):
        keys = vectors.mix64(keys * np.uint64(vectors.ITEM_BASE) + parts[:, :, k])
    return keys.view(np.int64)


def set_digests(sets: np.ndarray, owner: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two order-free 64-bit hashes of it."""
    count = np.bincount(owner, minlength=documents) if len(owner) else np.zeros(documents, dtype=np.int64)
    ends = np.cumsum(count)
    out = []
    for seed in (1, 2):
        sums = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(vectors.mix64(sets ^ np.uint64(seed * vectors.BYTE_BASE & (1 << 64) - 1)), out=sums[1:])
        out.append((sums[ends] - sums[ends - count]).view(np.int64))
    return count, *out


def _sketch_rows(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, h1, h2, bands, sketch (a byte of each of FILTER coordinates) for docs(doc_id, text)."""

    def run(tables):
        import pyarrow as pa

        store.kept("near")
        for table in tables:
            for row, data, starts, ends in vectors.batches(table.column("text")):
                sets, owner = shingle_sets(data, starts, ends, width)
                many = len(starts)
                n, h1, h2 = set_digests(sets, owner, many)
                sketch = sketches(sets, owner, many, max(bands * rows, FILTER))
                keys = band_keys(sketch[:, : bands * rows], bands, rows)
                marks = (vectors.mix64(sketch[:, :FILTER]) & np.uint64(255)).astype(np.uint8)
                marks = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer((np.arange(many + 1, dtype=np.int32) * FILTER).tobytes()), pa.py_buffer(marks.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([table.column("doc_id").slice(row, many), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), lists, marks], names=["doc_id", "n", "h1", "h2", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, sketch binary")


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, h1, h2, shingles (sorted 64-bit numbers) for docs(doc_id, text)."""

    def run(tables):
        import pyarrow as pa

        store.kept("near")
        for table in tables:
            for row, data, starts, ends in vectors.batches(table.column("text")):
                sets, owner = shingle_sets(data, starts, ends, width)
                many = len(starts)
                n, h1, h2 = set_digests(sets, owner, many)
                offsets = (np.concatenate(([0], np.cumsum(n))) * 8).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([table.column("doc_id").slice(row, many), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), packed], names=["doc_id", "n", "h1", "h2", "shingles"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, shingles binary")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) with linked: den * |intersection| >= num * |union| of the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(tables):
        import pyarrow as pa

        store.kept("near")
        for table in tables:
            linked = []
            for x, y in zip(table.column("sa"), table.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if num * len(y) <= den * len(x) else 0
                linked.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([table.column("a"), table.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    joined = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _alike(pairs: DataFrame, share: float) -> DataFrame:
    """a < b, each once, of pairs(a, b, ma, mb, na, nb) whose sizes allow a link and whose sketches do not speak against it."""
    least = share - 6 * float(np.sqrt(share * (1 - share) / FILTER))

    def run(tables):
        import pyarrow as pa

        store.kept("near")
        for table in tables:
            marks = [np.frombuffer(table.column(k).buffers()[2], dtype=np.uint8, count=FILTER * table.num_rows, offset=table.column(k).offset * FILTER).reshape(-1, FILTER) for k in ("ma", "mb")] if table.num_rows else None
            if marks is None:
                continue
            stay = np.flatnonzero((marks[0] == marks[1]).mean(axis=1) >= least)
            a, b = (table.column(k).to_numpy(zero_copy_only=False)[stay] for k in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    sized = pairs.filter((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(share - 1e-9)))
    return sized.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def _common_counts(x: list, y: list) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y (sorted 64-bit numbers), by products of incidence matrices."""
    sizes = np.array([len(v) for v in (*x, *y)])
    values, column = np.unique(np.concatenate((*x, *y)), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    stay = shared[column]
    column, owner = number[column[stay]], owner[stay]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for a in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (a, a + 4096))
        has = np.zeros((len(sizes), 4096), dtype=np.float32)
        has[owner[lo:hi], column[lo:hi] - a] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out.astype(np.int64)


def _block_links(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between different components in the large buckets open_(bucket, node, root), blocks of members against blocks.

    The bucket's most common component needs no comparison inside; its blocks meet only those of the others. A row goes
    to as many places as the bucket has blocks of the other kind, not to every pair.
    """
    count = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    main = count.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"))
    blocks = main.select("bucket", F.col("m.root").alias("main"), F.ceil(F.col("m.c") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).alias("others"))
    rows = open_.join(blocks, "bucket").withColumn("is_main", F.col("root") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    placed = rows.withColumn("own", own)
    to_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda k: F.struct(
        F.when(F.col("is_main"), F.lit(0)).otherwise(1).alias("kind"), F.when(F.col("is_main"), F.col("own")).otherwise(F.least("own", k)).alias("p"),
        F.when(F.col("is_main"), k).otherwise(F.greatest("own", k)).alias("q"), (~F.col("is_main") & (F.col("own") > k)).alias("second")))
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("p"), F.col("own").alias("q"), F.lit(True).alias("second")))
    places = F.when(F.col("is_main"), to_others).otherwise(F.concat(to_others, to_main))
    dealt = placed.select("bucket", "node", "root", F.explode(places).alias("at")).select("bucket", "at.*", "node", "root").join(sets.hint("merge"), "node")

    def run(tables):
        import pyarrow as pa

        store.kept("near")
        def links(held: list):
            """Of one meeting of two blocks (or of a block with itself), as batches: the links between different roots."""
            own = pa.Table.from_batches(held)
            node, root = (own.column(k).to_numpy() for k in ("node", "root"))
            late = own.column("second").to_numpy().astype(bool)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in own.column("shingles")]
            size = np.array([len(s) for s in sets])
            first = np.flatnonzero(~late)
            second = np.flatnonzero(late) if late.any() else first
            if not len(first) or len(sets) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
            common = _common_counts([sets[i] for i in first], [sets[j] for j in second])
            linked = den * common >= num * (size[first][:, None] + size[second][None, :] - common)
            i, j = np.nonzero(linked & (root[first][:, None] != root[second][None, :]))
            return pa.RecordBatch.from_arrays([pa.array(node[first[i]]), pa.array(node[second[j]])], names=["a", "b"])

        before, held = None, []
        for table in tables:
            if not table.num_rows:
                continue
            keys = np.stack([table.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("bucket", "kind", "p", "q")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = tuple(keys[:, a].tolist())
                if held and at != before:
                    yield links(held)
                    held = []
                before = at
                held.append(table.slice(a, b - a))
        if held:
            yield links(held)

    where = ["bucket", "kind", "p", "q"]
    dealt = dealt.repartition(store.partitions(open_.sparkSession), *where).sortWithinPartitions(*where)
    return dealt.select(*where, "node", "root", "second", "shingles").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, num: int = 80, den: int = 100, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `df` (doc_id, text, any others, which are ignored).

    Documents are linked if den * |A and B| >= num * |A or B| for their sets of `width`-word shingles; component_id is
    the smallest doc_id that links reach. Null or wordless text has an empty set and is linked with nothing. Rows that
    share a doc_id are one document for the components. A row without doc_id is linked with nothing, has no component
    and is kept. An empty table gives no rows.
    """
    share = num / den
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketched = store.save(_sketch_rows(docs, width, bands, rows_for(share)), "near-sketches")
    has_set = F.expr("n > 0 AND doc_id IS NOT NULL")
    classes = store.save(
        sketched.filter(has_set).groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("x"))
        .select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", F.col("x.doc_id").alias("rep"), F.col("x.bands").alias("bands"), F.col("x.sketch").alias("sketch")),
        "near-classes",
    )
    key = ["n", "h1", "h2"]
    named = classes.select("node", *key, "rep")
    # One doc_id with several texts ties their classes together.
    twice = sketched.filter(has_set).groupBy("doc_id").agg(F.count_distinct(*key).alias("k")).filter("k > 1").select("doc_id")
    node_of = sketched.filter(has_set).join(twice, "doc_id").join(named.select("node", *key), key).select("doc_id", "node").distinct()
    links = node_of.join(node_of.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")

    exploded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = store.save(exploded.join(shared, "bucket"), "near-members")
    need = store.save(members.select("node").distinct().join(classes.drop("bands"), "node"), "near-need")
    sets = store.save(_class_sets(docs, need, width), "near-sets")
    nodes = need.count()
    marks = need.select("node", "n", "sketch")

    def side(rows: DataFrame, node: str, as_: str) -> DataFrame:
        return rows.join(marks.select(F.col("node").alias(node), F.col("n").alias(f"n{as_}"), F.col("sketch").alias(f"m{as_}")), node)

    pairs = _alike(side(side(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct(), "a", "a"), "b", "b"), share)
    tested: DataFrame | None = None
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            found = store.save(_links(pairs, sets, num, den), "near-links")
            tested = found
            new = found.filter("linked").select("a", "b")
        else:
            new = store.save(_block_links(open_, sets, num, den), "near-links")
        roots = store.save(components.components(links.unionByName(new)), "near-roots", nodes)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        if step == ROUNDS:
            break
        labelled = members.select("bucket", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = labelled.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "root")).alias("next")).filter("r1 <> r2")
        # Small buckets are compared whole once; large ones with one member a round, then block by block.
        now = F.col("size") > SMALL_BUCKET if step else F.lit(True)
        open_ = store.save(labelled.join(several.select("bucket", "next"), "bucket").filter(now), "near-open")
        if open_.isEmpty():
            break
        if step < ROUNDS - 1:
            few = open_.filter(F.col("size") <= SMALL_BUCKET)
            a, b = (few.select("bucket", F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
            crossed = a.join(b, "bucket").filter("a < b AND ra <> rb").select("a", "b")
            star = open_.filter((F.col("size") > SMALL_BUCKET) & (F.col("root") != F.col("next.root"))).select(F.col("next.node").alias("a"), F.col("node").alias("b"))
            pairs = _alike(side(side(crossed.unionByName(star).distinct(), "a", "a"), "b", "b"), share)
    node_root = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = node_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = node_root.join(least, "root").select(*key, "component_id")
    out = sketched.select("doc_id", *key).join(by_class, key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _class_sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """node, shingles: the full sets of the classes need(node, n, h1, h2, rep), from the text of their representative."""
    texts = docs.join(store.small(need.select(F.col("rep").alias("doc_id")), need.count(), 16), "doc_id", "left_semi")
    wanted = need.select("node", F.col("rep").alias("doc_id"), "n", "h1", "h2")
    return _set_rows(texts, width).join(wanted, ["doc_id", "n", "h1", "h2"]).groupBy("node").agg(F.min("shingles").alias("shingles"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(near_duplicates(store.documents(spark, sf_dir), num=85))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least, w.doc_id) AS component_id, coalesce(least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""
