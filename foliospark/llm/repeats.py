"""What repeats across documents, found from window anchors: shared by the two substring deduplications.

A window is a run of `width` units (words or bytes). Its anchor is the place of the least hash among its grams, so equal
windows have equal anchors at equal distances. Documents are reduced to their anchors (a few per cent of their
places); anchors whose gram occurs once are done with. The text around the others, all windows that belong to the
anchor, is a slice. Equal slices are counted by aggregation, and one of them is dealt out by gram: the different slices of a
gram are a group of suffixes with that prefix, compared exactly by the operator's own structure. What comes back is
a covered range per different slice, which every place of it is joined with.

Prefixes have variable lengths. The bytes of a group are counted before its text is moved; a group beyond GROUP_BYTES
is split by longer prefixes: its different slices are the documents of the same search with longer grams, until every
group fits or the prefix is as long as the window. Such a prefix is the node itself, and its members are counted by
aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import store, vectors

#: An anchor's place, distance back to its first window's start and number of windows, packed in one number.
STEP = 1 << 10
#: Bytes of different slices beyond which a group gets longer prefixes.
GROUP_BYTES = 1 << 19
#: Rows (two a slice) and bytes of text of the groups that a task compares together; no group is cut.
TOGETHER = 12_000
TOGETHER_BYTES = 4 << 20


def packed_anchors(values: np.ndarray, owner_start: np.ndarray, owner: np.ndarray, width: int, gram: int):
    """Of unit hashes and each unit's document: (gram hash, document row, packed place) of every anchor.

    `owner_start` is each document's first unit, `owner` the document of each unit.
    """
    n = len(values)
    empty = np.zeros(0, dtype=np.int64)
    if n < width:
        return empty, empty, empty
    grams = vectors.window_hashes(values, gram, vectors.ITEM_BASE)
    at = vectors.anchors(grams, width - gram + 1)  # a window that crosses documents is dropped next
    starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    at = at[starts]
    if not len(at):
        return empty, empty, empty
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    place, begin = at[first], starts[first]
    doc = owner[place]
    local = place - owner_start[doc]
    return grams[place].view(np.int64), doc, local * STEP * STEP + (place - begin) * STEP + many


def units_of_words(data, starts, ends):
    """Unit hashes, document of each, document ranges in units, and byte ranges of the units."""
    at, to, doc = vectors.words(data, starts, ends)
    count = np.bincount(doc, minlength=len(starts)) if len(doc) else np.zeros(len(starts), dtype=np.int64)
    last = np.cumsum(count)
    return vectors.word_hashes(data, at, to), doc, last - count, last, at, to


def units_of_bytes(data, starts, ends):
    at = np.arange(len(data), dtype=np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    return vectors.mix64(data.astype(np.uint64) + np.uint64(1)), doc, starts, ends, at, at + 1


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as id, text and the text's key: kb and kc, two 64-bit hashes of it. Null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("kb"), F.xxhash64(F.lit(1), text).alias("kc"))


def _longs(table, *names) -> list[np.ndarray]:
    return [table.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and values of an Arrow list column of longs without nulls."""
    upto = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    return upto, column.flatten()


def _starts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window start, and number of windows, of packed places."""
    return place // (STEP * STEP) - place // STEP % STEP, place % STEP


def _each(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all of first, first + 1, ... (`many` of them) of each range."""
    owner = np.repeat(np.arange(len(many)), many)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)


def anchor_rows(docs: DataFrame, units: Callable, width: int, gram: int) -> DataFrame:
    """gram, ka, kb, kc and place of every anchor of docs(ka, kb, kc, text)."""

    def run(tables):
        import pyarrow as pa

        for table in tables:
            keys = _longs(table, "ka", "kb", "kc")
            for row, data, starts, ends in vectors.batches(table.column("text")):
                values, doc, first, _, _, _ = units(data, starts, ends)
                hashes, own, place = packed_anchors(values, first, doc, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, *(k[row + own] for k in keys), place)], names=["gram", "ka", "kb", "kc", "place"])

    return docs.select("ka", "kb", "kc", "text").mapInArrow(run, "gram long, ka long, kb long, kc long, place long")


SLICE = "gram long, d1 long, d2 long, ka long, kb long, kc long, first long, ahead long, many long, size long, data binary"
#: Slices a task remembers; of those with equal text it sends the text once.
REMEMBERED = 200_000


def slices(docs: DataFrame, units: Callable, width: int) -> DataFrame:
    """For docs(ka, kb, kc, text, wanted array<struct<gram, place>>) a row for each wanted anchor, with the text of its windows.

    `first` is the unit at which the slice begins, `ahead` the anchor's distance from it, `many` its windows, `size` its
    bytes; d1 and d2 are the digest of text and anchor. A slice that the task has sent before goes without its text.
    """
    names = ["gram", "d1", "d2", "ka", "kb", "kc", "first", "ahead", "many", "size", "data"]

    def run(tables):
        import pyarrow as pa

        seen: set = set()
        for table in tables:
            keys = _longs(table, "ka", "kb", "kc")
            upto, inner = _lists(table.column("wanted"))
            grams, places = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for row, data, starts, ends in vectors.batches(table.column("text")):
                _, _, first, _, at, to = units(data, starts, ends)
                lo, hi = upto[row], upto[row + len(starts)]
                doc = np.repeat(np.arange(len(starts)), np.diff(upto[row : row + len(starts) + 1]))
                gram, place = grams[lo:hi], places[lo:hi]
                if not len(doc):
                    continue
                ahead = place // STEP % STEP
                begin, many = _starts(place)
                a, b = at[first[doc] + begin], to[first[doc] + begin + many + width - 2]
                values = vectors.mix64(data.astype(np.uint64) + np.uint64(1))
                d1, d2 = (vectors.range_hashes(values, a, b, base).view(np.int64) + ahead * STEP + many for base in (vectors.BYTE_BASE, vectors.ITEM_BASE))
                whole = data.tobytes()
                for x in range(0, len(doc), 2048):  # slices overlap, so a batch of them is kept small
                    own = slice(x, x + 2048)
                    parts = []
                    for i, j, h in zip(a[own].tolist(), b[own].tolist(), zip(d1[own].tolist(), d2[own].tolist())):
                        if h in seen:
                            parts.append(None)
                        else:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen.add(h)
                            parts.append(whole[i:j])
                    columns = [gram[own], d1[own], d2[own], *(k[row + doc[own]] for k in keys), begin[own], ahead[own], many[own], (b - a)[own]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], names=names)

    return docs.select("ka", "kb", "kc", "text", "wanted").mapInArrow(run, SLICE)


def window_rows(docs: DataFrame, units: Callable, width: int) -> DataFrame:
    """d1, d2, ka, kb, kc, many, runs: a row for each different window of docs(ka, kb, kc, text).

    d1 and d2 are the window's digest, `many` its places in the text, `runs` these as ranges of window starts.
    """
    names = ["d1", "d2", "ka", "kb", "kc", "many", "runs"]

    def run(tables):
        import pyarrow as pa

        for table in tables:
            keys = _longs(table, "ka", "kb", "kc")
            for row, data, starts, ends in vectors.batches(table.column("text")):
                values, _, first, last, _, _ = units(data, starts, ends)
                doc, at = _each(first, np.maximum(last - first - width + 1, 0))
                if not len(doc):
                    continue
                start = at - first[doc]
                d1, d2 = (vectors.range_hashes(values, at, at + width, base).view(np.int64) for base in (vectors.BYTE_BASE, vectors.ITEM_BASE))
                order = np.lexsort((start, d2, d1, doc))
                doc, start, d1, d2 = doc[order], start[order], d1[order], d2[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
                apart = new.copy()
                apart[1:] |= start[1:] - start[:-1] > width  # closer starts cover everything between them
                lead, first_of = np.flatnonzero(new), np.flatnonzero(apart)
                last_of = np.append(first_of[1:], len(order)) - 1
                spans = pa.StructArray.from_arrays([pa.array(start[first_of]), pa.array(start[last_of])], names=["lo", "hi"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first_of, lead), len(first_of)).astype(np.int32)), spans)
                times = np.diff(np.append(lead, len(order)))
                columns = [d1[lead], d2[lead], *(k[row + doc[lead]] for k in keys), times]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=names)

    return docs.select("ka", "kb", "kc", "text").mapInArrow(run, "d1 long, d2 long, ka long, kb long, kc long, many long, runs array<struct<lo: bigint, hi: bigint>>")


def compare(heads: DataFrame, counted: DataFrame, covered: Callable) -> DataFrame:
    """d1, d2, least, n, lo, hi for the slices counted(gram, d1, d2, least, n, ahead, many) at several places or with repeated windows.

    lo and hi are the first and last repeated window (-1: none) by covered(ahead, many, data, least), which gets the
    different slices of whole groups and gives their numbers, lo and hi. heads(gram, d1, d2, data) has the text of each slice, once or more.
    Rows are dealt by gram and sorted (on disk if need be); of equal slices a task holds one.
    """
    n = store.partitions(heads.sparkSession)
    none = {k: F.lit(None).cast(t) for k, t in (("least", "long"), ("n", "long"), ("ahead", "long"), ("many", "long"), ("data", "binary"))}
    key = ["gram", "d1", "d2"]
    rows = heads.select(*key, *[none[k].alias(k) for k in ("least", "n", "ahead", "many")], "data").unionByName(counted.select(*key, "least", "n", "ahead", "many", none["data"].alias("data")))

    def run(tables):
        import pyarrow as pa

        held: list = []
        many_rows = size = 0
        before = None

        def flush(final: bool):
            nonlocal held, many_rows, size
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = len(gram) if final else int(np.searchsorted(gram, gram[-1], side="left"))
            held, many_rows, size = ([] if final else table.slice(cut).to_batches()), len(gram) - cut, 0
            text, own = (table.slice(0, cut).take(pa.array(np.arange(k, cut, 2))) for k in (0, 1))  # a slice's text, then its counts
            d1, d2, least, times, ahead, many = _longs(own, "d1", "d2", "least", "n", "ahead", "many")
            low, high = np.full(len(d1), -1), np.full(len(d1), -1)
            index, a, b = covered(ahead, many, text.column("data").combine_chunks(), least)
            low[index], high[index] = a, b
            keep = (times > 1) | (low >= 0)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (d1, d2, least, times, low, high)], names=["d1", "d2", "least", "n", "lo", "hi"])

        for table in tables:
            if not table.num_rows:
                continue
            gram, d1, d2 = _longs(table, *key)
            fresh = np.ones(len(gram), dtype=bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            fresh[0] = before != (gram[0], d1[0], d2[0])
            before = gram[-1], d1[-1], d2[-1]
            counts = table.column("data").is_null().to_numpy(zero_copy_only=False)
            table = table.take(pa.array(np.flatnonzero(fresh | counts)))
            if not table.num_rows:
                continue
            held.append(table)
            many_rows += table.num_rows
            size += table.column("data").nbytes
            if (many_rows >= TOGETHER or size >= TOGETHER_BYTES) and table.column("gram")[table.num_rows - 1] != held[0].column("gram")[0]:
                yield flush(False)
        if held:
            yield flush(True)

    return rows.repartition(n, "gram").sortWithinPartitions(*key, F.col("data").isNull()).mapInArrow(run, "d1 long, d2 long, least long, n long, lo long, hi long")


def counted_ranges(rows: DataFrame, repeated: Column, label: str) -> DataFrame:
    """kb, kc, ranges of the repeated windows among window_rows, by `repeated` over n, least and ka."""
    count = rows.groupBy("d1", "d2").agg(F.sum("many").alias("n"), F.min("ka").alias("least"))
    known = store.save(count.filter("n > 1"), f"{label}-nodes")
    hit = rows.join(known.hint("merge"), ["d1", "d2"]).filter(repeated)
    return hit.select("kb", "kc", F.col("runs").alias("ranges"))


def covered_ranges(docs: DataFrame, units: Callable, width: int, prefixes: tuple[int, ...], covered: Callable, repeated: Column, label: str) -> DataFrame:
    """kb, kc, ranges array<struct<lo, hi>> of repeated windows' first and last starts, for docs(ka, kb, kc, text).

    `prefixes` are the lengths that a group's prefix can have, growing, before the window's own. Of rows with the same
    text the one with the least ka stands for all. An anchor is compared if its gram is at two places, in one text or
    several. `covered` compares a group's slices, `repeated` says the same of a single window.
    """
    if not 0 < prefixes[0] <= prefixes[-1] < width or width - prefixes[0] >= STEP - 1:
        raise ValueError(f"prefixes must be shorter than the window and the window at most {STEP - 2} longer than the first")
    ranges = _ranges(docs, units, width, prefixes, covered, repeated, label)
    return ranges.groupBy("kb", "kc").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _ranges(docs: DataFrame, units: Callable, width: int, prefixes: tuple[int, ...], covered: Callable, repeated: Column, label: str) -> DataFrame:
    """kb, kc, ranges of one prefix length and, for groups that are too large, of the longer ones; a text can have several rows."""
    if not prefixes:
        return counted_ranges(store.save(window_rows(docs, units, width), f"{label}-windows"), repeated, label)
    gram, longer = prefixes[0], prefixes[1:]
    anchors = store.save(anchor_rows(docs, units, width, gram), f"{label}-anchors-{gram}")
    at = F.struct("kb", "kc", "place")
    grouped = anchors.groupBy("gram").agg(F.min(at).alias("one"), F.max(at).alias("other"))
    # Written first: both sides of the next join are then shuffles, which Spark splits where a gram is skewed.
    often = store.save(grouped.filter("one <> other").select("gram"), f"{label}-often-{gram}")
    own = anchors.join(often.hint("merge"), "gram").groupBy("kb", "kc").agg(F.min("ka").alias("least_ka"), F.sort_array(F.collect_set(F.struct("gram", "place"))).alias("wanted"))
    wanted = store.save(own, f"{label}-wanted-{gram}")
    store.drop(anchors)
    sliced = store.save(slices(docs.join(wanted.hint("merge"), ["kb", "kc"]).filter("ka = least_ka"), units, width), f"{label}-slices-{gram}")
    store.drop(wanted)
    key = ["gram", "d1", "d2"]
    counted = store.save(sliced.groupBy(*key).agg(F.min("ka").alias("least"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("ahead", "many", "size")]), f"{label}-counted-{gram}")
    large = store.save(counted.groupBy("gram").agg(F.sum("size").alias("size")).filter(F.col("size") > GROUP_BYTES).select("gram"), f"{label}-large-{gram}")
    n_large = large.count()
    heads = sliced.filter("data IS NOT NULL").select(*key, "data")
    if not n_large:
        known = compare(heads, counted, covered)
    else:
        large = store.small(large, n_large, 32)
        known = compare(heads.join(large, "gram", "left_anti"), counted.join(large, "gram", "left_anti"), covered)
        split = counted.join(large, "gram", "left_semi").select("d1", "d2", "least", "n")
        texts = heads.join(large, "gram", "left_semi").dropDuplicates(["d1", "d2"]).join(split, ["d1", "d2"])
        texts = store.save(texts.select(F.col("least").alias("ka"), F.col("d1").alias("kb"), F.col("d2").alias("kc"), F.col("data").alias("text")), f"{label}-split-{gram}")
        deeper = _ranges(texts, units, width, longer, covered, repeated, f"{label}-{gram}")
        # Windows of a slice overlap, so the first and the last that are repeated cover all between them.
        spans = deeper.groupBy(F.col("kb").alias("d1"), F.col("kc").alias("d2")).agg(F.min(F.array_min(F.col("ranges.lo"))).alias("lo"), F.max(F.array_max(F.col("ranges.hi"))).alias("hi"))
        found = split.join(spans, ["d1", "d2"], "left").select("d1", "d2", "least", "n", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))
        known = known.unionByName(found.filter("n > 1 OR lo >= 0"))
    known = store.save(known, f"{label}-known-{gram}")
    hits = sliced.select("d1", "d2", "ka", "kb", "kc", "first", "many").join(known.hint("merge"), ["d1", "d2"])
    span = F.when(repeated, F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("many") - 1).alias("hi"))).when(
        (F.col("lo") >= 0) & (F.col("ka") == F.col("least")), F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    )
    return hits.select("kb", "kc", span.alias("span")).filter("span IS NOT NULL").select("kb", "kc", F.array("span").alias("ranges"))


def merged_cover(lo: np.ndarray, hi: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` units are in a window that starts in one of the ranges lo..hi."""
    mark = np.zeros(size + 1, dtype=np.int64)
    np.add.at(mark, lo, 1)
    np.add.at(mark, np.minimum(hi + width, size), -1)
    return np.cumsum(mark[:-1]) > 0


def copies(rows: DataFrame) -> DataFrame:
    """kb, kc, copied (true) and least, the smallest id, of the texts that several rows have."""
    return rows.groupBy("kb", "kc").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1").select("kb", "kc", "least", F.lit(True).alias("copied"))


def apply_cover(rows: DataFrame, ranges: DataFrame, all_gone: Column, units: Callable, width: int, joined_by: bytes | None, label: str, spared: Column | None = None) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept (binary) for rows(id, kb, kc, text) and their texts' ranges.

    `all_gone` says of a row, from id, `copied` and the `least` id of its copies (null without copies), whether all its windows are
    repeated. Rows that are `spared` lose nothing. Kept units are joined by `joined_by`; None concatenates their bytes.
    """
    found = store.save(ranges, f"{label}-ranges")
    joined = rows.join(found.hint("merge"), ["kb", "kc"], "left").join(copies(rows).hint("merge"), ["kb", "kc"], "left").withColumn("all_gone", F.coalesce(all_gone, F.lit(False)))
    if spared is not None:
        joined = joined.withColumn("ranges", F.when(~spared, F.col("ranges"))).withColumn("all_gone", F.col("all_gone") & ~spared)

    def run(tables):
        import pyarrow as pa

        for table in tables:
            gone = table.column("all_gone").to_numpy(zero_copy_only=False).astype(bool)
            ranges_of = table.column("ranges").fill_null([]) if table.column("ranges").null_count else table.column("ranges")
            upto = np.concatenate(([0], np.cumsum(ranges_of.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            inner = ranges_of.flatten()
            lows, highs = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for row, data, starts, ends in vectors.batches(table.column("text")):
                _, _, first, last, at, to = units(data, starts, ends)
                whole, out = data.tobytes(), ([], [], [], [])
                for i in range(len(starts)):
                    n = int(last[i] - first[i])
                    k = row + i
                    if gone[k] and n >= width:
                        cover = np.ones(n, dtype=bool)
                    elif upto[k] == upto[k + 1]:
                        cover = np.zeros(n, dtype=bool)
                    else:
                        cover = merged_cover(lows[upto[k] : upto[k + 1]], highs[upto[k] : upto[k + 1]], width, n)
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
                    stay = ~cover
                    if joined_by is None:
                        kept = data[starts[i] : ends[i]][stay].tobytes()
                    else:
                        own = slice(first[i], last[i])
                        kept = joined_by.join([whole[a:b] for a, b in zip(at[own][stay].tolist(), to[own][stay].tolist())])
                    for column, value in zip(out, (n, int(cover.sum()), len(edges) // 2, kept)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                ids = table.column("id").slice(row, len(starts))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out, kinds)], names=["doc_id", "n_units", "n_removed", "n_spans", "kept"])

    return joined.select("id", "text", "all_gone", "ranges").mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
