"""Language identification by cross-parsing against suffix automata.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed greedily against each:
every phrase is the longest match that starts where the one before ended. The language needing the fewest phrases,
each normalised by the bits that name a place in its sample, wins.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import store

#: Bounds of the sample: characters a language, documents a language, so characters a document.
SAMPLE_CHARS = 32_768
SAMPLE_DOCS = 64
#: Characters of the samples of all languages together: with more languages than fit, each has a smaller sample. This
#: bounds the model, which is broadcast: two states and three transitions a character, of 48 bytes each at most.
ALL_CHARS = 1 << 20
#: Characters a language must have at least; a `lang` column of more values is no language column.
LEAST_CHARS = 512
#: Texts are cut into segments of so many symbols that are parsed in step; parses are then carried across the cuts.
SEGMENT = 256
#: Rounds in which parses of neighbouring segments are joined side by side.
ROUNDS = 2
#: Characters times languages that are parsed together; a longer text is parsed alone.
BATCH = 2_000_000
NEW_PHRASE = 1 << 30
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `symbols`; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(edges) - 1, last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                twin = len(edges) - 1
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


class Edges:
    """Transitions (state, symbol) -> state of any alphabet in one open-addressing hash table, looked up in arrays."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        self.shift = 64 - max(2, int(np.ceil(np.log2(2 * len(keys) + 4))))
        self.mask = (1 << (64 - self.shift)) - 1
        self.keys, self.targets = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        self.probes, left, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several, one stays
            placed = self.keys[at] == keys[left]
            self.targets[at[placed]] = targets[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Target of each key, -1 where there is none."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.targets[at], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            step = at[open_] = (at[open_] + 1) & self.mask
            there, want = self.keys[step], keys[open_]
            hit = there == want
            out[open_[hit]] = self.targets[step[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out


class CrossParser:
    """The automata of all languages over one alphabet of every sampled letter; symbol 0 stands for every run of non-letters."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.unknown = len(letters) + 1
        self.width = len(letters) + 2
        of = {c: i + 1 for i, c in enumerate(letters)}
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        for code in range(len(self.symbol)):
            c = chr(code)
            if c.isalpha():
                self.symbol[code] = of.get(c.lower()[:1], self.unknown)
        keys, targets, self.roots, self.outside, self.bits, base = [], [], [], [], [], 0
        self.first = np.zeros((len(samples), self.width), dtype=np.int32)  # where a phrase that begins with a symbol goes
        for k, name in enumerate(self.languages):
            joined = self.symbols("\n".join(samples[name]))
            edges = automaton(joined.tolist())
            outside = len(edges)  # before any phrase, and after a symbol that the sample lacks
            if base + outside >= NEW_PHRASE:
                raise ValueError("the samples are too large for 30-bit states")
            sizes = np.array([len(out) for out in edges])
            symbols = np.fromiter((c for out in edges for c in out), np.int64, sizes.sum())
            keys.append((np.repeat(np.arange(len(edges)), sizes) + base) * self.width + symbols)
            targets.append(np.fromiter((t for out in edges for t in out.values()), np.int64, sizes.sum()) + base)
            self.first[k] = outside + base
            for c, target in edges[0].items():
                self.first[k, c] = target + base
            self.roots.append(base)
            self.outside.append(outside + base)
            self.bits.append(np.log2(max(len(joined), 2)))
            base += outside + 1
        self.edges = Edges(np.concatenate(keys), np.concatenate(targets)) if keys else Edges(np.zeros(0, np.int64), np.zeros(0, np.int64))

    @property
    def chance(self) -> float:
        """Mean match that text of unrelated symbols would have: the logarithm of the smallest sample to the base of the alphabet."""
        return min(self.bits, default=0.0) / float(np.log2(self.width))

    def symbols(self, text: str) -> np.ndarray:
        raw = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = raw != 0
        keep[1:] |= raw[:-1] != 0
        return raw[keep]

    def _run(self, flat: np.ndarray, at: np.ndarray, end: np.ndarray, lang: np.ndarray, segment: np.ndarray, state: np.ndarray, starts: np.ndarray, join: bool) -> np.ndarray:
        """Parse lanes, each a language and a segment at..end of `flat` entered in `state`, and mark in `starts` where phrases begin.

        With `join` a lane stops at a place where the parse marked before begins a phrase too: from there both agree.
        Returns each lane's state at its segment's end, -1 where it stopped before.
        """
        out = np.full(len(lang), -1, dtype=np.int64)
        lanes, place = np.arange(len(lang)), at[segment]
        state = state.copy()
        while True:
            on = place < end[segment[lanes]]
            out[lanes[~on]] = state[~on]
            lanes, place, state = lanes[on], place[on], state[on]
            if not len(lanes):
                return out
            symbol, own = flat[place], lang[lanes]
            step = self.edges.find(state * self.width + symbol)
            new = step < 0
            if join:
                apart = ~(new & starts[own, place])
                lanes, place, symbol, own, step, new = (x[apart] for x in (lanes, place, symbol, own, step, new))
            starts[own, place] = new
            state = np.where(new, self.first[own, symbol], step).astype(np.int64)
            place = place + 1

    def _phrase_starts(self, flat: np.ndarray, at: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where phrases begin in the whole texts of `flat`, for each language; their segments are at..end, in order, of text `owner`.

        All segments are parsed as if each began a text. Then each is entered in the state in which the one before it
        ended, until its parse meets the one it has. Where parses do not meet, as in periodic text, what they end in
        changes; after ROUNDS such rounds the rest of those texts is parsed symbol by symbol, from the first segment that was entered in another state.
        """
        many, n = len(self.languages), len(at)
        starts = np.zeros((many, len(flat)), dtype=bool)
        lang, segment = np.repeat(np.arange(many), n), np.tile(np.arange(n), many)
        entered = np.repeat(np.array(self.outside, dtype=np.int64)[:, None], n, axis=1)
        ends = self._run(flat, at, end, lang, segment, entered.ravel(), starts, False).reshape(many, n)
        inner = np.append(False, owner[1:] == owner[:-1])  # another segment of the text is before it
        before = np.empty_like(ends)
        for _ in range(ROUNDS):
            before[:, 1:] = ends[:, :-1]
            lang, segment = np.nonzero(inner & (entered != before))
            if not len(lang):
                return starts
            entered[lang, segment] = before[lang, segment]
            reached = self._run(flat, at, end, lang, segment, before[lang, segment], starts, True)
            unmet = reached >= 0
            ends[lang[unmet], segment[unmet]] = reached[unmet]
        before[:, 1:] = ends[:, :-1]
        lang, segment = np.nonzero(inner & (entered != before))
        if len(lang):
            there = self.edges.keys >= 0  # as a dictionary only here: it is larger than the arrays, and few texts need it
            steps = dict(zip(self.edges.keys[there].tolist(), self.edges.targets[there].tolist()))
            one = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (owner[segment[1:]] != owner[segment[:-1]])))
            for l, k in zip(lang[one].tolist(), segment[one].tolist()):
                self._walk(steps, flat, at, end, l, k, int(np.searchsorted(owner, owner[k], side="right")), starts[l], entered[l], ends[l])
        return starts

    def _walk(self, steps: dict[int, int], flat: np.ndarray, at: np.ndarray, end: np.ndarray, lang: int, segment: int, last: int, starts: np.ndarray, entered: np.ndarray, ends: np.ndarray) -> None:
        """Parse segments segment..last of a text one after another, skipping those that were entered in the state that is reached."""
        first, width = self.first[lang].tolist(), self.width
        state = int(ends[segment - 1])
        for k in range(segment, last):
            if entered[k] == state:
                state = int(ends[k])
                continue
            entered[k] = state
            a, b = int(at[k]), int(end[k])
            marks = starts[a:b].tolist()
            for i, symbol in enumerate(flat[a:b].tolist()):
                target = steps.get(state * width + symbol, -1)
                if target < 0:
                    if marks[i]:
                        state = int(ends[k])  # as parsed before from here on
                        break
                    marks[i], state = True, first[symbol]
                else:
                    marks[i], state = False, target
            ends[k] = state
            starts[a:b] = marks

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(languages x texts) phrases of the whole texts and the number of symbols of each text."""
        found = [self.symbols(t) for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        starts, pieces = np.cumsum(lengths) - lengths, (lengths + SEGMENT - 1) // SEGMENT
        owner = np.repeat(np.arange(len(texts)), pieces)
        at = starts[owner] + (np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]) * SEGMENT
        begun = self._phrase_starts(flat, at, np.minimum(at + SEGMENT, (starts + lengths)[owner]), owner)
        total = np.zeros((len(self.languages), len(texts)), dtype=np.int64)
        for k, own in enumerate(begun):
            sums = np.concatenate(([0], np.cumsum(own)))
            total[k] = sums[starts + lengths] - sums[starts]
        return total, lengths

    def match_lengths(self, text: str) -> np.ndarray:
        """Sum of longest-match lengths over all places of a text, for each language; settles ties."""
        symbols = self.symbols(text).astype(np.int64)
        sums = np.zeros(len(self.languages))
        for k, root in enumerate(self.roots):
            at, state = np.arange(len(symbols)), np.full(len(symbols), root, dtype=np.int64)
            while len(at):
                state = self.edges.find(state * self.width + symbols[at])
                sums[k] += (state >= 0).sum()
                on = (state >= 0) & (at + 1 < len(symbols))
                at, state = at[on] + 1, state[on]
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and symbols a phrase of each text. The score is 1 - winner's share of the best two's bits, doubled."""
        known = [t if t and LETTER.search(t) else "" for t in texts]
        total, lengths = self.phrases(known)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = total * np.array(self.bits)[:, None]
        order = np.argsort(bits, axis=0, kind="stable")
        best = bits[order[0], np.arange(len(texts))]
        second = bits[order[1], np.arange(len(texts))] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        winner = order[0].copy()
        for i in np.flatnonzero((best == second) & (best > 0)):
            tied = np.flatnonzero(bits[:, i] == best[i])
            sums = self.match_lengths(known[i])
            winner[i] = tied[np.argmax(sums[tied])]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, np.where(second > 0, 1.0 - best / second, 0.0))
            mean = np.where(total[winner, np.arange(len(texts))] > 0, lengths / np.maximum(total[winner, np.arange(len(texts))], 1), 0.0)
        names = [self.languages[w] if k else UNDETERMINED for w, k in zip(winner, known)]
        return names, np.where([bool(k) for k in known], score, 0.0), mean


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> CrossParser:
    """Learn from rows with text, lang and doc_id whose crc32(doc_id) mod 5 is not 0.

    The documents with the least hash of doc_id are the sample: at most `sample_docs` a language, of each at most
    sample_chars * 4 / sample_docs leading characters, `sample_chars` in all. Where the languages are so many that their
    samples would exceed ALL_CHARS, sample_chars is ALL_CHARS over their number, for all of them; under LEAST_CHARS
    that is an error. Only the sample reaches the driver.
    """
    languages = df.filter("lang IS NOT NULL").select("lang").distinct().count()
    sample_chars = min(sample_chars, ALL_CHARS // max(languages, 1))
    if sample_chars < LEAST_CHARS and languages > 1:
        raise ValueError(f"{languages} different values of lang leave {sample_chars} characters for each")
    rows = df.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("text", F.substring("text", 1, sample_chars * 4 // sample_docs))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "text"))).filter(F.col("n") <= sample_docs)
    samples: dict[str, list[str]] = {}
    for row in first.orderBy("lang", "n").select("lang", "text").collect():
        own = samples.setdefault(row["lang"], [])
        own.append(row["text"][: max(0, sample_chars - sum(map(len, own)))])
    return CrossParser(samples)


def identify(df: DataFrame, model: CrossParser, column: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1: how far the second language's bits exceed the winner's) and phrase_chars (mean match).

    Null text and text without a letter are `und` with score 0; ties between languages go to the one with the longer
    matches over all places, then the first by name. Columns of these names in df are replaced.
    """
    df = df.drop("lang_pred", "score", "phrase_chars")
    names, shared = df.columns, df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        store.kept("language")
        parser = shared.value
        together = BATCH // max(len(parser.languages), 1)
        for batch in batches:
            texts = batch.column(names.index(column)).to_pylist()
            langs, scores, means, a = [], [], [], 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars < together):
                    chars += len(texts[b] or "")
                    b += 1
                found = parser.predict(texts[a:b])
                langs += found[0]
                scores.append(found[1])
                means.append(found[2])
                a = b
            joined = [np.concatenate(x) if x else np.zeros(0) for x in (scores, means)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), *map(pa.array, joined)], names=[*names, "lang_pred", "score", "phrase_chars"])

    return df.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + ["lang_pred string", "score double", "phrase_chars double"]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_chars")
