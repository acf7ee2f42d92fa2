"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes the last token of its BPE encoding is unique, and a token is that last one exactly
if it is valid beside the last token of the prefix before it (a pair is valid if encoding its bytes gives the pair
back). Storing each prefix's last token makes an encoding exact to extend by further bytes and lets an edit re-encode
only from the edited byte until the stored tokens agree again. Text is split into pieces by the vocabulary's pattern
first; merges never cross pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store

#: Pieces and token pairs remembered by a worker. Of pieces, those not met again while half as many new ones came are forgotten.
MEMORY = 200_000
PAIRS = 1_000_000


class Vocabulary:
    """Tokens of a rank file: a line for each, base64 of its bytes, space, rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.find_iter = regex.compile(pattern).finditer
        #: For each token the tokens (-1: none) whose bytes before it encode to the two.
        self.lefts: dict[int, dict[int, bool]] = {rank: {} for rank in self.ranks.values()}
        self.known = 0
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token), self.lefts[rank]))
        self.ends.make_automaton()
        size = max(self.tokens) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for rank, token in self.tokens.items():
            lengths[rank] = len(token)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), dtype=np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """Encoding by merging the lowest-ranked neighbours; used on the few bytes of a pair of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, token: int) -> bool:
        """Whether the bytes of `left` (-1: nothing) and of the token encode to just these."""
        lefts = self.lefts[token]
        found = lefts.get(left)
        if found is None:
            if self.known >= PAIRS:
                for each in self.lefts.values():
                    each.clear()
                self.known = 0
            own = [token] if left < 0 else [left, token]
            found = lefts[left] = self.merged(b"".join(self.tokens[t] for t in own)) == own
            self.known += 1
        return found

    def prefixes(self, data: bytes) -> list[int]:
        """The last token of each prefix of `data`; -1 for the empty one."""
        last, settled, beside = [-1], 0, self.beside
        for end, (token, length, lefts) in self.ends.iter(data.decode("latin-1")):
            if end < settled:
                continue
            left = last[end + 1 - length]
            ok = lefts.get(left)
            if ok is None:
                ok = beside(left, token)
            if ok:
                last.append(token)
                settled = end + 1
                if len(last) != settled + 1:
                    break
        if len(last) != len(data) + 1:
            raise ValueError(f"no token of the vocabulary ends at byte {len(last)}")
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        """The tokens of a piece, read back from its prefixes' last tokens."""
        whole = self.ranks.get(data)
        if whole is not None and self.beside(-1, whole):
            return [whole]
        last, tokens, at, out = self.prefixes(data), self.tokens, len(data), []
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]


class PrefixEncoding:
    """The encoding of one piece, open to appends and edits. last[i] is the last token of the prefix of i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, vocabulary.prefixes(data)

    def append(self, more: bytes) -> None:
        self.edit(len(self.data), len(self.data), more)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start..end by `new`; returns how many prefixes were computed again."""
        v, old, shift = self.vocabulary, self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = last = old[: start + 1]
        back = max(0, start - v.longest)
        agree = 0
        candidates: list = []
        at = start + 1
        for end_at, (token, length, _) in v.ends.iter(self.data[back:].decode("latin-1")):
            end_at += back + 1
            if end_at < at:
                continue
            while end_at > at:  # the candidates of the prefix before are complete
                agree = self._settle(candidates, at, old, shift, start + len(new), agree)
                if agree > v.longest:
                    self.last = last + old[at + 1 - shift :]
                    return at - start
                candidates, at = [], at + 1
            candidates.append((token, length))
        if at <= len(self.data):
            self._settle(candidates, at, old, shift, start + len(new), agree)
        return len(self.data) - start

    def _settle(self, candidates: list, at: int, old: list[int], shift: int, changed_to: int, agree: int) -> int:
        v, last = self.vocabulary, self.last
        for token, length in candidates:
            if v.beside(last[at - length], token):
                last.append(token)
                break
        else:
            raise ValueError(f"no token of the vocabulary ends at byte {at}")
        same = at > changed_to and last[at] == old[at - shift]
        return agree + 1 if same else 0

    def tokens(self) -> list[int]:
        out, at, last, tokens = [], len(self.data), self.last, self.vocabulary.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]


class DocumentEncoding:
    """A text's pieces and their encodings, open to appends."""

    #: Pieces at the end that more text can change: a contraction spans three characters at most.
    OPEN = 3

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.starts, self.ids = vocabulary, "", [], []
        self.append(text)

    def append(self, more: str) -> None:
        keep = max(0, len(self.starts) - self.OPEN)
        from_ = self.starts[keep] if keep < len(self.starts) else 0
        self.text += more
        del self.starts[keep:], self.ids[keep:]
        for match in self.vocabulary.find_iter(self.text[from_:]):
            self.starts.append(from_ + match.start())
            self.ids.append(PrefixEncoding(self.vocabulary, match.group().encode("utf-8", "surrogatepass")).tokens())

    def tokens(self) -> list[int]:
        return [t for piece in self.ids for t in piece]


class Encoder(dict):
    """Piece -> its tokens as packed 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("i", self.vocabulary.encode_piece(piece.encode("utf-8"))).tobytes()
            if len(piece) >= 64:
                return packed
        if len(self) >= MEMORY // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.vocabulary.split(text)))


#: Vocabularies whose tables a worker keeps.
LOADED = 4


class _Held:
    """Broadcast rank file and pattern; a worker builds their tables once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            data = f.read()
        self.key = hashlib.sha256(data + pattern.encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast((data, pattern))

    @property
    def value(self):
        return self.shared.value

    def encoder(self) -> Encoder:
        loaded = store.kept("bpe")
        if self.key not in loaded:
            while len(loaded) >= LOADED:
                del loaded[next(iter(loaded))]
            loaded[self.key] = Encoder(Vocabulary(*self.value))
        return loaded[self.key]


def _parts(batches, rows: int = 256):
    """Batches of few rows, so that what a worker holds beside its input stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _encoded(encoder: Encoder, texts: list):
    """Token ids of texts as an Arrow list array; null text is empty."""
    import pyarrow as pa

    packed = [encoder.encode(t) if t else b"" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))


def _decoded(v: Vocabulary, lists):
    """Bytes of an Arrow list array of ids, a document at a time, so that memory follows the longest one; null is empty."""
    import pyarrow as pa

    lists = lists.fill_null([]) if lists.null_count else lists
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    parts = []
    for a, b in zip(ends[:-1], ends[1:]):
        own = ids[a:b]
        lengths = v.offsets[own + 1] - v.offsets[own]
        place = np.cumsum(lengths) - lengths
        parts.append(v.bytes[np.repeat(v.offsets[own] - place, lengths) + np.arange(lengths.sum())].tobytes())
    return pa.array(parts, pa.binary())


def _with(df: DataFrame, held: _Held, new: dict[str, str], columns) -> DataFrame:
    """df with columns(encoder, batch, names) appended, by batch; columns of the new names are replaced."""
    df = df.drop(*new)
    names = df.columns

    def run(batches):
        import pyarrow as pa

        encoder = held.encoder()
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns(encoder, batch, names)], names=[*names, *new])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *new.items()]))


def encode(df: DataFrame, vocabulary: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of `column` as array column `out` (a column of that name is replaced).

    Null text counts as empty and gives an empty array; an empty table gives no rows; every other column passes
    through. Special tokens' strings are ordinary text. `vocabulary` is a rank file read once, on the driver.
    """
    return _with(df, _Held(df.sparkSession, vocabulary, pattern), {out: "array<int>"}, lambda e, batch, names: [_encoded(e, batch.column(names.index(column)).to_pylist())])


def decode(df: DataFrame, vocabulary: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of the ids in `column` as binary column `out` (a column of that name is replaced). Null ids count as none."""
    return _with(df, _Held(df.sparkSession, vocabulary, pattern), {out: "binary"}, lambda e, batch, names: [_decoded(e.vocabulary, batch.column(names.index(column)))])


def recode(df: DataFrame, vocabulary: str, pattern: str, column: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """encode() and, from its ids, decode() in one pass of a worker over the rows."""

    def both(e: Encoder, batch, names):
        ids = _encoded(e, batch.column(names.index(column)).to_pylist())
        return [ids, _decoded(e.vocabulary, ids)]

    return _with(df, _Held(df.sparkSession, vocabulary, pattern), {out: "array<int>", back: "binary"}, both)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = recode(store.documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
