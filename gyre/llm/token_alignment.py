"""Alignment of two tokenizers over the same texts: shared cuts, the tokens between them, and how often tokens meet.

Each tokenizer marks the bytes of a text at which its tokens end, in a packed bitset. The AND of both bitsets holds the
shared cuts, which divide the text into groups; the OR holds the ends of all stretches that one token of each covers, and
so all links. Counting set bits before a place (rank), by popcounts of words and their running sums, gives the tokens that
a cut or a stretch belongs to; the places of set bits (select) give the cuts and stretches. Many texts stand in one bitset,
since the end of a text is a cut in both.

Links are kept as the distinct pairs of a text with their number, counted over the corpus by a plain aggregation, and
joined back: by broadcast where the counted pairs are few (``BROADCAST_PAIRS``), else by a shuffled join. There are no more
pairs than the product of both vocabularies.

Cases: a null or empty text has no tokens, and neither has one whose tokens of either kind do not give its bytes back (a
tokenizer may replace white space or signs): its numbers are 0, its groups ''. Strings of special tokens inside a text are
plain text. Rows that repeat an identifier are rows of their own, each counted as a document; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.packing import _byte_letters, coder
from gyre.llm.session import shipped, written
from gyre.llm.text import slices, text_buffers

#: Counted pairs that are broadcast: some 100 MB at most.
BROADCAST_PAIRS = 2_000_000
_WORD = 64


class Marks:
    """Marked places among ``n``, as a packed bitset."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Marks:
        flags = np.zeros(-(-n // _WORD) * _WORD, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"), n)

    def __and__(self, other: Marks) -> Marks:
        return Marks(self.words & other.words, self.n)

    def __or__(self, other: Marks) -> Marks:
        return Marks(self.words | other.words, self.n)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks stand before each place."""
        word, bit = places // _WORD, (places % _WORD).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """The marked places, rising."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Groups and links of texts on end, from both tokenizers' identifiers and the bytes of each token."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b = a, b
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        n = int(a_ends[-1]) if len(a_ends) else 0
        of_a, of_b = Marks.at(a_ends - 1, n), Marks.at(b_ends - 1, n)
        #: Last bytes of groups, and the tokens of either kind up to there.
        self.cuts = (of_a & of_b).select()
        self.a_upto, self.b_upto = of_a.rank(self.cuts + 1), of_b.rank(self.cuts + 1)
        #: Last bytes of linked stretches, and the identifiers that meet there.
        self.stretches = (of_a | of_b).select()
        self.link_a, self.link_b = a[of_a.rank(self.stretches)], b[of_b.rank(self.stretches)]

    def shown(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, ``a1,a2|b1;a3|b2``, as bytes, and where each group ends in it; ``last`` groups of texts have no mark behind."""
        of_a = np.repeat(np.arange(len(self.cuts)), np.diff(self.a_upto, prepend=0))
        of_b = np.repeat(np.arange(len(self.cuts)), np.diff(self.b_upto, prepend=0))
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        b_before = np.concatenate([[0], self.b_upto[:-1]])
        ids[np.arange(len(self.a)) + b_before[of_a]] = self.a
        ids[np.arange(len(self.b)) + self.a_upto[of_b]] = self.b
        mark[self.a_upto + b_before - 1] = ord("|")
        ends = self.a_upto + self.b_upto
        mark[ends - 1] = np.where(last, 0, ord(";"))
        digits, width = _decimals(int(ids.max(initial=0)) + 1)
        signs = np.empty((len(ids), digits.shape[1] + 1), np.uint8)
        signs[:, :-1] = digits[ids]
        signs[:, -1] = mark
        flat = signs.ravel()
        return flat[flat != 0], np.cumsum(width[ids] + (mark != 0))[ends - 1]


@functools.lru_cache(4)
def _decimals_of(upto: int) -> tuple[np.ndarray, np.ndarray]:
    texts = np.arange(upto).astype("S")
    return texts.view(np.uint8).reshape(upto, -1), np.char.str_len(texts)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of numbers below ``n`` at least, zero bytes behind, and how many they are."""
    return _decimals_of(1 << max(16, (n - 1).bit_length()))


class Tokenizers:
    """Both tokenizers: identifiers of texts, and the bytes of each identifier."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.coder = coder(byte_level, True)
        vocabulary = Tokenizer.from_file(byte_level).get_vocab()
        letters = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.other = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [self._piece(i) for i in range(self.other.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.other.id_to_piece(i)
        as_byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Identifiers of both kinds for each text, none where they do not give the bytes of the text back."""
        none = np.zeros(0, np.int64)
        out = []
        for text, a, b in zip(texts, self.coder.encode([f" {t}" for t in texts]), self.other.encode(texts, num_threads=1)):
            whole = f" {text}".encode()
            a = a.astype(np.int64)
            fits = text and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            out.append((a, np.array(b, np.int64)) if fits else (none, none))
        return out


@functools.cache
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def _sizes(byte_level: str, pieces: str) -> tuple[int, int]:
    both = tokenizers(byte_level, pieces)
    return len(both.a_bytes), len(both.b_bytes)


def aligned(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Both tokenizations of each text, aligned.

    Columns: id, _row (a number for each row, with gaps), n_a, n_b, n_groups, n_links,
    groups_sha256, pairs (its distinct linked pairs, each as the first identifier times the size of the second
    vocabulary plus the second) and times (how often each is linked). ``groups`` adds the groups as text.
    """
    many_a, many_b = _sizes(byte_level, pieces)
    small = many_a * many_b < 1 << 31
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, _row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    schema += f", pairs array<{'int' if small else 'bigint'}>, times array<int>" + (", groups string" if groups else "")
    pair_type = pa.int32() if small else pa.int64()

    def run(batches):
        both = tokenizers(byte_level, pieces)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, off = text_buffers(batch.column(1))
            for lo, hi in slices(off):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                found = both.encode(texts)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo))]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*columns, *_columns(found, both, many_b, pair_type, groups)], names=names)

    names = [id_col, "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]
    return shipped(df.select(id_col, text_col)).mapInArrow(run, schema)


def _columns(found: list, both: Tokenizers, many_b: int, pair_type: pa.DataType, groups: bool) -> list[pa.Array]:
    """The columns of ``aligned`` for some texts, from their identifiers."""
    n = len(found)
    n_a, n_b = (np.array([len(f[k]) for f in found]) for k in (0, 1))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    a_sizes = both.a_sizes[a]
    lined = Alignment(a, b, a_sizes, both.b_sizes[b])
    # The bytes up to the end of each text.
    upto = np.concatenate([[0], np.cumsum(a_sizes)])[np.cumsum(n_a)]
    group_ends, link_ends = np.searchsorted(lined.cuts, upto), np.searchsorted(lined.stretches, upto)
    has = n_a > 0
    last = np.zeros(len(lined.cuts), bool)
    last[group_ends[has] - 1] = True
    text, places = lined.shown(last)
    ends = np.concatenate([[0], places])[group_ends]
    begins = np.concatenate([[0], ends[:-1]])
    parts = [text[x:y].tobytes() for x, y in zip(begins.tolist(), ends.tolist())]
    doc = np.repeat(np.arange(n), np.diff(link_ends, prepend=0))
    keys = np.sort((doc << 40) | (lined.link_a * many_b + lined.link_b))
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(first, append=len(keys)).astype(np.int32)
    keys = keys[first]
    offsets = np.searchsorted(keys, np.arange(n + 1) << 40).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets), values)
    out = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.diff(group_ends, prepend=0), np.diff(link_ends, prepend=0))]
    out += [pa.array([hashlib.sha256(p).hexdigest() if x else "" for p, x in zip(parts, has.tolist())])]
    out += [listed(pa.array(keys & ((1 << 40) - 1)).cast(pair_type)), listed(pa.array(times))]
    return [*out, pa.array([p.decode() for p in parts])] if groups else out


def pair_counts(rows: DataFrame, many_b: int) -> DataFrame:
    """In how many rows of ``aligned`` each pair is linked: pair, docs, and best, whether no pair of its first identifier is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    of_first = Window.partitionBy(F.floor(F.col("pair") / many_b))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(of_first))


def token_alignment(df: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's alignment held against the corpus.

    Columns: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of their
    first identifier), count_sum (of the documents of each link's pair), groups_sha256.
    """
    rows = written(aligned(df, byte_level, pieces, id_col, text_col), "aligned", compression="zstd")
    counts = written(pair_counts(rows, _sizes(byte_level, pieces)[1]), "pair-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = rows.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    links = links.toDF("_row", "pair", "times").join(counts, "pair")
    sums = links.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = rows.drop("pairs", "times").join(sums, "_row", "left")
    return out.select(F.col(f"`{id_col}`"), "n_a", "n_b", "n_groups", "n_links", zero("_best").alias("n_best"), zero("_sum").alias("count_sum"), "groups_sha256")
