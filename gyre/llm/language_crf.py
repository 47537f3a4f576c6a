"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of its features: prefixes and suffixes, inner byte
n-grams, and the word itself as an entry of the learned lexicon, all hashed into one table. Scores of pairs
of neighbouring labels are learned too, so that a text may switch between languages but seldom does. The
forward-backward algorithm gives each word's label probabilities over its whole text: chunks of words are
turned into transfer matrices side by side, messages run over the chunks, and then through each chunk.

The field is fitted by stochastic gradient of its likelihood on a bounded sample of labelled texts, chosen
by the hash of their rows: of each label the first ``SAMPLE`` texts of at most ``TEXT_BYTES``, as far as they have no
more than ``SAMPLE_BYTES`` together. Everything else sees all rows and whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text where no labelled
row can be learned from; rows with a null label are predicted but not learned from; null or repeated
identifiers are rows like others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.session import shipped
from gyre.llm.text import LOWER, Words, mix, slices, text_buffers

#: Labelled texts learned from, for each label, their bytes together, and those of one.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 300, 8 << 20, 1 << 20
#: Passes over them, and texts of one step.
EPOCHS, STEP = 4, 24
TABLE_BITS = 18
RATE, DECAY = 0.3, 1e-4
AFFIXES, GRAM = (1, 2, 3, 4), 3
#: Bytes of text whose features are held at a time, some hundred times their size.
SLICE = 1 << 18
#: Words of a chunk of the forward-backward algorithm.
CHUNK = 32
UNDECIDED = "und"


_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2**bits powers of an odd constant and of its inverse, modulo 2**64: a feature may share its place with others."""
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, np.uint64(x))]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


class Features:
    """Places in the weight table of each word's features: ``whole`` (words x features), ``gram`` and its word."""

    def __init__(self, words: Words):
        data, n = words.data, len(words.data)
        up, down = _powers(max(20, (n - 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        start, end = words.start, words.end

        def place(a, b, kind: int):
            h = mix((total[b] - total[a]) * down[a] + np.uint64(kind << 56))
            return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

        columns = [place(start, end, 1)]
        for size in AFFIXES:
            columns.append(place(start, np.minimum(start + size, end), 1 + size))
            columns.append(place(np.maximum(end - size, start), end, 17 + size))
        self.whole = np.stack(columns, 1) if len(start) else np.zeros((0, 1 + 2 * len(AFFIXES)), np.int64)
        sizes = np.maximum(end - start - GRAM + 1, 0)
        self.word = np.repeat(np.arange(len(start)), sizes)
        begin = start[self.word] + np.arange(len(self.word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.gram = place(begin, begin + GRAM, 40)
        self.sizes = sizes


@dataclass
class Field:
    """A fitted field: labels, weights of features (table x labels), scores of neighbouring labels."""

    labels: list[str]
    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        out = self.weights[f.whole[:, 0]].copy()
        for i in range(1, f.whole.shape[1]):
            out += self.weights[f.whole[:, i]]
        if len(f.gram):
            some = np.flatnonzero(f.sizes)
            opens = np.cumsum(f.sizes) - f.sizes
            out[some] += np.add.reduceat(self.weights[f.gram], opens[some], axis=0)
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word, and expected counts of neighbouring labels (before normalisation by text)."""
        n_labels = len(self.labels)
        counts = np.diff(first)
        chunks = -(-counts // CHUNK)
        n = int(chunks.sum())
        move = np.exp(self.pairs)
        if not n:
            return np.zeros((0, n_labels)), np.zeros((n_labels, n_labels))
        head = np.cumsum(chunks) - chunks
        doc = np.repeat(np.arange(len(counts)), chunks)
        at = first[doc] + (np.arange(n) - head[doc]) * CHUNK
        grid = at[:, None] + np.arange(CHUNK)
        real = grid < first[doc + 1][:, None]
        e = np.exp(scores - scores.max(1, keepdims=True))
        e = e[np.minimum(grid, len(scores) - 1)]
        # Transfer matrix of each chunk.
        through = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
        for t in range(CHUNK):
            then = (through.reshape(-1, n_labels) @ move).reshape(n, n_labels, n_labels) * e[:, t, None, :]
            then /= then.sum((1, 2), keepdims=True)
            through = np.where(real[:, t, None, None], then, through)
        into = np.full((n, n_labels), 1.0 / n_labels)
        onward = np.full((n, n_labels), 1.0 / n_labels)
        order = np.argsort(-chunks, kind="stable")
        left = np.searchsorted(-chunks[order], -np.arange(1, chunks.max() + 1), "right")
        for i in range(1, int(chunks.max())):
            c = head[order[: left[i]]] + i
            m = np.einsum("ni,nij->nj", into[c - 1], through[c - 1])
            into[c] = m / m.sum(1, keepdims=True)
            last = (head + chunks)[order[: left[i]]] - i
            m = np.einsum("nij,nj->ni", through[last], onward[last])
            onward[last - 1] = m / m.sum(1, keepdims=True)
        ahead = np.empty((n, CHUNK, n_labels))
        a = into
        for t in range(CHUNK):
            m = (a @ move) * e[:, t]
            a = np.where(real[:, t, None], m / m.sum(1, keepdims=True), a)
            ahead[:, t] = a
        post = np.empty((n, CHUNK, n_labels))
        joint = np.zeros((n_labels, n_labels))
        b = onward
        for t in range(CHUNK - 1, -1, -1):
            p = ahead[:, t] * b
            post[:, t] = p / p.sum(1, keepdims=True)
            before = ahead[:, t - 1] if t else into
            carried = e[:, t] * b
            weight = np.einsum("ni,ij,nj->n", before, move, carried)
            joint += np.where(real[:, t, None], before / weight[:, None], 0).T @ carried * move
            m = carried @ move.T
            b = np.where(real[:, t, None], m / m.sum(1, keepdims=True), b)
        return post[real], joint


def _words(texts: pa.Array) -> Words:
    data, off = text_buffers(texts)
    return Words(LOWER[data], off)


def fit(texts: list[str], labels: list[str]) -> Field:
    """Fit a field to texts, all of whose words have the text's label."""
    names = sorted(set(labels))
    n = len(names)
    field = Field(names, np.zeros((1 << TABLE_BITS, n), np.float32), np.zeros((n, n)))
    squares, pair_squares = np.full(field.weights.shape, 1e-6, np.float32), np.full((n, n), 1e-6)
    gold = np.array([names.index(x) for x in labels])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        turn = order.permutation(len(texts))
        for i in range(0, len(turn), STEP):
            batch = turn[i : i + STEP]
            words = _words(pa.array([texts[j] for j in batch], pa.string()))
            if not len(words.start):
                continue
            f = Features(words)
            post, joint = field.marginals(field.emissions(f), words.first)
            truth = gold[batch][words.doc]
            slope = -post
            slope[np.arange(len(truth)), truth] += 1
            steps = np.zeros(field.weights.shape)
            flat, owner = np.concatenate([f.whole.ravel(), f.gram]), np.concatenate([np.repeat(np.arange(len(truth)), f.whole.shape[1]), f.word])
            for k in range(n):
                steps[:, k] = np.bincount(flat, slope[owner, k], minlength=len(steps))
            steps /= len(batch)
            touched = np.flatnonzero(steps.any(1))
            g = steps[touched] - DECAY * field.weights[touched]
            squares[touched] += g**2
            field.weights[touched] += RATE * g / np.sqrt(squares[touched])
            together = np.zeros((n, n))
            inner = words.doc[1:] == words.doc[:-1]
            np.add.at(together, (truth[1:][inner], truth[:-1][inner]), 1)
            g = (together.T - joint) / len(batch) - DECAY * field.pairs
            pair_squares += g**2
            field.pairs += RATE * g / np.sqrt(pair_squares)
    return field


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Field:
    """Fit a field on a sample of the rows with text and label that are not held out."""
    rows = df.where(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("_text"), F.col(label_col).alias("_label"), F.xxhash64(id_col, text_col).alias("_r"))
    rows = rows.where(F.octet_length("_text") <= TEXT_BYTES)
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    # Of labels with many rows only those of low hash enter the sort.
    share = lambda n: min(1.0, 1.3 * SAMPLE / n)
    below = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(int(-(2**63) + share(n) * 2**64), 2**63 - 1))])
    order = Window.partitionBy("_label").orderBy("_r")
    sized = rows.where(F.col("_r") <= below[F.col("_label")]).withColumn("_bytes", F.sum(F.octet_length("_text")).over(order))
    chosen = sized.withColumn("_rank", F.row_number().over(order)).where((F.col("_rank") <= SAMPLE) & (F.col("_bytes") <= SAMPLE_BYTES))
    picked = sorted((r["_label"], r["_r"], r["_text"]) for r in chosen.select("_label", "_r", "_text").collect())
    return fit([text for *_, text in picked], [label for label, *_ in picked])


def identify(
    df: DataFrame, field: Field, text_col: str = "text", spans: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "word_langs")
) -> DataFrame:
    """``df`` with lang_pred and score, the mean probability of that label over the words of the text.

    ``spans`` adds word_langs, runs of words as (lang, words). Columns of ``df`` with one of the ``names`` given
    to the new ones give way.
    """
    model = df.sparkSession.sparkContext.broadcast(field)
    new = {names[0]: T.StringType(), names[1]: T.DoubleType()}
    if spans:
        new[names[2]] = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())]))
    fields = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(fields + [T.StructField(k, v) for k, v in new.items()])

    def run(batches):
        field = model.value
        n = len(field.labels)
        for batch in batches:
            col = batch.column(batch.num_columns - 2)
            data, off = text_buffers(col)
            pred, score, runs = [], [], []
            for lo, hi in slices(off, SLICE):
                words = Words(LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo])
                post, _ = field.marginals(field.emissions(Features(words)), words.first) if n else (np.zeros((0, 1)), None)
                total = np.concatenate([np.zeros((1, max(n, 1))), np.cumsum(post, axis=0)])
                size = np.diff(words.first)
                mean = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(size, 1)[:, None] if n else np.zeros((hi - lo, 1))
                best = mean.argmax(1)
                some = batch.column(batch.num_columns - 1).slice(lo, hi - lo).to_pylist()
                for d in range(hi - lo):
                    ok = bool(n and some[d] and size[d])
                    pred.append(field.labels[best[d]] if ok else UNDECIDED)
                    score.append(float(min(1.0, max(0.0, mean[d, best[d]]))) if ok else 0.0)
                    if spans:
                        runs.append(_runs(post[words.first[d] : words.first[d + 1]], field.labels) if ok else [])
            arrays = [*(batch.column(i) for i in range(batch.num_columns - 2)), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                arrays.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = shipped(df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").alias("__gyre_text"), letters.alias("__gyre_letters")))
    return given.mapInArrow(run, schema)


def _runs(post: np.ndarray, labels: list[str]) -> list[dict]:
    best = post.argmax(1)
    edges = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1], [True]]))
    return [{"lang": labels[best[a]], "words": int(b - a)} for a, b in zip(edges, edges[1:])]


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per row: id, held_out, lang_pred, score; learned from the rows that are not held out."""
    field = learn(df, id_col, text_col, label_col)
    rows = df.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("_source"))
    return identify(rows, field, "_source").drop("_source")
