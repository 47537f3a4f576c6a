"""Packing of tokenised documents into sequences by order-preserving dynamic programming.

The tokens of consecutive documents are one stream. A sequence is a window of at most ``size`` tokens;
its cuts lie at document ends, sentence ends or, inside long stretches without either, at fixed steps.
The plan of least cost is found over all cuts of a block of documents: the cost of a window is its
padding, and that of a cut is its truncation penalty (none at a document's end). Padding is linear in
the length, so the best earlier cut is the minimum of a sliding window, kept in a monotone queue; every
cut enters and leaves it once.

Documents keep their order within a task, and each task packs its own, in blocks of bounded tokens: no
shuffle, and memory that does not follow the input. The last window of a block goes over to the next, so that
only the last sequence of a task is short.

Added tokens of the vocabulary file stand for themselves wherever their string occurs in a text, as the
library has it; ``special_as_text`` makes these strings ordinary text.

Cases: a null text is empty and has one token, the end mark; repeated identifiers are documents of their
own; other columns are not read; an empty table gives no rows; a vocabulary whose added tokens take white
space beside them, or stand for whole words only, is an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gyre.llm.bpe import MEMO_PIECES
from gyre.llm.pretok import cut
from gyre.llm.session import shipped
from gyre.llm.text import slices, text_buffers

SIZE = 1024
#: Costs, in tokens of padding, of a cut at a sentence's end and of one inside a sentence.
SENTENCE, INSIDE = 4, 24
#: Tokens between the cuts allowed in a stretch without an end of a document or sentence.
STEP = 32
#: Tokens of one block of the plan.
BLOCK = 1 << 19


def plan(cuts: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the cuts of the cheapest plan, the first and the last always among them.

    ``cuts`` are ascending places, no two neighbours more than ``size`` apart. The cost up to cut i is
    penalty[i] + min over j of (cost[j] + padding of the window from j to i).
    """
    where, price = cuts.tolist(), penalty.tolist()
    n = len(where)
    key, before = [float(where[0])] * n, [0] * n  # key: cost + place
    queue: deque[int] = deque([0])  # cuts by rising place and rising key
    for i in range(1, n):
        p = where[i]
        while where[queue[0]] < p - size:
            queue.popleft()
        j = queue[0]
        before[i] = j
        own = key[i] = key[j] + size + price[i]
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(i)
    out, i = [n - 1], n - 1
    while i:
        i = before[i]
        out.append(i)
    return out[::-1]


def candidates(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream of ``total`` tokens may be cut, and the penalty of each."""
    ends = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends]))
    gaps = np.diff(ends)
    wide = np.flatnonzero(gaps > STEP)
    more = (gaps[wide] - 1) // STEP
    inside = np.repeat(ends[wide] - STEP * (np.cumsum(more) - more - 1), more) + STEP * np.arange(more.sum())
    cuts = np.concatenate([ends, inside])
    penalty = np.concatenate([np.full(len(ends), SENTENCE, float), np.full(len(inside), INSIDE, float)])
    penalty[: len(ends)][np.isin(ends, np.concatenate([[0, total], doc_ends]), assume_unique=False)] = 0
    order = np.argsort(cuts, kind="stable")
    return cuts[order], penalty[order]


class Coder:
    """Identifiers of texts by a vocabulary file of the ``tokenizers`` library, piece by piece."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, self.n = tokenizer.model, tokenizer.get_vocab_size()
        shown = _byte_letters()
        self.memo = Slots(lambda p: [t.id for t in model.tokenize("".join([shown[b] for b in p.encode("utf-8", "surrogatepass")]))])
        self.closes = np.zeros(self.n, bool)
        for token, i in tokenizer.get_vocab().items():
            self.closes[i] = token[-1] in ".!?" or shown[10] in token
        added = {} if special_as_text else {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError(f"{path}: added tokens that depend on what stands beside them")
        self.added = {content: i for content, (i, _) in added.items()}
        self.marks = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not any(c in t for t in texts for c in self.added):
            return self._plain(texts)
        # Parts between added tokens at even places, added tokens at odd ones.
        parts = [self.marks.split(t) for t in texts]
        plain = iter(self._plain([p for part in parts for p in part[::2]]))
        mark = lambda c: np.array([self.added[c]], np.uint32)
        return [np.concatenate([mark(p) if i % 2 else next(plain) for i, p in enumerate(part)]) for part in parts]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        pieces, first = cut(texts)
        runs = [self.memo.tokens(pieces[i : i + MEMO_PIECES]) for i in range(0, len(pieces), MEMO_PIECES)]
        ids, counts = (np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum(counts)])[first].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


class Slots(dict):
    """Pieces by the number of their slot; the identifiers of all slots stand in one array. Emptied when full."""

    def __init__(self, encode):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new, self.ids, self.first = [], np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = len(self)
        self.new.append(piece)
        return slot

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of the pieces in order, and how many each piece has."""
        if len(self) >= MEMO_PIECES:
            self._empty()
        slot = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            found = list(map(self.encode, self.new))
            self.new = []
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        counts = self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.first[slot] - ends + counts, counts) + np.arange(counts.sum())], counts


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's tokens."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@functools.cache
def coder(path: str, special_as_text: bool) -> Coder:
    return Coder(path, special_as_text)


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0, special_as_text: bool = False, block: int = BLOCK
) -> DataFrame:
    """The pieces of packed documents, one row each.

    Columns: id, start (the document's tokens before the piece), length, ids_crc32, doc_tokens (with the
    end mark), sequence_id (the task's number in the upper bits), offset (place in the sequence), and
    token_ids, the piece's own identifiers.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, token_ids array<int>"
    )

    def run(batches):
        code = coder(vocabulary, special_as_text)
        held = Held()
        sequence = TaskContext.get().partitionId() << 33

        def flush(last: bool):
            nonlocal sequence
            out, windows = _pieces(held, sequence, size, code.closes, last)
            sequence += windows
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids"]
        types = None
        mark = np.array([end_id], np.uint32)
        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            _, off = text_buffers(batch.column(1))
            for lo, hi in slices(off):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for key, found in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), code.encode(texts)):
                    held.add(key, np.concatenate([found, mark]))
                if held.tokens >= block:
                    yield flush(False)
        if held.docs:
            yield flush(True)

    return shipped(df.select(id_col, text_col)).mapInArrow(run, schema)


class Held:
    """Documents that wait to be packed; of the first, ``begun`` tokens have been packed already."""

    def __init__(self):
        self.docs, self.ids, self.sizes, self.begun, self.tokens = [], [], [], 0, 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)
        self.sizes.append(len(ids))
        self.tokens += len(ids)

    def drop(self, ends: np.ndarray, upto: int) -> None:
        """Drop the first ``upto`` tokens; ``ends`` are those of the documents."""
        i = int(np.searchsorted(ends, upto, "right"))
        inside = upto - (int(ends[i - 1]) if i else 0)
        self.begun = inside + (0 if i else self.begun)
        self.docs, self.ids, self.sizes = self.docs[i:], self.ids[i:], self.sizes[i:]
        if self.ids:
            self.ids[0] = self.ids[0][inside:]
        self.tokens -= upto


def _pieces(held: Held, sequence: int, size: int, closes: np.ndarray, last: bool) -> tuple[list[list], int]:
    """Columns of the pieces of a block, which are dropped from it, and the number of its sequences.

    The last window stays in the block unless it is the ``last`` of all.
    """
    stream = np.concatenate(held.ids)
    ends = np.cumsum([len(x) for x in held.ids])
    sentence = np.flatnonzero(closes[stream]) + 1
    cuts, penalty = candidates(len(stream), ends, sentence)
    windows = cuts[plan(cuts, penalty, size)]
    if not last and len(windows) > 2:
        windows = windows[:-1]
    edges = np.unique(np.concatenate([windows, ends[ends < windows[-1]]]))
    begin, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(ends, begin, "right")
    opens = np.concatenate([[0], ends[:-1]])
    window = np.searchsorted(windows, begin, "right") - 1
    parts = [stream[a : a + n] for a, n in zip(begin.tolist(), length.tolist())]
    columns = [
        [held.docs[i] for i in doc.tolist()],
        begin - opens[doc] + np.where(doc == 0, held.begun, 0),
        length,
        [zlib.crc32(p.astype("<u4").tobytes()) for p in parts],
        np.array(held.sizes)[doc],
        sequence + window,
        begin - windows[window],
        [p.astype(np.int32) for p in parts],
    ]
    held.drop(ends, int(windows[-1]))
    return columns, len(windows) - 1
