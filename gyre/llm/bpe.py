"""Byte-level BPE as a lazily determinised finite-state transducer, with streaming decoding.

The merges are compiled into one relation: two tokens may stand side by side if and only if no merge
across their common edge comes before the merges that build them. The last token of each prefix of a
piece is then unique, and so the chain of tokens that leads to each byte. A state of the transducer holds
the places where a token that a later byte completes may have begun, as the bytes since the first of
them and the last token before each. A state and its transition for a byte are made when first needed.
Once no token can reach across the present place, the chain up to it is settled and emitted; the
lookahead is bounded by the length of the longest token.

Decoding goes from identifiers to bytes chunk by chunk, and an incremental UTF-8 state machine holds
back the bytes of an unfinished character.

Cases: a null text is the empty text and has no tokens; identifiers of rows may be null or repeated, each
row has its own result; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from gyre.llm.pretok import cut
from gyre.llm.session import shipped
from gyre.llm.text import slices, text_buffers

#: Entries kept by a worker; beyond them the memo is emptied and filled anew, results stay the same.
MEMO_PIECES, MEMO_STATES = 300_000, 150_000


class Transducer:
    """Encodes single pieces by the ranks of a vocabulary (bytes of a token to its identifier)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.sizes = [len(t) for t in self.vocab]
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._stands: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, int, float]]] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple[bytes, tuple[int, ...]], tuple] = {}
        self._start = self._state(b"", (-1,))

    def _state(self, since: bytes, last: tuple[int, ...]) -> tuple:
        """A state: transitions by byte, whether all before it is settled, bytes since the first open place, last tokens."""
        state = self._states.get((since, last))
        if state is None:
            state = self._states[since, last] = ({}, len(last) == 1, since, last)
        return state

    def merge(self, data: bytes, parts_left: int = 1) -> list[int]:
        """Tokens of ``data`` by merging the pair of lowest rank again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > parts_left:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _edge(self, token: int, right: bool) -> list[tuple[int, int, float]]:
        """The tokens that stand at an edge of ``token`` while it is built: token, rank that makes it, rank that takes it."""
        known = self._edges.get((token, right))
        if known is None:
            if self.sizes[token] == 1:
                known = [(token, -1, float("inf"))]
            else:
                inner = self._edge(self.merge(self.vocab[token], 2)[1 if right else 0], right)
                known = [*inner[:-1], (inner[-1][0], inner[-1][1], token), (token, token, float("inf"))]
            self._edges[token, right] = known
        return known

    def stands(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; -1 stands for the start of the piece."""
        known = self._stands.get((a, b))
        if known is None:
            if a < 0:
                known = len(self.merge(self.vocab[b])) == 1
            elif not self.stands(-1, b):
                known = False
            else:
                # Of equal ranks the left pair merges first.
                known = not any(
                    made_a <= gone_b and made_b < gone_a and (q := self.ranks.get(self.vocab[x] + self.vocab[y])) is not None and q < gone_a and q <= gone_b
                    for x, made_a, gone_a in self._edge(a, True)
                    for y, made_b, gone_b in self._edge(b, False)
                )
            if len(self._stands) > 4 * MEMO_STATES:
                self._stands.clear()
            self._stands[a, b] = known
        return known

    def _step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The transition of a state for a byte: the next state, and the last token of the bytes so far."""
        since, last = state[2], state[3]
        ahead, prefixes = since + bytes((byte,)), self.prefixes
        open_at = [i for i in range(len(since)) if since[i:] in prefixes] + [len(since)]
        token = next(t for i, before in zip(open_at, last) if (t := self.ranks.get(ahead[i:])) is not None and self.stands(before, t))
        still = [(i, before) for i, before in zip(open_at, last) if ahead[i:] in prefixes]
        first = still[0][0] if still else len(ahead)
        nxt = self._state(ahead[first:], (*[before for _, before in still], token))
        state[0][byte] = (nxt, token)
        return nxt, token

    def _chain(self, last: list[int]) -> list[int]:
        """The tokens that end at the end of ``last``, in order."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= self.sizes[last[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self._states) > MEMO_STATES:
            self._reset()
        state, last, out = self._start, [], []
        for byte in piece:
            known = state[0].get(byte)
            state, token = known if known is not None else self._step(state, byte)
            last.append(token)
            if state[1]:
                out += self._chain(last)
                last = []
        return tuple(out + self._chain(last))


@functools.cache
def load(path: str) -> Transducer:
    """The transducer of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Pieces(dict):
    """Tokens of pieces by text, filled by the function given and emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str):
        if len(self) >= MEMO_PIECES:
            self.clear()
        out = self[piece] = self.encode(piece)
        return out


def decode(ids: Iterable[int], vocab: list[bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of the identifiers, chunk by chunk; a character is given once its last byte has come."""
    ids = ids if isinstance(ids, list) else list(ids)
    machine = codecs.getincrementaldecoder("utf-8")("surrogatepass")
    for i in range(0, len(ids), chunk):
        yield machine.decode(b"".join([vocab[t] for t in ids[i : i + chunk]]))
    yield machine.decode(b"", True)


def bpe_round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: id, n_tokens, ids_sha256, decoded_sha256."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = load(ranks_path)
        memo = Pieces(lambda p: coder.encode(p.encode("utf-8", "surrogatepass")))
        names = [str(i) for i in range(len(coder.vocab))]
        for batch in batches:
            _, off = text_buffers(batch.column(1))
            counts, ids_sha, text_sha = [], [], []
            for lo, hi in slices(off):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                pieces, first = cut(texts)
                first = first.tolist()
                for a, b in zip(first, first[1:]):
                    ids = list(chain.from_iterable(map(memo.__getitem__, pieces[a:b])))
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    back = hashlib.sha256()
                    for part in decode(ids, coder.vocab):
                        back.update(part.encode("utf-8", "surrogatepass"))
                    text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return shipped(df.select(id_col, text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
