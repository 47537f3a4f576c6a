"""The alignment of two tokenizers against a plain version by the public libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gyre.llm import token_alignment as ta

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, n_a string, times int, _row int"
TEXTS = [
    "The quick brown fox.", "The quick  brown\tfox jumps", "", None, " ", "\n\n", "naïve Übergröße 中文字 😀 ok", "a<|endoftext|>b <s> </s> <0x41>", "x▁y", "é é ﬁ Å", "\x00\x01 zero",
    "word " * 3000, "The quick brown fox.", "’quotes’ and — dashes…", "1234567890 3.14159 v2.0", "trailing ", "q" * 5000,
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    shown = {c: b for b, c in enumerate(ta._byte_letters())}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_b(i):
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in rows:
        whole = f" {text or ''}".encode()
        a = [(i, bytes(shown[c] for c in t.id_to_token(i))) for i in t.encode(f" {text or ''}", add_special_tokens=False).ids]
        b = [(i, bytes_b(i)) for i in sp.encode(text or "")]
        if not text or b"".join(x[1] for x in a) != whole or b"".join(x[1] for x in b) != whole:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if last < e <= c) for side in spans))
            last = c
        links, j = [], 0
        for x, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    links.append((x, spans[1][j][0]))
                j += 1
        counts.update(set(links))
        found.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        best, total = sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def rows(out):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in out.collect()), key=repr)


@pytest.mark.parametrize("broadcast", [ta.BROADCAST_PAIRS, 0])
def test_against_plain(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", broadcast)
    rnd = random.Random(4)
    more = ["".join(rnd.choice(["the ", "and", "ing ", " ", "é", "Zz", "9", ".\n", "中", "über"]) for _ in range(rnd.randint(1, 80))) for _ in range(120)]
    data = [(i % 130 if i else None, t) for i, t in enumerate(TEXTS + more)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in data], SCHEMA).repartition(3)
    assert rows(ta.token_alignment(df, A, B)) == plain(data)


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in ta.aligned(df, A, B, groups=True).collect()}
    assert hashlib.sha256(out[1].groups.encode()).hexdigest() == out[1].groups_sha256 and sum(out[1].times) == out[1].n_links
    assert out[2].groups == out[2].groups_sha256 == "" and out[2].pairs == []


def test_empty(spark):
    assert ta.token_alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_marks():
    rnd = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        x, y = (np.unique(rnd.integers(0, n, n // 2 + 1)) for _ in range(2))
        a, b = ta.Marks.at(x, n), ta.Marks.at(y, n)
        assert (a & b).select().tolist() == sorted({*x} & {*y}) and (a | b).select().tolist() == sorted({*x} | {*y})
        assert a.rank(np.arange(n + 1)).tolist() == [int((x < p).sum()) for p in range(n + 1)]
