"""The registered queries: SQL where there is some, the pipeline's stages against brute force."""

import base64
import hashlib
import os
import struct
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from gyre.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", queries.ORACLE)
def test_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(queries.ORACLE[name]).df())


def test_near_and_passages_on_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op2_hyperminhash"](spark, DATA).collect()}
    assert out == brute.components(docs, 3, 85)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op4_substring_automata"](spark, DATA).collect()}
    assert out == brute.passages(docs, 20)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, lang_pred int, kept string, component_id string, _h string, token_ids string"
    own = ("high", 5, "k", "c", "h", "t")
    stock = {"en": "the and of that with which have this from other", "fr": "les des une avec pour dans que est sont leur"}
    shared = " ".join(f"passage{i}" for i in range(60))
    data = [(i, f"{stock[x]} {i} word{i} {stock[x][i % 7:]} x{i * i}", x, "s", 1) for i, x in enumerate(["en", "fr"] * 20)]
    data += [(None, "the and of that with", None, None, None), (100, None, None, "s", 7), (101, "", "en", "s", 0), (102, "12 34 !?", "en", None, 1)]
    data += [(103, "the and of that with which " * 3000, "en", "s", 1), (103, "une avec pour dans que est tout autre", "fr", "s", 1)]
    data += [(104, f"the and {shared}", "en", "a", 1), (105, f"of that have {shared} from other ends", "en", "b", 1)] * 2
    docs = spark.createDataFrame([(*r, *own) for r in data], schema)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.where("false"), DATA)
        assert empty.count() == 0
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            continue
        assert out.schema.simpleString() == docs.schema.simpleString() == empty.schema.simpleString()
        path = str(tmp_path / str(n))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        untouched = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert set(_rows(after.select(*untouched))) <= set(_rows(docs.select(*untouched)))
        texts = sorted((r.doc_id or -1, r.text) for r in after.collect() if r.text is not None and "passage1 " not in r.text)
        if name == "language id":
            want = [r for r in data if r[1] and r[0] not in (101, 102)]
            assert after.count() == len(want) and texts == sorted((r[0] or -1, r[1]) for r in want if "passage1 " not in r[1])
        if name == "substring dedup":
            assert sum("passage1 " in r.text for r in after.collect()) in (1, 2)
        docs = after


def test_whole_tables_against_the_libraries(spark):
    """op5 and op10 over every document, by the public libraries."""
    P, tiktoken, tokenizers = (pytest.importorskip(m) for m in ("public_tokenizers", "tiktoken", "tokenizers"))
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(ids := own.encode_ordinary(t)), digest(" ".join(map(str, ids)).encode()), digest(t.encode())) for i, t in docs}
    out = queries.QUERIES["op5_bpe_transducer"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want
    coder = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = queries.QUERIES["op10_dp_packing"](spark, DATA).toPandas()
    ids = {i: coder.encode(t, add_special_tokens=False).ids + [0] for i, t in docs}
    assert set(out["doc_id"]) == set(ids)
    for i, g in out.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[i][at : at + r.length]))
            at += r.length
        assert at == len(ids[i])
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 1024


def test_whole_tables_against_labels_and_neighbours(spark):
    """op6 by the labels of held-out documents, op9 by its edited texts."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.QUERIES["op6_crf_language"](spark, DATA).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) > 0.9 * len(known) > 10
    out = queries.QUERIES["op9_syncmers"](spark, DATA).collect()
    ordered = sorted(out, key=lambda r: -r.doc_id)
    assert len(out) == len(docs)
    hashes = lambda shown: {x.split(":")[0] for x in shown.split(",") if x}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r, after in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = (docs[x.doc_id].text or "" for x in (r, after))
        m = len(text) // 3
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(hashes(r.fingerprint), hashes(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(alike(hashes(r.fingerprint), hashes(after.fingerprint)))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DATA).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        if name != "packing":
            assert after.columns == columns
            old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
            assert set(new) <= set(old)
        if name == "near dedup":
            want = brute.components(list(old.items()), 5, 80)
            assert set(new) == {i for i, (_, c) in want.items() if i == c} and all(new[i] == old[i] for i in new)
        if name == "substring dedup":
            want = brute.passages(list(old.items()), corpus_pipeline.PASSAGE)
            kept = {i: len(brute.words(t)) for i, t in new.items()}
            assert kept == {i: n - cut for i, (n, cut, _) in want.items() if not cut or n > cut}
        before = after
    assert before.count() > 0
