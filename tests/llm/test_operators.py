import functools
import hashlib
import random
import struct
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from gyre.llm import language_crf, line_dedup, near_dedup, packing, sharding, substring_dedup, syncmers, warc  # noqa: E402
from gyre.llm.bpe import Transducer, bpe_round_trip, decode, load  # noqa: E402
from gyre.llm.exact_dedup import exact_dedup  # noqa: E402
from gyre.llm.pretok import cut  # noqa: E402

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, shard_id string, n_words long"
ODD = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", True, "x", 1),
    (3, " \n\t ", "en", "a", True, "x", 1),
    (None, "a b c", None, "b", False, "", None),
    (5, "word " * 4000, "en", "b", False, "", 0),
    (6, "12 34 !?", "fr", None, True, None, 7),
    (6, "12 34 !?", "fr", None, True, None, 7),
    (7, "x" * 50_000, "fr", "c", True, None, 7),
    (8, "É́ 中文\x00   end", "de", "c", True, None, 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)) if isinstance(texts[0], str) else texts, schema)


def random_texts(n, seed, letters="abc", most=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rnd.choice(letters) for _ in range(rnd.randint(0, most))]
        if out and rnd.random() < 0.3:
            w += rnd.choice(out).split()
        out.append(rnd.choice(out) if out and rnd.random() < 0.1 else " ".join(w))
    return out


# 1


@pytest.mark.parametrize("limit", [40, 300, 10_000])
def test_shards_fit_and_split_only_when_too_large(spark, limit):
    df = docs(spark, random_texts(200, 1))
    out = sharding.extendible_shards(df, limit=limit).collect()
    assert len(out) == 200
    size, of = {}, {}
    bits = {r.doc_id: format(int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:15], 16), "060b") for r in out}
    for r in out:
        assert bits[r.doc_id].startswith(r.shard_id) and len(r.shard_id) == r.depth
        size[r.shard_id] = size.get(r.shard_id, 0) + r.n_bytes
        of[r.shard_id] = r
    whole = lambda p: sum(r.n_bytes for r in out if bits[r.doc_id].startswith(p))
    for shard, r in of.items():
        assert r.shard_bytes == size[shard] and r.oversized == (size[shard] > limit)
        assert size[shard] <= limit or r.shard_rows == 1
        assert not shard or whole(shard[:-1]) > limit


def test_shards_of_odd_rows(odd, none, tmp_path):
    out = sharding.extendible_shards(odd, limit=100, max_depth=12).collect()
    assert len(out) == len(ODD) and any(r.oversized for r in out)
    assert sharding.extendible_shards(none).count() == 0
    sharding.write_shards(odd.where("doc_id IS NOT NULL"), str(tmp_path / "s"), limit=1 << 20)
    assert odd.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(ODD) - 1


def test_written_shards_keep_rows_without_identifier(odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), limit=100)
    back = odd.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD) and back.where("doc_id IS NULL").count() == 1
    assert sorted(back.columns) == sorted(odd.columns)


# 2


def near(df, **k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, **k).collect()}


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, " ".join(f"y{rnd.randint(0, 5)}" for _ in range(rnd.randint(0, 8)))) for i in range(80)]


@pytest.mark.parametrize("k,percent,options", [(3, 85, {}), (5, 80, {}), (3, 85, {"block": 4000, "pivots": 8}), (5, 80, {"nodes": 20, "pivots": 2})])
def test_near_duplicates(spark, copies, k, percent, options):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert near(df, words=k, percent=percent, **options) == brute.components(copies, k, percent)


def test_near_duplicates_of_frequent_lines(spark):
    rnd = random.Random(0)
    lines = [" ".join(f"l{i}w{j}" for j in range(3)) for i in range(8)]
    rows = []
    for i in range(1500):
        body = " ".join(rnd.choices(lines, k=6))
        rows += [(2 * i, body), (2 * i + 1, f"{body} end")] if i % 5 == 0 else [(2 * i, body)]
    assert near(docs(spark, rows), words=3, percent=85) == brute.components(rows, 3, 85)


@pytest.mark.parametrize("options", [{}, {"nodes": 30, "pivots": 4}])
def test_near_duplicates_among_texts_with_a_common_phrase(spark, options):
    rows, n = [], 0
    for pair in range(12):
        a = [f"a{pair}w{j}" for j in range(8)]
        for i in range(302):
            own = f"p{pair}o{i}"
            text = a if i == 150 else [*a, "more"] if i == 151 else [own, *a[i % 3 : i % 3 + 6], f"{own}x"]
            rows.append((n, " ".join(text)))
            n += 1
    want = brute.components(rows, 3, 85)
    assert sum(c != i for i, (_, c) in want.items()) >= 12
    assert near(docs(spark, rows), words=3, percent=85, **options) == want


def test_units_of_a_band_let_all_parts_meet(spark):
    rows = [(k, a, 7 if a < 30 else a) for k, n in ((1, 55), (2, 12), (3, 31)) for a in range(n)]
    out = near_dedup._units(spark.createDataFrame(rows, "_key long, _a long, _label long"), 10).collect()
    units = {}
    for r in out:
        units.setdefault((r._key, r._u, r._v), {})[r._a] = r._label
    assert max(map(len, units.values())) < 40 and len(out) == len({(r._key, r._u, r._v, r._a) for r in out})
    met = {(k, *sorted((a, b))) for (k, *_), g in units.items() for a in g for b in g if g[a] != g[b]}
    assert met == {(k, a, b) for k, a, x in rows for h, b, y in rows if k == h and a < b and x != y}


def test_parts_of_a_band_meet_past_its_least_node():
    rng = np.random.default_rng(0)
    regs = rng.integers(0, 60_000, (6, near_dedup.FUNCTIONS * near_dedup.BUCKETS)).astype(np.uint16)
    regs[4], regs[5, :150] = regs[2], regs[3, :150]
    nodes, sizes = np.arange(10, 16), np.array([500, 500, 500, 500, 500, 500])
    assert sorted(map(sorted, near_dedup._joined(nodes, nodes, sizes, regs, 85))) == [[12, 14], [13, 15]]
    assert near_dedup._joined(nodes, np.array([1, 2, 3, 4, 3, 4]), sizes, regs, 85) == []


def test_near_duplicates_of_odd_rows(odd, none):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[6].component_id == 6 and all(r.kept for r in out if r.doc_id == 6)
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (6000, 1000, 1000))
    made = []
    for own in (a, b):
        s = near_dedup.Sets.__new__(near_dedup.Sets)
        s.value = np.sort(np.concatenate([common, own]))
        s.doc, s.first = np.zeros(len(s.value), np.int64), np.array([0, len(s.value)])
        made.append(s.sketches())
    n = np.array([7000.0])
    assert near_dedup.estimate(made[0], made[1], n, n)[0] == pytest.approx(0.75, abs=0.1)


# 3

FAKE = "<pre>WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n</pre>"
PAGES = [
    (1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nWARC/1.0\r\n", FAKE), (4, "u", FAKE + "WARC/1.0\r\n"), (5, "u", None), (6, "u", ""),
    (None, "u", "x"), (None, None, "zz"), (8, "u", "WARC/1.0\r\nWARC/1.0\r\n\r\n\r\n"), (9, "u", "é" * 30_000),
]


@pytest.mark.parametrize("compression,split", [("gzip", "128m"), ("none", "128m"), ("none", "3k")])
def test_warc(spark, tmp_path, compression, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    warc.write_warc(df, str(tmp_path / "w"), compression=compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == len(PAGES)
    got = {r.record_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    for i in (3, 4, 8, 9):
        assert got[f"<urn:page:{i}>"] == PAGES[i - 1 if i < 5 else i][2]
    assert {r.refers_to for r in rows if r.record_id == "<urn:page:1>"} == {"<urn:page:2>"}


def test_warc_of_a_url_that_ends_in_a_version(spark):
    rows = [(i, "http://a/WARC/1.0" if i == 2 else f"http://a/{i}", f"page {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(r.page_id for r in warc.warc_round_trip(df).collect()) == list(range(6))
    with pytest.raises(ValueError):
        warc._chain(pd.DataFrame({"_file": "f", "_nr": [0, 1, 2], "_at": [0, 50, 90], "_next": [50, -1, 120]}))


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1))
    out = warc.warc_round_trip(df).collect()
    assert len(out) == len(PAGES)
    by = {r.page_id: r for r in out if r.page_id}
    assert (by[5].record_type, by[5].refers_to, by[5].payload_digest) == ("revisit", 6, "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ")
    assert by[1].payload_bytes == 1 and by[9].payload_bytes == 60_000
    assert warc.warc_round_trip(df.where("false")).count() == 0


# 4


@pytest.mark.parametrize("window,hot", [(8, 5000), (8, 3), (3, 10), (1, 5000)])
def test_passages(spark, window, hot):
    rows = list(enumerate(random_texts(150, 5))) + [(900, None), (901, ""), (902, " \n ")]
    rows.append((None, rows[3][1]))
    shuffled = random.Random(window).sample(rows, len(rows))
    out = substring_dedup.substring_dedup(docs(spark, shuffled), window=window, hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.passages(rows, window)


def test_passages_of_odd_rows(odd, none):
    out = substring_dedup.substring_dedup(odd, texts=True).collect()
    assert len(out) == len(ODD)
    assert next(r for r in out if r.doc_id == 5).n_removed == 4000 - 1
    assert substring_dedup.substring_dedup(none).count() == 0


def test_kept_text_keeps_its_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    out = substring_dedup.substring_dedup(docs(spark, [f"a\n{shared}", f"b\t c\n{shared}  d\n"]), texts=True).collect()
    assert {r.doc_id: r.kept_text for r in out} == {0: None, 1: "b\t c  d\n"}


def test_automaton_matches():
    rnd = random.Random(1)
    for _ in range(200):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 12))) for _ in range(4)]
        a, before = substring_dedup.SuffixAutomaton(), []
        for s in strings:
            for i, m in enumerate(a.matched(s)):
                seen = [*before, *[s[:j] for j in range(i + 1)]]
                best = max(k for k in range(i + 2) if k == 0 or any(x.endswith(s[i + 1 - k : i + 1]) for x in [p[:e] for p in seen for e in range(len(p) + 1)]))
                assert m == best
            before.append(s)


# 5


@pytest.fixture(scope="module")
def own():
    tiktoken = pytest.importorskip("tiktoken")
    coder = load(P.path("byte_bpe_50k.tiktoken"))
    return coder, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


HARD = ["a", "s", "t", "'", "’", "r", "e", "v", "l", " ", "  ", "\n", "\t", "1", "²", "é", "!", "中", "\x1c", "　", "d", "m", "S", "<|endoftext|>"]


def test_pieces():
    regex = pytest.importorskip("regex")
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    pieces, first = cut(texts)
    assert [pieces[a:b] for a, b in zip(first, first[1:])] == [regex.findall(P.PATTERN, t) for t in texts]


def test_transducer(own):
    coder, reference = own
    rnd = random.Random(2)
    raw = [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 40))) for _ in range(300)] + [b"a" * 300, b" " * 500, b"ab" * 150, "naïveté".encode()]
    assert [list(coder.encode(x)) for x in raw] == [reference._core_bpe.encode_single_piece(x) for x in raw]
    small = Transducer({bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258, b"aab": 259})
    for n in range(1, 9):
        for k in range(1 << n):
            x = bytes(97 + (k >> i & 1) for i in range(n))
            assert list(small.encode(x)) == small.merge(x)


def test_round_trip(spark, own, odd, none):
    coder, reference = own
    rows = bpe_round_trip(odd, P.path("byte_bpe_50k.tiktoken")).collect()
    want = sorted((r[0] or 0, len(ids := reference.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_streaming_decode_splits_characters(own):
    coder, reference = own
    text = "héllo 中文 🎉" * 50
    ids = reference.encode_ordinary(text)
    for chunk in (1, 2, 7):
        assert "".join(decode(ids, coder.vocab, chunk)) == text


# 6


def test_forward_backward():
    rng = np.random.default_rng(0)
    n = 3
    f = language_crf.Field(list("abc"), np.zeros((1, n)), rng.normal(size=(n, n)))
    first = np.concatenate([[0], np.cumsum([0, 1, 5, 70, 33, 32, 64, 65])])
    scores = rng.normal(size=(first[-1], n)) * 2
    post, joint = f.marginals(scores, first)
    move, want, pairs = np.exp(f.pairs), [], np.zeros((n, n))
    for a, b in zip(first, first[1:]):
        ahead, back = [np.ones(n) / n], [np.ones(n)]
        for t in range(a, b):
            v = (ahead[-1] @ move) * np.exp(scores[t])
            ahead.append(v / v.sum())
        for t in range(b - 1, a - 1, -1):
            v = move @ (np.exp(scores[t]) * back[0])
            back.insert(0, v / v.sum())
        for t in range(a, b):
            p = ahead[t - a + 1] * back[t - a + 1]
            want.append(p / p.sum())
            q = ahead[t - a][:, None] * move * (np.exp(scores[t]) * back[t - a + 1])
            pairs += q / q.sum()
    assert np.allclose(post, want) and np.allclose(joint, pairs)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(0)
    stock = {"en": "the and of that with which have this from other".split(), "fr": "les des une avec pour dans que est sont leur".split()}
    rows = [(i, " ".join(rnd.choice(stock[lang]) for _ in range(rnd.randint(3, 40))), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(labelled):
    out = language_crf.language_id(labelled).join(labelled, "doc_id").collect()
    assert len(out) == 120 and sum(r.held_out for r in out) > 5
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in out)
    field = language_crf.learn(labelled)
    mixed = labelled.sparkSession.createDataFrame([(1, "the and of that with les des une avec pour")], "doc_id long, text string")
    assert [(r["lang"], r["words"]) for r in language_crf.identify(mixed, field, spans=True).first()["word_langs"]] == [("en", 5), ("fr", 5)]


def test_language_of_odd_rows(odd, none):
    out = {r.doc_id: r for r in language_crf.language_id(odd).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 6)) and out[7].lang_pred in ("en", "fr", "de")
    assert language_crf.language_id(none).count() == 0
    assert {r.lang_pred for r in language_crf.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 7


def saved(df, path):
    df.write.parquet(str(path))
    return str(path)


@pytest.mark.parametrize("digits", [64, 1, 0])
def test_exact_dedup_checks_bytes_under_shared_digests(spark, tmp_path, digits):
    rows = list(enumerate(random_texts(120, 9, most=3))) + [(500, None), (501, "")]
    path = saved(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), tmp_path / "d")
    out = exact_dedup(spark, path, digest=lambda t: F.substring(F.sha2(t, 256), 1, digits), max_bytes_per_batch=2000).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out} == want


def test_state_keeps_the_locator_over_micro_batches(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    path = saved(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), tmp_path / "d")
    out = exact_dedup(spark, path, max_bytes_per_batch=1, locators=True).collect()
    place = {(r.f, r.n): (r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n")).collect()}
    assert len({f for f, _ in place}) > 1
    for r in out:
        assert r.group_size == 5 and place[r.keep_file, r.keep_row] == (r.keep_id, f"text {r.doc_id % 40}")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", None) is None


def test_exact_dedup_of_odd_rows(spark, odd, none, tmp_path):
    out = exact_dedup(spark, saved(odd, tmp_path / "o")).collect()
    assert len(out) == len(ODD)
    assert [(r.group_size, r.kept) for r in out if r.doc_id == 6] == [(2, True)] * 2
    assert exact_dedup(spark, saved(none, tmp_path / "n")).count() == 0


# 8


def test_lines(spark):
    rows = [(i, f"head\nown {i}\n\nfoot", f"s{i % 7}") for i in range(40)] + [(100, None, "s1"), (101, "own 3\nhead ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_cut", F.lit(1))
    out = {r.doc_id: (r.text, r.n_removed, r._cut) for r in line_dedup.line_dedup(df, counts=True).collect()}
    assert out[3] == ("own 3\n", 2, 1) and out[100] == (None, 0, 1) and out[101] == ("own 3", 1, 1)


@pytest.mark.parametrize("sites", [2, 3, 40])
def test_spread_near_the_threshold(spark, sites):
    rows = [(f"line {n}", f"s{j}") for n in range(1, 60) for j in range(n)]
    df = spark.createDataFrame(rows, "text string, source string")
    assert line_dedup.boilerplate(df, sites=sites).count() == 60 - sites


def test_lines_of_odd_rows(odd, none):
    out = line_dedup.line_dedup(odd, sites=2)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert line_dedup.line_dedup(none).count() == 0


def test_lines_of_a_long_text_in_proportion(spark):
    """Texts that are boilerplate throughout: eight times the lines take about eight times as long."""
    took = []
    for n in (5_000, 40_000):
        text = "\n".join(f"line {i}" for i in range(n))
        df = spark.createDataFrame([(i, text if i else text + "\nown", f"s{i}") for i in range(7)], "doc_id long, text string, source string").repartition(7)
        began = time.monotonic()
        out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(df, counts=True).collect()}
        took.append(time.monotonic() - began)
        assert out == {i: ("" if i else "own", n) for i in range(7)}
    assert took[1] < 8 * max(took[0], 3)


# 9


def test_fingerprints(spark, odd, none):
    texts = [" ".join(f"w{random.Random(i).randint(0, 10**6) + j * 7919 * (i + 1)}" for j in range(120)) for i in range(12)]
    rows = list(enumerate(texts)) + [(50, texts[0])]
    out = {r.doc_id: r for r in syncmers.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, reverse=True)
    for n, (i, t) in enumerate(ordered):
        m, following = len(t) // 3, ordered[(n + 1) % len(ordered)][1]
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()
        assert out[i].near_edited > 0.25 and out[i].n_chars == len(t)
    assert out[0].fingerprint == out[50].fingerprint
    assert syncmers.edited_likeness(odd).count() == len(ODD) and syncmers.edited_likeness(none).count() == 0


def test_anchors_are_closed_syncmers_and_free_of_context(spark):
    xxhash = pytest.importorskip("xxhash")
    rnd = random.Random(4)
    passage = [f"p{rnd.randint(0, 999)}" for _ in range(60)]
    text = " ".join([f"a{i}" for i in range(17)] + passage + [f"b{i}" for i in range(9)])

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def pair(a, b):
        return signed(xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)))

    w = text.encode().split()
    pairs = [pair(a, b) for a, b in zip(w, w[1:])]
    places = [i for i in range(len(pairs) - 3) if min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2])]
    df = spark.createDataFrame([(text,), (" ".join(passage),)], "text string")
    got = [r.a for r in df.select(syncmers.anchors(F.col("text"), 10_000).alias("a")).collect()]
    low = (1 << syncmers.PLACE_BITS) - 1
    assert sorted(x & low for x in got[0]) == places
    inner = {x >> syncmers.PLACE_BITS: x & low for x in got[1]}
    outer = {x >> syncmers.PLACE_BITS: x & low for x in got[0]}
    assert all(outer[h] == p + 17 for h, p in inner.items())
    both = df.agg(F.collect_list(syncmers.anchors(F.col("text"), 10_000)).alias("x")).select(syncmers.common_places(F.col("x")[0], F.col("x")[1]).alias("c")).first().c
    assert {p.a - p.b for p in both} == {17}


def test_fingerprints_keep_every_anchor(spark):
    own = lambda c, n: [f"{c}{i * i}" for i in range(n)]
    shared = own("s", 60)
    a, b = " ".join(own("a", 3000) + shared), " ".join(shared + own("b", 3000))
    df = spark.createDataFrame([(a, b, a.replace("a4000000 ", "changed "))], "a string, b string, c string")
    x, y, z = (syncmers.anchors(F.col(c)) for c in "abc")
    out = df.select(syncmers.common_places(x, y).alias("p"), syncmers.likeness(x, y).alias("n"), (x == z).alias("same"), F.size(x).alias("size")).first()
    assert len(out.p) > 10 and {p.a - p.b for p in out.p} == {3000}
    assert 0 < out.n < 0.05 and not out.same and out.size > 1000


def test_anchors_of_texts_without_spaces(spark):
    rnd = random.Random(5)
    run = lambda lo, n: "".join(chr(lo + rnd.randrange(2000)) for _ in range(n))
    for text in (run(0x4E00, 300), "".join(rnd.choice("abcdefghij") for _ in range(300)), "one two three"):
        edited = text[: len(text) * 2 // 3] + "x"
        df = spark.createDataFrame([(text, edited, f"ab cd {text} ef")], "a string, b string, c string")
        x, z = (syncmers.anchors(F.col(c)) for c in "ac")
        near = syncmers.likeness(*(syncmers.fingerprint(F.col(c)) for c in "ab"))
        out = df.select(near.alias("n"), syncmers.common_places(x, z).alias("p"), F.size(x).alias("size")).first()
        assert out.n > 0.2
        if len(text) == 300:
            assert out.size > 100 and {p.b - p.a for p in out.p} == {2} and len(out.p) > 90
    assert spark.createDataFrame([("a b",)], "a string").select(F.size(syncmers.fingerprint(F.col("a")))).first()[0] == 1


def test_short_texts_are_like_their_edited_form_and_unlike_others(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    for n in (4, 5, 6):
        rows = [(i, " ".join(word() for _ in range(n))) for i in range(60)]
        out = syncmers.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.fingerprint for r in out) and max(r.near_next for r in out) < 0.3
        near = sorted(r.near_edited for r in out)
        assert near[0] > 0 and 0.35 < near[len(near) // 2] < 0.65


@pytest.mark.parametrize("kind", ["long", "string", "date", "decimal(9,2)"])
def test_neighbours_over_many_windows(spark, monkeypatch, kind):
    monkeypatch.setattr(syncmers, "ROWS", 7)
    df = spark.range(0, 300, 3).select((F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)).alias("doc_id"))
    df = df.unionByName(df.where("false").unionByName(spark.range(2).select(F.lit(None).cast(kind).alias("doc_id"))))
    df = df.withColumn("text", F.concat(F.lit("t"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    ordered = [r.text for r in sorted((r for r in df.collect() if r.doc_id is not None), key=lambda r: r.doc_id, reverse=True)] + ["tnone"] * 2
    out = sorted((r.text, r.next_text) for r in syncmers.with_next(df, "doc_id", ["text"]).collect())
    assert out == sorted(zip(ordered, ordered[1:] + ordered[:1]))


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark):
    xxhash = pytest.importorskip("xxhash")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    chained = lambda *xs: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(x if isinstance(x, bytes) else struct.pack("<q", x), seed), xs, 42)

    def closed(pairs):
        every = [chained(pairs[i], pairs[i + 1], pairs[i + 3]) >> 24 for i in range(len(pairs) - 3)]
        return [h for i, h in enumerate(every) if min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2])], every

    def anchors(text):
        if len(text) < 5:
            return {chained(text.encode()) >> 24} if text else set()
        w = text.encode().split()
        out = set(closed([signed(chained(a, b)) for a, b in zip(w, w[1:])])[0])
        for part in (text[:32], text[-32:]):
            c = [x.encode() for x in part]
            found, every = closed([signed(chained(b"edge", a, b)) for a, b in zip(c, c[1:])])
            out |= set(found or ([min(every, key=lambda h: h - (h >> 39 << 40))] if part == text[:32] else []))
        return out

    rnd = random.Random(8)
    stock = [" ".join(f"q{rnd.randint(0, 300)}" for _ in range(rnd.randint(20, 90))) for _ in range(25)]
    rows = [(i, rnd.choice(stock) + " " + rnd.choice(stock)) for i in range(40)]
    rows += [(100 + 20 * n + i, " ".join(rnd.choice(stock).split()[:n])) for n in range(1, 13) for i in range(8)]
    rows += [(900 + n, "x" * n) for n in range(9)] + [(950, " " * 9), (951, "ab ab ab ab ab ab")]
    ordered = sorted(rows, reverse=True)
    out = {r.doc_id: r for r in syncmers.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, (i, t) in enumerate(ordered):
        following, m = ordered[(n + 1) % len(ordered)][1], len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        own = anchors(t)
        assert {int(x.split(":")[0], 16) for x in out[i].fingerprint.split(",") if x} == own and bool(own) == bool(t)
        assert out[i].near_edited == pytest.approx(plain_likeness(own, anchors(edited)))
        assert out[i].near_next == pytest.approx(plain_likeness(own, anchors(following)))


# 10


def test_plan_is_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        total, size = int(rng.integers(1, 60)), 16
        cuts = np.unique(np.r_[0, total, rng.integers(1, total + 1, 8), np.arange(0, total, 8)])
        price = rng.integers(0, 10, len(cuts)).astype(float)
        got = packing.plan(cuts, price, size)
        cost = [0.0] + [np.inf] * (len(cuts) - 1)
        for i in range(1, len(cuts)):
            cost[i] = price[i] + min(cost[j] + size - cuts[i] + cuts[j] for j in range(i) if cuts[i] - cuts[j] <= size)
        assert sum(size - cuts[b] + cuts[a] + price[b] for a, b in zip(got, got[1:])) == pytest.approx(cost[-1])


@pytest.mark.parametrize("block,special_as_text", [(packing.BLOCK, False), (3000, False), (3000, True)])
def test_packing(spark, odd, none, block, special_as_text):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = special_as_text
    texts = random_texts(60, 2, ["The cat. ", "sat", "on\n", "mats!", "<|endoftext|>", "<|endoftext|", "été"], 300) + ["a <|endoftext|> b", "<|endoftext|>"]
    for df, rows in ((docs(spark, texts), list(enumerate(texts))), (odd.where("doc_id <> 6 AND doc_id IS NOT NULL"), [r[:2] for r in ODD if r[0] not in (6, None)])):
        df = df.coalesce(2)
        out = packing.pack(df, P.path("byte_bpe_50k.json"), block=block, special_as_text=special_as_text).toPandas()
        want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
        assert special_as_text or df.count() < 20 or want[60][2] == 50256
        for i, g in out.sort_values("start").groupby("doc_id"):
            assert [x for ids in g["token_ids"] for x in ids] == want[i]
            assert (g["start"] == (g["length"].cumsum() - g["length"])).all() and (g["doc_tokens"] == len(want[i])).all()
            assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(g["token_ids"], g["ids_crc32"]))
        assert set(out["doc_id"]) == set(want)
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert (g["offset"] == (g["length"].cumsum() - g["length"])).all() and g["length"].sum() <= 1024
        assert out["sequence_id"].nunique() <= sum(map(len, want.values())) / 1024 * 1.1 + 2
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(odd, P.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == 8


def test_long_words_built_alike_have_hashes_of_their_own(spark):
    word, swap = "a", str.maketrans("ab", "ba")
    for _ in range(10):
        word += word.translate(swap)
    common = [f"c{i}" for i in range(25)]
    rows = [(1, " ".join([*common[:12], word, *common[12:]])), (2, " ".join([*common[:12], word.translate(swap), *common[12:]]))]
    out = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.passages(rows, 20)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 7, 20])
def test_grams_part_what_differs(k):
    from gyre.llm.text import Words, grams, text_buffers

    rnd = random.Random(k)
    texts = [[f"x{rnd.randint(0, 2)}" for _ in range(n)] for n in (300, 0, 5, 300)]
    w = Words(*text_buffers(pa.array([" ".join(t) for t in texts])))
    value, at = grams(w.hashes(), w.doc, k)
    flat = [x for t in texts for x in t]
    seen = {}
    for h, i in zip(value.tolist(), at.tolist()):
        assert seen.setdefault(h, flat[i : i + k]) == flat[i : i + k]
    assert len(at) == sum(max(len(t) - k + 1, 0) for t in texts) and len(seen) == len({tuple(flat[i : i + k]) for i in at})


def test_words_and_slices():
    from gyre.llm.text import Words, slices, text_buffers

    data, off = text_buffers(pa.array(["a b  c", "", "  ", "x", None, "é a\x0bb "]))
    w = Words(data, off)
    assert w.first.tolist() == [0, 3, 3, 3, 4, 4, 7] and [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "b", "c", "x", "é", "a", "b"]
    assert list(slices(np.array([0, 5, 100, 101, 102]), 10)) == [(0, 1), (1, 2), (2, 4)]
