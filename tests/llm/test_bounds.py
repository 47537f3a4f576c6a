"""Limits of shards, micro-batches and slots."""

from collections import defaultdict

import public_tokenizers
import pytest

from gyre.llm import exact_dedup, packing, sharding


def test_a_shard_needs_room(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for limit in (0, -5):
        with pytest.raises(ValueError, match="at least one byte"):
            sharding.extendible_shards(df, limit=limit)


def test_copies_across_micro_batches(spark, tmp_path, monkeypatch):
    """By default a batch has an eighth of the files; copies in different batches meet in the state."""
    rows = [(i, f"text {i % 7}" if i % 5 else None) for i in range(60)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    monkeypatch.setattr(exact_dedup, "BATCH_BYTES", (1, 1 << 40))
    places, shared_dir = [], exact_dedup.shared_dir
    monkeypatch.setattr(exact_dedup, "shared_dir", lambda *a: places.append(shared_dir(*a)) or places[-1])
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert out == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    batches = spark.read.parquet(f"{places[0]}/updates").select("batch").distinct().count()
    assert batches > 3


@pytest.mark.parametrize("most", [3, 1000])
def test_pieces_take_slots_and_give_them_back(monkeypatch, most):
    """A piece is encoded once while it has a slot; full slots are emptied and results stay the same."""
    monkeypatch.setattr(packing, "MEMO_PIECES", most)
    asked = []
    slots = packing.Slots(lambda p: asked.append(p) or [len(p)] * (len(p) % 3))
    for pieces in (["a", "bb", "ccc", "a"], [], ["bb", "dddd", "bb"], ["ccc", "ccc", "a"]):
        ids, counts = slots.tokens(pieces)
        assert counts.tolist() == [len(p) % 3 for p in pieces]
        assert ids.tolist() == [len(p) for p in pieces for _ in range(len(p) % 3)]
    assert asked == (["a", "bb", "ccc", "dddd"] if most > 3 else ["a", "bb", "ccc", "bb", "dddd", "ccc", "a"])


def test_cuts_inside_wide_gaps():
    cuts, penalty = packing.candidates(200, packing.np.array([32, 97, 200]), packing.np.array([10, 97]))
    assert cuts.tolist() == [0, 10, 32, 64, 96, 97, 129, 161, 193, 200]
    assert penalty.tolist() == [0, packing.SENTENCE, 0, *[packing.INSIDE] * 2, 0, *[packing.INSIDE] * 3, 0]


def test_long_texts_go_through_the_slots_in_runs(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "MEMO_PIECES", 7)
    texts = ["One two, three 'tis 4567 xyzzyq\n\n  two " * 5, "", "été <|endoftext|> two", "x"]
    library, code = tokenizers.Tokenizer.from_file(path), packing.Coder(path)
    assert [x.tolist() for x in code.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(code.memo) <= 2 * 7
