"""The Merkle manifest against a plain version that follows each row to the root."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from gyre.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _g string, _h int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    fields = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def up(nodes):
    """Levels of a tree, and each node's siblings on the way."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            siblings[k].append((run[: i % 8], run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], siblings


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = up([leaf(r, r[1]) for r in groups[g]])
    root, above = up([trees[g][0] for g in order])
    out = []
    for g, over in zip(order, above):
        for r, own in zip(groups[g], trees[g][1]):
            path = own + over
            bent = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if bent else r[1])
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaf(r, r[1]), trees[g][0], root, proof, h, h == root))
    return sorted(out, key=repr)


def of(df, **options):
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = merkle.leaf([small if f == "text" else F.col(f) for f in merkle.FIELDS])
    out = merkle.merkle_manifest(df, changed=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, now), **options)
    return sorted(map(tuple, out.collect()), key=repr)


def documents(n, langs):
    rows = [(i, f"Text Ä {i}", langs[i % len(langs)] if i % 3 else langs[0], "s", i) for i in range(n)]
    odd = [(None, "No Name", "en", None, None), (None, None, "en", None, None), (7, "Again", "en", "s", 1), (7, "Again", "en", "s", 1), (8, "", None, "", 0), (9, "Long " * 20_000, "Zz", "s", 0)]
    return [(*r, "x", 1, "g", 2) for r in rows + odd]


@pytest.mark.parametrize("levels, top, n, langs", [
    (4, 4096, 300, ["en", "fr", None]),  # all in the driver
    (1, 20, 300, ["en", "fr", None, "é"]),  # several rounds of blocks
    (2, 30, 150, ["en"]),
    (1, 12, 90, ["en", *(f"l{i}" for i in range(40))]),  # more groups than the driver takes
    (1, 4, 0, ["en"]),
])
def test_against_plain(spark, levels, top, n, langs):
    rows = documents(n, langs)
    df = spark.createDataFrame(rows, SCHEMA)
    assert of(df, levels=levels, top=top) == plain(rows)


def test_groups_of_one_row(spark):
    rows = [(i, f"T{i}", f"g{i}", None, i, "", 0, "", 0) for i in range(70)]
    assert of(spark.createDataFrame(rows, SCHEMA), levels=1, top=5) == plain(rows)


def test_one_row_and_none(spark):
    one = [(3, None, None, None, None, "", 0, "", 0)]
    assert of(spark.createDataFrame(one, SCHEMA)) == plain(one)
    assert of(spark.createDataFrame([], SCHEMA)) == []


def test_paths_prove_rows(spark):
    df = spark.createDataFrame(documents(200, ["en", "fr"]), SCHEMA)
    for r in merkle.merkle_manifest(df, levels=1, top=10, paths=True).collect():
        path = [(p["left"], p["right"]) for p in r["path"]]
        assert merkle.fold(r.leaf, path) == r.root == r.folded_root and r.verified and merkle.proof_digest(path) == r.proof_sha256
        assert merkle.fold(merkle.digest("other"), path) != r.root
