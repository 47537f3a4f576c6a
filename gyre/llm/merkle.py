"""A Merkle manifest of a dataset: one tree of digests a group, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each with its length. Within a group, leaves ascend by identifier, and every
eight consecutive nodes become their digest until one is left; the groups' roots, ordered by group, likewise.

Blocks of ``FAN ** LEVELS`` consecutive nodes are reduced to one node each by Spark, again and again until no more than
``TOP`` nodes are left. These the driver builds into the top tree, and broadcasts for each node what stands beside it on
the way to the root. Executors then go down again: a block takes the path of its own node, puts those of its inner levels
before it, and at the leaves finishes the proofs and folds. Nodes are placed by ranks over ranges of identifiers, so a
group that holds most of the rows is many blocks like any other.

Cases: any field may be null, and has a mark of its own; null groups are one group, the first; rows that repeat an
identifier, or have none (the first of their group), are ordered by their leaves; a group of one row has its leaf as root,
and a single group's root is the root; without siblings the proof is the digest of nothing; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.session import shipped, written
from gyre.operators.ranks import ranked

#: Nodes of a run, levels of a block, and nodes that the driver builds the top tree from: with their paths, some 10 MB.
FAN, LEVELS, TOP = 8, 4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands before and after a node within its run, level by level.
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: each its UTF-8 length and value, or a dash where it is null."""
    one = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*one), 256)


def levels_above(n: int) -> int:
    """Levels from ``n`` nodes up to the one that is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def pyramid(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def path_of(place: int, levels: list[list[str]]) -> list[tuple[str, str]]:
    """What stands left and right of a node within its run, on each level below the last."""
    out = []
    for nodes in levels[:-1]:
        at, k = place - place % FAN, place % FAN
        out.append(("".join(nodes[at : at + k]), "".join(nodes[at + k + 1 : at + FAN])))
        place //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and the siblings on its path give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def proof_digest(path: list[tuple[str, str]]) -> str:
    return digest("".join(left + right for left, right in path))


def _block_levels(n: int, levels: int) -> int:
    """Levels of a block in a group of ``n`` nodes: all up to the group's root where the block is the only one."""
    return levels if n > FAN**levels else levels_above(n)


_NODE = "_g string, _i bigint, _n bigint, _h string"


def _block(levels: int) -> Column:
    return F.floor(F.col("_i") / FAN**levels).alias("_b")


def _lift(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes that blocks of ``nodes`` become."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n, at = int(pdf["_n"].iloc[0]), int(pdf["_i"].iloc[0]) // FAN**levels
        root = pyramid(pdf["_h"].tolist(), _block_levels(n, levels))[-1][0]
        left = -(-n // FAN**levels)
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1], "_i": at, "_n": left, "_h": root})

    return written(nodes.select("_g", "_i", "_n", "_h").groupBy("_g", _block(levels)).applyInPandas(reduce, _NODE), "merkle-blocks")


def _top(nodes: list, grouped: bool) -> dict[tuple[str, int], tuple[str | None, str, list]]:
    """Of each of the last nodes its group's root (if they are of several groups), the root, and its path."""
    trees: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r["_g"].encode(), r["_i"])):
        trees.setdefault(r["_g"], []).append(r["_h"])
    if not trees:
        return {}
    built = {g: pyramid(h, levels_above(len(h))) for g, h in trees.items()}
    over = pyramid([p[-1][0] for p in built.values()], levels_above(len(built)))
    root = over[-1][0]
    out = {}
    for k, (g, p) in enumerate(built.items()):
        above = path_of(k, over)
        out |= {(g, i): (p[-1][0] if grouped else None, root, path_of(i, p) + above) for i in range(len(p[0]))}
    return out


def merkle_manifest(
    df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, paths: bool = False,
    levels: int = LEVELS, top: int = TOP,
) -> DataFrame:
    """Leaf, roots and proof of each row.

    Columns: id, leaf, subroot, root, proof_sha256 (of the siblings on the way, level by level), folded_root and
    verified. ``changed`` is the leaf of a row as it is now, or null where it has not changed; folded with the
    siblings of the manifest it gives the folded root, which equals the root if nothing has changed. ``paths`` adds
    the siblings themselves (left and right of the node, level by level). ``levels`` are those of a block, and ``top``
    nodes at most go to the driver; neither changes the result.
    """
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("_g"), F.col(id_col).alias("_id"),
        leaf([F.col(f) for f in fields]).alias("_h"), (F.lit(None).cast("string") if changed is None else changed).alias("_now"),
    )
    # Written before it is dealt by ranges, which reads it twice.
    leaves = ranked(written(shipped(rows), "merkle-leaves"), ["_id", "_h"], ["_g"], "_i", "_n")
    stack, nodes, grouped = [], leaves, True
    while True:
        n, most = nodes.agg(F.count(F.lit(1)), F.max("_n")).first()
        if n <= top:
            break
        if grouped and most == 1:  # too many groups for the driver: their roots become the nodes of one tree
            named = nodes.drop("_i", "_n").withColumns({"_of": F.col("_g"), "_g": F.lit("")})
            nodes, grouped = ranked(named, ["_of"], ["_g"], "_i", "_n"), False
            continue
        stack.append(nodes)
        nodes = _lift(nodes, levels)
    kind = df.schema[id_col].dataType.simpleString()
    extra = f", path {_PATH}" if paths else ""
    schema = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string{extra}"
    above = df.sparkSession.sparkContext.broadcast(_top(nodes.collect(), grouped))
    out = _down(stack, nodes, above, schema, id_col, paths, levels)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _listed(path: list[tuple[str, str]]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in path]


def _down(stack: list[DataFrame], nodes: DataFrame, above, schema: str, id_col: str, paths: bool, levels: int) -> DataFrame:
    """Carry the paths of the last ``nodes`` (``above``, by group and place) down the ``stack`` to the leaves."""

    def finished(pdf: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
        """Rows of the result, from leaves and each one's (subroot, root, path)."""
        now = [h if t is None or t != t else t for h, t in zip(pdf["_h"], pdf["_now"])]
        columns = {
            id_col: pdf["_id"].to_numpy(), "leaf": pdf["_h"].to_numpy(), "subroot": [f[0] for f in found], "root": [f[1] for f in found],
            "proof_sha256": [proof_digest(f[2]) for f in found], "folded_root": [fold(h, f[2]) for h, f in zip(now, found)],
        }
        if paths:
            columns["path"] = [_listed(f[2]) for f in found]
        return pd.DataFrame(columns)

    def carried(pdf: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
        """Rows that the level below looks its blocks up in."""
        g, i = (pdf["_of"].to_numpy(), 0) if "_of" in pdf else (pdf["_g"].to_numpy(), pdf["_i"].to_numpy())
        return pd.DataFrame({"_g": g, "_i": i, "_sub": [f[0] for f in found], "_root": [f[1] for f in found], "_path": [_listed(f[2]) for f in found]})

    def within(pdf: pd.DataFrame, upper: tuple) -> list[tuple]:
        """(subroot, root, path) of a block's nodes, which are in order, from those of the block."""
        h = pdf["_h"].tolist()
        inner = pyramid(h, _block_levels(int(pdf["_n"].iloc[0]), levels))
        sub = h if "_of" in pdf else [upper[0]] * len(h)
        return [(sub[i], upper[1], path_of(i, inner) + upper[2]) for i in range(len(h))]

    def from_top(batches):
        for pdf in batches:
            found = [above.value[g, i] for g, i in zip(pdf["_g"], pdf["_i"].tolist())]
            yield finished(pdf, [(f[0] or h, f[1], f[2]) for f, h in zip(found, pdf["_h"])])

    def under_top(make):
        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i", ignore_index=True)
            return make(pdf, within(pdf, above.value[pdf["_g"].iloc[0], int(pdf["_i"].iloc[0]) // FAN**levels]))

        return block

    def under(make):
        def block(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            pdf, one = pdf.sort_values("_i", ignore_index=True), up.iloc[0]
            return make(pdf, within(pdf, (one["_sub"], one["_root"], [(p["left"], p["right"]) for p in one["_path"]])))

        return block

    if not stack:  # no more leaves than the driver takes
        return nodes.mapInPandas(from_top, schema)
    known, carried_schema = None, f"_g string, _i bigint, _sub string, _root string, _path {_PATH}"
    for depth in range(len(stack) - 1, -1, -1):
        make, kind = (finished, schema) if depth == 0 else (carried, carried_schema)
        blocks = stack[depth].groupBy("_g", _block(levels))
        if known is None:
            known = blocks.applyInPandas(under_top(make), kind)
        else:
            known = blocks.cogroup(known.groupBy("_g", F.col("_i").alias("_b"))).applyInPandas(under(make), kind)
        if depth:
            known = written(known, "merkle-paths")
    return known
