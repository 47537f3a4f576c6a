"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set is that of the hashes of its shingles of words. Equal sets are one node from the start, so
that copies cost nothing further. A sketch has ``FUNCTIONS`` times 64 registers: of the shingles that a
function deals to a bucket, the one of least value, kept as its number of leading zeros and ten mantissa
bits. Registers are banded; in a band an empty register takes the place and value of a filled one of its
function, so that few shingles fill a band as many do and one frequent shingle does not make it. Nodes that
share a band are compared by the Jaccard estimate of their registers, corrected for chance collisions: first
with the least node of that band, then, where that leaves a band in parts, with each other until every two
nodes of different parts have been compared. Pairs whose estimate is far too low drop out; what remains
connects nodes into coarse components, within which every link is decided on full sets. Nodes of one
component are compared only until they are connected.

Two nodes at the threshold share a band but for a chance of 1e-9 (at 0.85), and have some ten bands in common.
Any band that they share connects them, unless the estimate of the two themselves is ``SLACK`` too low.

A band with many nodes is dealt to units of two blocks, such that every two nodes of different parts meet in one;
no task holds a whole band. A coarse component with many shingles is dealt to blocks as well. Blocks are solved
alone, and then those nodes that are not in a component's largest part so far are compared with all its nodes, in
units of ``PIVOTS`` nodes and a block, four times as many in each round, until none is left: every pair of nodes
from different parts has then been decided.

Cases: documents without words have an empty set and are linked with nothing; fewer words than a shingle has
are one shingle; a null identifier comes after all others; rows that repeat an identifier are documents of
their own but share ``kept``; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.llm.components import components
from gyre.llm.session import shipped, written
from gyre.llm.text import Words, grams, mix, slices, text_buffers

FUNCTIONS, BUCKET_BITS, MANTISSA = 3, 6, 10
BUCKETS = 1 << BUCKET_BITS
BAND = 5
EMPTY = 0xFFFF
#: How far below the threshold an estimate may lie before its pair drops out: ten standard errors.
SLACK = 0.30
#: Shingles and nodes of one block, and nodes compared with it at a time.
BLOCK, NODES, PIVOTS = 1_000_000, 4096, 256
#: For each register the order in which, where it is empty, the others of its function are asked.
_ORDER = np.stack([np.random.default_rng(i).permutation(BUCKETS) for i in range(BUCKETS)], 1)
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


class Sets:
    """The distinct shingle hashes of some texts, sorted within each: ``value``, ``doc``, and ``first``, n + 1 values."""

    def __init__(self, words: Words, k: int):
        hashes = words.hashes()
        count = np.diff(words.first)
        value, at = grams(hashes, words.doc, k)
        parts, docs = [value], [words.doc[at]]
        for short in range(1, k):
            value, at = grams(hashes, words.doc, short)
            at_doc = words.doc[at]
            one = count[at_doc] == short
            parts.append(value[one])
            docs.append(at_doc[one])
        value, doc = np.concatenate(parts), np.concatenate(docs)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.value, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(count) + 1))

    def sketches(self) -> np.ndarray:
        """Registers of each text, ``FUNCTIONS * BUCKETS`` of 16 bits."""
        n = len(self.first) - 1
        out = np.full((n, FUNCTIONS * BUCKETS), EMPTY, np.uint16)
        for f in range(FUNCTIONS):
            h = mix(self.value ^ _SALT[f])
            order = np.lexsort((h, self.doc))
            h, doc = h[order], self.doc[order]
            bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            place = doc * BUCKETS + bucket
            least = np.ones(len(h), bool)
            least[1:] = place[1:] != place[:-1]
            rest = (h[least] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64)
            mantissa, exponent = np.frexp(np.maximum(rest, 1))
            register = (exponent << MANTISSA) | ((mantissa - 0.5) * (2 << MANTISSA)).astype(np.int64)
            out[doc[least], f * BUCKETS + bucket[least]] = register
        return out

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit values of each set, equal for equal sets."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.value ^ _SALT[1]))])
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.value * np.uint64(3) + _SALT[2]))])
        a, b = self.first[:-1], self.first[1:]
        return mix(total[b] - total[a]), mix(other[b] - other[a])


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers with set sizes, less the collisions expected by chance."""
    filled = (x != EMPTY) | (y != EMPTY)
    equal = ((x == y) & filled).sum(1)
    n, m = np.maximum(nx, ny), np.minimum(nx, ny)
    # Fixed value: the constant of the published approximation for unequal sets.
    by_chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * (4 * n / m) / (1 + n / m) ** 2 * FUNCTIONS
    return np.maximum(equal - by_chance, 0) / np.maximum(filled.sum(1), 1)


def _read(batch, column: int, lower: bool):
    data, off = text_buffers(batch.column(column))
    for lo, hi in slices(off):
        yield lo, hi, Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)


def _sketch(k: int, lower: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, words in _read(batch, 1, lower):
                sets = Sets(words, k)
                a, b = sets.sums()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(sets.first)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array([r.tobytes() for r in sets.sketches()], pa.binary())],
                    names=["_id", "_h", "_n", "_a", "_b", "_regs"],
                )

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, FUNCTIONS * BUCKETS)


def _filled(regs: np.ndarray) -> np.ndarray:
    """Registers of one function with their places; an empty one repeats the first filled one in its order."""
    full = regs != EMPTY
    out = regs.astype(np.uint64) | (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(16))
    rows = np.flatnonzero(full.any(1) & ~full.all(1))
    value, known, todo = out[rows], full[rows], ~full[rows]
    for order in _ORDER:
        if not todo.any():
            break
        now = todo & known[:, order]
        value = np.where(now, out[rows][:, order], value)
        todo &= ~now
    out[rows] = value
    return out


def _bands(batches):
    """Keys of the bands of each node."""
    per = BUCKETS // BAND
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _registers(batch.column(1))
        a = np.array(batch.column(0).to_numpy())
        keys, nodes = [], []
        for f in range(FUNCTIONS):
            own = _filled(regs[:, f * BUCKETS : (f + 1) * BUCKETS])
            for i in range(per):
                h = np.full(len(own), np.uint64(f * per + i))
                for j in range(BAND):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, i * BAND + j])
                keys.append(h)
                nodes.append(a)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["_key", "_a"])


def _alike(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(i).to_numpy().astype(float) for i in (2, 3)]
                near = estimate(_registers(batch.column(4)), _registers(batch.column(5)), *sizes) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_x", "_y"]).filter(pa.array(near))

    return run


def _joined(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of one band's nodes that connect its parts, after a look at all pairs of different parts whose sizes allow a link."""
    label = np.unique(labels, return_inverse=True)[1]
    # The largest part comes last: with all others compared to it, its own nodes have nothing left to meet.
    count = np.bincount(label)
    order = np.lexsort((label, count[label]))
    nodes, label, sizes, regs = nodes[order], label[order], sizes[order], regs[order]
    out = []
    for i in range(len(nodes) - count.max()):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        other = other[100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i])]
        if len(other):
            near = estimate(regs[other], regs[i : i + 1], sizes[other].astype(float), sizes[i].astype(float)) >= percent / 100 - SLACK
            for part in np.unique(label[other[near]]):
                out.append((nodes[i], nodes[other[near & (label[other] == part)][0]]))
                label[label == part] = label[i]
    return out


def _compare(percent: int):
    """Pairs that connect the parts of each unit of a band, from nodes sorted by unit."""

    def run(batches):
        key, group, out = None, [], []

        def done():
            nodes, labels, sizes = (np.array(x, np.int64) for x in list(zip(*group))[:3])
            regs = np.frombuffer(b"".join([x[3] for x in group]), np.uint16).reshape(len(group), -1)
            return _joined(nodes, labels, sizes, regs, percent)

        for batch in batches:
            for k, u, v, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (k, u, v) != key:
                    out += done() if group else []
                    key, group = (k, u, v), []
                group.append(row)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out + (done() if group else []))

    return run


def _members(k: int, lower: bool):
    """Full sets of the nodes of coarse components."""

    def run(batches):
        for batch in batches:
            for lo, hi, words in _read(batch, 0, lower):
                sets = Sets(words, k)
                raw, first = sets.value.tobytes(), (8 * sets.first).tolist()
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array([raw[x:y] for x, y in zip(first, first[1:])], pa.binary())], names=["_comp", "_part", "_a", "_set"]
                )

    return run


def linked(sets: list[np.ndarray], percent: int, pivots: list[int] | None = None) -> list[int]:
    """The least index that each set reaches over links of ``percent`` or more, of all pairs or of pairs with pivots."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])
    for i in range(n) if pivots is None else pivots:
        other = label != label[i]
        if pivots is None:
            other[:i] = False
        other &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (size > 0)
        index = np.flatnonzero(other)
        if not len(index) or not size[i]:
            continue
        pick = np.repeat(first[index] - np.concatenate([[0], np.cumsum(size[index])[:-1]]), size[index]) + np.arange(size[index].sum())
        values = flat[pick]
        at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
        common = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.concatenate([[0], np.cumsum(size[index])[:-1]]))
        union = size[index] + size[i] - common
        hit = index[100 * common >= percent * union]
        if len(hit):
            merged = np.isin(label, np.append(label[hit], label[i]))
            label[merged] = label[merged].min()
    return label.tolist()


def _solve(percent: int):
    """Parts of the blocks, from nodes sorted by block; with pivots (flag set) only their links count."""

    def run(batches):
        key, group = None, {}

        def done():
            nodes = list(group)
            sets = [np.frombuffer(s, np.uint64) for s, _ in group.values()]
            pivots = [i for i, (_, p) in enumerate(group.values()) if p]
            return [(nodes[j], nodes[i]) for i, j in enumerate(linked(sets, percent, pivots or None)) if i != j]

        out = []
        for batch in batches:
            for comp, part, a, s, pivot in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (comp, part) != key:
                    out += done() if group else []
                    key, group = (comp, part), {}
                if pivot or a not in group:
                    group[a] = (s, pivot)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out + (done() if group else []))

    return run


def _pairs(rows) -> pa.RecordBatch:
    x, y = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["_x", "_y"])


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, lower: bool = True, block: int = BLOCK, nodes: int = NODES, pivots: int = PIVOTS
) -> DataFrame:
    """One row per row: id, n_shingles, component_id (the least identifier reachable over links), kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = shipped(df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h")))
    sketches = written(docs.mapInArrow(_sketch(words, lower), f"_id {kind}, _h bigint, _n bigint, _a bigint, _b bigint, _regs binary"), "near-sketches")
    classes = sketches.where("_n > 0").groupBy("_a", "_b", "_n").agg(F.min("_id").alias("_min"))
    # One row stands for a class: that of its least identifier, of equal ones that of the least hash.
    standing = (
        sketches.where("_n > 0")
        .join(classes.withColumnRenamed("_n", "_m"), ["_a", "_b"])
        .where(F.col("_n") == F.col("_m"))
        .where(F.col("_id").eqNullSafe(F.col("_min")))
        .groupBy("_a", "_b", "_n", "_min")
        .agg(F.min("_h").alias("_h"), F.first("_regs").alias("_regs"))
    )
    standing = written(standing, "near-nodes")
    links = _links(docs, standing, kind, words, percent, lower, block, nodes, pivots)
    found = components(links)
    named = standing.select("_a", "_b", "_min").join(found, F.col("_a") == F.col("_node"))
    least = named.groupBy("_comp").agg(F.min("_min").alias("_least"))
    final = named.join(least, "_comp").select(F.col("_a"), F.col("_b"), "_least")
    rows = sketches.select("_id", "_n", "_a", "_b").join(classes.select("_a", "_b", "_min"), ["_a", "_b"], "left").join(final, ["_a", "_b"], "left")
    component = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.coalesce("_least", "_min"))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _links(docs: DataFrame, standing: DataFrame, kind: str, words: int, percent: int, lower: bool, block: int, nodes_of_block: int, pivots: int) -> DataFrame:
    """Exact links that connect the components: _x, _y."""
    spark = docs.sparkSession
    bands = standing.select("_a", "_regs").mapInArrow(_bands, "_key bigint, _a bigint")
    lead = bands.groupBy("_key").agg(F.count(F.lit(1)).alias("_c"), F.min("_a").alias("_lead")).where("_c > 1").select("_key", "_lead")
    shared = written(bands.join(lead, "_key"), "near-bands")
    pairs = shared.where("_a <> _lead").select("_lead", "_a").distinct()
    regs = standing.select("_a", "_n", "_regs")
    sided = (
        pairs.join(regs.withColumnsRenamed({"_a": "_lead", "_n": "_n1", "_regs": "_r1"}), "_lead")
        .join(regs.withColumnsRenamed({"_n": "_n2", "_regs": "_r2"}), "_a")
        .select("_lead", "_a", "_n1", "_n2", "_r1", "_r2")
    )
    close = written(sided.mapInArrow(_alike(percent / 100 - SLACK), "_x bigint, _y bigint"), "near-close")
    coarse = components(close)
    # Bands whose nodes are not all connected yet; of bands with the same nodes one.
    parted = shared.join(coarse, F.col("_a") == F.col("_node"), "left").select("_key", "_a", F.coalesce("_comp", "_a").alias("_label"))
    nodes = [F.bit_xor(F.xxhash64("_a")), F.bit_xor(F.xxhash64("_a", F.lit(1))), F.count(F.lit(1))]
    still = parted.groupBy("_key").agg(*[x.alias(f"_s{i}") for i, x in enumerate(nodes)], (F.min("_label") < F.max("_label")).alias("_open")).where("_open")
    still = still.groupBy("_s0", "_s1", "_s2").agg(F.min("_key").alias("_key")).select("_key")
    still = written(parted.join(still, "_key"), "near-open")
    if not still.isEmpty():
        met = (
            _units(still, nodes_of_block)
            .join(regs, "_a")
            .select("_key", "_u", "_v", "_a", "_label", "_n", "_regs")
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key", "_u", "_v")
            .sortWithinPartitions("_key", "_u", "_v", "_a")
            .mapInArrow(_compare(percent), "_x bigint, _y bigint")
        )
        met = written(met, "near-met")
        # Each node's link to its component stands for the close pairs.
        coarse = components(met.unionByName(coarse.select(F.col("_node").alias("_x"), F.col("_comp").alias("_y")))) if not met.isEmpty() else coarse
    inside = standing.join(coarse, F.col("_a") == F.col("_node")).select("_a", "_n", F.col("_min").alias("_i"), F.col("_h").alias("_g"), "_comp")
    parts = inside.groupBy("_comp").agg(F.greatest(F.ceil(F.sum("_n") / block), F.ceil(F.count(F.lit(1)) / nodes_of_block)).alias("_parts"))
    inside = inside.join(parts, "_comp").withColumn("_part", F.pmod(F.col("_a"), F.col("_parts")))
    chosen = docs.join(inside, docs["_id"].eqNullSafe(inside["_i"]) & (docs["_h"] == inside["_g"]))
    members = chosen.select("_text", "_comp", "_part", "_a").mapInArrow(_members(words, lower), "_comp bigint, _part bigint, _a bigint, _set binary")
    members = written(members, "near-members")
    solve = lambda rows: (
        rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_comp", "_part")
        .sortWithinPartitions("_comp", "_part", F.col("_pivot").desc(), "_a")
        .mapInArrow(_solve(percent), "_x bigint, _y bigint")
    )
    links = written(solve(members.withColumn("_pivot", F.lit(False))), "near-links")
    large = written(inside.where("_parts > 1").select("_comp", "_parts", "_part", "_a"), "near-large")
    used, most = None, pivots
    while not large.isEmpty():
        # Nodes outside of their component's largest part so far, and one inside it for each block at first.
        label = _labelled(large, links)
        sizes = label.groupBy("_comp", "_label").agg(F.count(F.lit(1)).alias("_c"))
        top = sizes.groupBy("_comp").agg(F.max(F.struct("_c", "_label")).alias("_top")).select("_comp", F.col("_top._label").alias("_main"))
        label = label.join(top, "_comp")
        if used is None:
            centre = label.groupBy("_comp", "_part", "_label").agg(F.min("_a").alias("_a"), F.count(F.lit(1)).alias("_c"))
            next_up = centre.groupBy("_comp", "_part").agg(F.max(F.struct("_c", "_a")).alias("_best")).select("_comp", F.col("_best._a").alias("_a"))
        else:
            outside = label.where("_label <> _main").join(used, ["_comp", "_a"], "left_anti")
            next_up = outside.select("_comp", "_a")
        turn = _first_of_each(next_up, "_comp", "_a", most)
        turn = written(turn, "near-pivots")
        if used is not None and turn.isEmpty():
            break
        used, most = turn if used is None else written(used.unionByName(turn), "near-used"), 4 * most
        # A unit is a block with some of the pivots.
        shares = turn.groupBy("_comp").agg(F.ceil(F.count(F.lit(1)) / pivots).alias("_shares"))
        shares = large.select("_comp", "_parts").distinct().join(shares, "_comp")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sent = (
            turn.join(members.select("_comp", "_a", "_set"), ["_comp", "_a"])
            .join(shares, "_comp")
            .withColumn("_part", each("_parts"))
            .withColumn("_part", F.col("_part") * F.col("_shares") + F.pmod(F.xxhash64("_a"), F.col("_shares")))
            .select("_comp", "_part", "_a", "_set", F.lit(True).alias("_pivot"))
        )
        against = (
            members.join(shares, "_comp")
            .withColumn("_share", each("_shares"))
            .withColumn("_part", F.col("_part") * F.col("_shares") + F.col("_share"))
            .select("_comp", "_part", "_a", "_set", F.lit(False).alias("_pivot"))
        )
        links = written(links.unionByName(solve(against.unionByName(sent))), "near-links")
    return links


def _units(still: DataFrame, size: int) -> DataFrame:
    """Deal the nodes of bands (_key, _a, _label) to units (_u, _v) of at most about twice ``size`` of them.

    Nodes of a band's largest part make blocks of their own, which meet those of the others but not each other.
    """
    counts = still.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_c"))
    bands = counts.groupBy("_key").agg(F.max(F.struct("_c", "_label")).alias("_top"), F.sum("_c").alias("_all"))
    bands = bands.select(
        "_key",
        F.col("_top._label").alias("_main"),
        F.when(F.col("_all") > 2 * size, F.ceil((F.col("_all") - F.col("_top._c")) / size)).alias("_others"),
        F.ceil(F.col("_top._c") / size).alias("_mains"),
    )
    others, mains = F.col("_others"), F.col("_mains")
    own = lambda blocks: F.pmod(F.xxhash64("_a"), blocks)
    every = lambda blocks, unit: F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), unit)
    unit = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    among = F.filter(every(others, lambda x: unit(F.least(x, own(others)), F.greatest(x, own(others)))), lambda x: x["u"] < x["v"])
    other = F.concat(among, every(mains, lambda m: unit(own(others), others + m)))
    main = every(others, lambda x: unit(x, others + own(mains)))
    whole = F.array(unit(F.lit(0).cast("long"), F.lit(0).cast("long")))
    units = F.when(others.isNull(), whole).when(F.col("_label") == F.col("_main"), main).otherwise(other)
    dealt = still.join(bands, "_key").select("_key", "_a", "_label", F.explode(units).alias("_unit"))
    return dealt.select("_key", F.col("_unit.u").alias("_u"), F.col("_unit.v").alias("_v"), "_a", "_label")


def _labelled(large: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnsRenamed({"_node": "_a", "_comp": "_label"})
    return large.join(found, "_a", "left").select("_comp", "_parts", "_part", "_a", F.coalesce("_label", "_a").alias("_label"))


def _first_of_each(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n least values of each group, found in two steps so that no group meets in one task whole."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(64)))
    for keys in ([group, "_salt"], [group]):
        salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_r") <= n)
    return salted.select(group, value)
