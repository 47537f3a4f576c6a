"""Removal of repeated passages by suffix automata of shards of the corpus.

A window is ``window`` words in a row; a window is repeated if the same words start earlier. Windows are
dealt to shards by the least hash of their inner runs of words (the anchor), so that equal windows always
meet, and neighbours mostly keep together. Anchors found once in the corpus cannot lie in repeated windows
and drop out first. A shard's text is the distinct stretches around its anchors, in corpus order; a suffix
automaton is built over them while they stream through it, and wherever the longest match with what went
before reaches the window's length, the window ends a repeat. Overlapping repeats form maximal spans, and
their words are cut out.

The automata are shared out by shuffle, not broadcast: the reference of a corpus is the corpus itself, which
has no size bound. Equal stretches are merged before the shuffle. Anchors found in more than ``HOT`` texts
deal out their windows one by one by their own hash, which merge as well, so that no shard grows with a
hot passage. Texts that equal an earlier one are repeated as a whole and do not enter the shards.

Cases: a null or empty text has no words; rows that repeat an identifier and a text are one document, rows
with an identifier and different texts are ordered by the texts' hashes; null identifiers come after all
others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.session import shipped, written
from gyre.llm.text import Words, grams, slices, text_buffers

WINDOW = 20
#: Texts from which an anchor's windows are dealt out one by one.
HOT = 5_000
#: Bytes of a word's hash in a stretch.
WORD_BYTES = 6
_EMPTY = hashlib.sha256(b"").hexdigest()


def inner_words(window: int) -> int:
    """Words of an anchor: few, so that anchors are rare, but no more than 60 windows share one."""
    return max(min(6, window), window - 59)


class Anchored:
    """The windows of some texts in runs that share an anchor.

    ``win``: index of each run's first word; ``n``: its windows; ``doc``: its row; ``anchor``: the hash.
    """

    def __init__(self, words: Words, hashes: np.ndarray, window: int):
        k = inner_words(window)
        inner = window - k + 1
        count = len(hashes) - window + 1
        self.win = self.n = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if count <= 0:
            return
        # Hashes of k words at every place, also across texts: those windows are left out below.
        gram, _ = grams(hashes, np.zeros(len(hashes), np.int8), k)
        lesser = lambda a, b: np.where(gram[b] < gram[a], b, a)
        least, span = np.arange(len(gram)), 1
        while 2 * span <= inner:
            least = lesser(least[:-span], least[span:])
            span *= 2
        if span < inner:
            least = lesser(least[: -(inner - span)], least[inner - span :])
        at = np.flatnonzero(words.doc[:count] == words.doc[window - 1 :])
        if not len(at):
            return
        place = least[at]
        opens = np.ones(len(at), bool)
        opens[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(opens)
        self.win = at[first]
        self.n = np.diff(np.append(first, len(at)))
        self.doc = words.doc[self.win]
        self.anchor = gram[place[first]]


class SuffixAutomaton:
    """A generalised suffix automaton that grows with the strings it reads."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def matched(self, symbols) -> Iterator[int]:
        """Read a string; for each symbol the length of the longest match, ending there, with what went before.

        That is the longest suffix, of the string so far, that has occurred at an earlier place.
        """
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._part(last, c, q)
                last = q
                yield length[q]
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] != length[p] + 1:
                    q = self._part(p, c, q)
                link[new] = q
            last = new
            yield length[link[new]]

    def _part(self, p: int, c, q: int) -> int:
        """Split off from state q the strings that come from p."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


def _base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g")
    )


def _read(batch, column: int, size: int = 1 << 20):
    """Slices of a batch: first row, last row, words of its texts."""
    data, off = text_buffers(batch.column(column))
    for lo, hi in slices(off, size):
        yield lo, hi, Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def joined_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's kept words joined by one space, and each text's start, n + 1 values."""
    data = words.data.copy()
    take = np.zeros(len(data) + 1, bool)
    sizes = words.end - words.start
    flat = np.repeat(words.start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
    take[flat] = np.repeat(kept, sizes)
    index = np.flatnonzero(kept)
    if len(index) > 1:
        between = words.doc[index[1:]] == words.doc[index[:-1]]
        gaps = words.end[index[:-1][between]]
        take[gaps] = True
        data[gaps] = 0x20
    take = take[: len(data)]
    total = np.concatenate([[0], np.cumsum(take)])
    return data[take], total[words.off]


def _digests(words: Words, kept: np.ndarray) -> list[str]:
    out, off = joined_words(words, kept)
    raw, off = memoryview(out.tobytes()), off.tolist()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off, off[1:])]


def _per_text(batches):
    for batch in batches:
        n, sha = [], []
        for _, _, words in _read(batch, 1):
            n.append(np.diff(words.first))
            sha += _digests(words, np.ones(len(words.start), bool))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(sha, pa.string())],
            names=["_id", "_h", "_g", "_n", "_sha"],
        )


def _anchor_rows(window: int, ids: bool):
    """Anchors of each text: anchor, hash of the text, and its count in the text or the text's identifier."""

    def run(batches):
        for batch in batches:
            for lo, hi, words in _read(batch, 1):
                runs = Anchored(words, words.hashes(), window)
                order = np.lexsort((runs.anchor, runs.doc))
                doc, anchor = runs.doc[order], runs.anchor[order]
                opens = np.ones(len(doc), bool)
                opens[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(opens)
                row = pa.array(lo + doc[first], pa.int64())
                last = batch.column(0).take(row) if ids else pa.array(np.diff(np.append(first, len(doc))), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[first].view(np.int64)), batch.column(2).take(row), last], names=["_a", "_h", "_id" if ids else "_c"]
                )

    return run


def _hits(batch, lo: int, hi: int, words: Words, window: int, column: int):
    """Of the runs of a slice's texts those whose anchor is listed for the text, and whether it is hot; and the hashes."""
    hashes = words.hashes()
    runs = Anchored(words, hashes, window)
    lists = batch.column(column).slice(lo, hi - lo)
    sizes = _sizes(lists)
    flat = lists.flatten()
    listed, hot = flat.field("a").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("hot").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(hi - lo), sizes)
    pair = lambda d, a: a ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = pair(owner, listed)
    order = np.argsort(keys)
    keys = keys[order]
    mine = pair(runs.doc, runs.anchor)
    at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
    hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
    return hashes, runs, hit, hot[order][at] if len(keys) else hit


def _sizes(lists) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _stretches(window: int):
    """The stretches of words around the listed anchors: key, text, start, windows, words; equal ones of a slice once."""

    def run(batches):
        for batch in batches:
            for lo, hi, words in _read(batch, 1):
                hashes, runs, hit, hot = _hits(batch, lo, hi, words, window, 3)
                raw = hashes.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
                windows, at = grams(hashes, np.zeros(len(hashes), np.int8), window) if hot[hit].any() else (None, None)
                # Of equal stretches the first in corpus order stays, whatever the order of the rows.
                ids, texts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 2))
                rank = np.empty(hi - lo, np.int64)
                rank[sorted(range(hi - lo), key=lambda d: (ids[d] is None, 0 if ids[d] is None else ids[d], texts[d]))] = np.arange(hi - lo)
                found = np.flatnonzero(hit)
                found = found[np.lexsort((runs.win[found], rank[runs.doc[found]]))]
                seen, out = set(), ([], [], [], [], [])
                for i in found.tolist():
                    begin, n, doc = int(runs.win[i]), int(runs.n[i]), int(runs.doc[i])
                    if hot[i]:
                        parts = [(int(windows[begin + j].view(np.int64)), begin + j, 1) for j in range(n)]
                    else:
                        parts = [(int(runs.anchor[i].view(np.int64)), begin, n)]
                    for key, b, m in parts:
                        content = raw[b * WORD_BYTES : (b + m + window - 1) * WORD_BYTES]
                        if (key, content) in seen:
                            continue
                        seen.add((key, content))
                        for column, value in zip(out, (key, lo + doc, b - int(words.first[doc]), m, content)):
                            column.append(value)
                row = pa.array(out[1], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), batch.column(0).take(row), batch.column(2).take(row),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
                    names=["_a", "_id", "_h", "_s", "_m", "_words"],
                )

    return run


def first_windows(stretches: list[bytes], window: int) -> list[int]:
    """Of the distinct stretches of one shard in corpus order, the windows that do not start earlier, as bit masks."""
    if len(stretches) == 1:
        return [(1 << (len(stretches[0]) // WORD_BYTES - window + 1)) - 1]
    automaton, masks = SuffixAutomaton(), []
    for words in stretches:
        symbols = [words[i : i + WORD_BYTES] for i in range(0, len(words), WORD_BYTES)]
        mask = 0
        for end, match in enumerate(automaton.matched(symbols)):
            if end >= window - 1 and match < window:
                mask |= 1 << (end - window + 1)
        masks.append(mask)
    return masks


def _shards(window: int):
    """From stretches sorted by key and corpus order the first windows: text, start, mask."""

    def run(batches):
        key, group = None, {}

        def done():
            masks = first_windows(list(group), window)
            return [(*where, mask) for where, mask in zip(group.values(), masks) if mask]

        out = []
        for batch in batches:
            for a, i, h, s, words in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5))):
                if a != key:
                    if group:
                        out += done()
                    key, group = a, {}
                group.setdefault(words, (i, h, s))
            if len(out) > 50_000:
                yield _found(out, batch.schema.field(1).type)
                out = []
            id_type = batch.schema.field(1).type
        if group:
            out += done()
            yield _found(out, id_type)

    return run


def _found(rows, id_type) -> pa.RecordBatch:
    ids, h, s, mask = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(mask, pa.int64())], names=["_id", "_h", "_s", "_mask"]
    )


def _cut(window: int, texts: bool):
    """Cut the repeated windows' words out of texts that have listed anchors: counts, digest, and the text if asked for."""

    def run(batches):
        for batch in batches:
            n, removed, sha, left = [], [], [], []
            for lo, hi, words in _read(batch, 1):
                _, runs, hit, _ = _hits(batch, lo, hi, words, window, 3)
                begin, many = runs.win[hit], runs.n[hit]
                bad = np.zeros(len(words.start) + 1, bool)
                each = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
                bad[each] = True
                first = batch.column(4).slice(lo, hi - lo)
                at, flat = _sizes(first), first.flatten()
                start = np.repeat(words.first[:-1], at) + flat.field("s").to_numpy(zero_copy_only=False)
                mask = flat.field("mask").to_numpy(zero_copy_only=False)
                for j in range(window - inner_words(window) + 1):
                    bad[start[(mask >> j) & 1 == 1] + j] = False
                # A word is cut if a repeated window covers it.
                edge = np.zeros(len(words.start) + window + 1, np.int64)
                index = np.flatnonzero(bad)
                edge[index] += 1
                np.add.at(edge, index + window, -1)
                kept = np.cumsum(edge)[: len(words.start)] == 0
                n.append(np.diff(words.first))
                total = np.concatenate([[0], np.cumsum(~kept)])
                removed.append(np.diff(total[words.first]))
                sha += _digests(words, kept)
                if texts:
                    left += _left(words, kept, removed[-1])
            arrays = [batch.column(0), batch.column(2), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(sha, pa.string())]
            names = ["_id", "_h", "_n", "_removed", "_sha"]
            if texts:
                arrays.append(pa.array(left, pa.string()))
                names.append("_left")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _left(words: Words, kept: np.ndarray, removed: np.ndarray) -> list[str | None]:
    """The texts without the cut words, each with the white space before it; null where nothing was cut."""
    raw, out = words.data.tobytes(), []
    for d in range(len(words.off) - 1):
        if not removed[d]:
            out.append(None)
            continue
        a, b, end = int(words.first[d]), int(words.first[d + 1]), int(words.off[d])
        parts = []
        for i in range(a, b):
            if kept[i]:
                parts.append(raw[end if i > a else int(words.off[d]) : int(words.end[i])])
            end = int(words.end[i])
        parts.append(raw[end : int(words.off[d + 1])])
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, texts: bool = False
) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256, and with ``texts`` kept_text.

    ``kept_sha256`` is of the kept words joined by one space; ``kept_text`` keeps the white space before them.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = shipped(_base(df, id_col, text_col))
    base = written(docs.mapInArrow(_per_text, f"_id {kind}, _h bigint, _g bigint, _n bigint, _sha string"), "passages-texts")
    first = base.groupBy("_h", "_g").agg(F.min("_id").alias("_first"), F.min(F.col("_n")).alias("_n"))
    own = base.join(first.select("_h", "_g", "_first"), ["_h", "_g"])
    is_first = F.col("_id").eqNullSafe(F.col("_first"))

    counted = docs.mapInArrow(_anchor_rows(window, False), "_a bigint, _h bigint, _c bigint").groupBy("_a").agg(
        F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.max("_c").alias("_c"), F.count(F.lit(1)).alias("_texts")
    )
    often = counted.where("_lo <> _hi OR _c > 1").select("_a", (F.col("_texts") > hot).alias("_hot"))
    listed = (
        docs.mapInArrow(_anchor_rows(window, True), f"_a bigint, _h bigint, _id {kind}")
        .join(often, "_a")
        .groupBy("_id", "_h")
        .agg(F.collect_set(F.struct(F.col("_a").alias("a"), F.col("_hot").alias("hot"))).alias("_list"))
    )
    entering = own.where(is_first & (F.col("_n") >= window)).select("_id", "_h").distinct()
    listed = written(_null_safe_join(listed, entering, kind, "left_semi"), "passages-anchors")

    candidates = _null_safe_join(docs, listed, kind, "inner").select("_id", "_text", "_h", "_list")
    parts = candidates.mapInArrow(
        _stretches(window), f"_a bigint, _id {kind}, _h bigint, _s bigint, _m int, _words binary"
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "_a").sortWithinPartitions(F.col("_a"), F.col("_id").asc_nulls_last(), "_h", "_s")
    found = dealt.mapInArrow(_shards(window), f"_id {kind}, _h bigint, _s bigint, _mask bigint")
    kept = found.groupBy("_id", "_h").agg(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_mask").alias("mask"))).alias("_kept"))
    kept = written(kept, "passages-first")
    cut = _null_safe_join(candidates, kept, kind, "left").select("_id", "_text", "_h", "_list", "_kept").mapInArrow(
        _cut(window, texts), f"_id {kind}, _h bigint, _n bigint, _removed bigint, _sha string" + (", _left string" if texts else "")
    )
    cut = written(cut.dropDuplicates(["_id", "_h"]), "passages-cut")

    whole = (F.col("_n") >= window) & ~is_first
    result = _null_safe_join(own, cut.drop("_n").withColumnRenamed("_sha", "_cut_sha"), kind, "left")
    removed = F.when(whole, F.col("_n")).otherwise(F.coalesce("_removed", F.lit(0)))
    sha = F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("_cut_sha", "_sha"))
    out = [F.col("_id").alias(id_col), F.col("_n").alias("n_words"), removed.cast("long").alias("n_removed"), sha.alias("kept_sha256")]
    if texts:
        out += [F.col("_h").alias("_h"), F.when(whole, F.lit("")).otherwise(F.col("_left")).alias("kept_text")]
    return result.select(*out)


def _null_safe_join(a: DataFrame, b: DataFrame, kind: str, how: str) -> DataFrame:
    """Join on the text's hash and the identifier, which may be null, as an equi-join."""
    b = b.withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    out = a.join(b, a["_id"].eqNullSafe(b["_id2"]) & (a["_h"] == b["_h2"]), how)
    return out if how == "left_semi" else out.drop("_id2", "_h2")
