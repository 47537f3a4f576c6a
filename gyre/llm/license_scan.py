"""License scans: ordered signature rules over the words of texts.

A text's words stand in lower case, one space apart. Few texts have the words that a rule needs, and only rules whose needs
are met are matched; that leaves their signatures to a few texts. What rules find are intervals of words. An interval is
suppressed if it lies within one that a rule of as high a priority found; of equal intervals the higher priority stays, and
then the earlier rule. The places of the base phrases are never suppressed.

Words are counted and looked up in parts of bounded size, so that the list of a long text's words is never whole.

Cases: null and empty texts have no words and nothing is found in them; rows that repeat an identifier are rows of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.license_rules import Rule, rules
from gyre.llm.session import shipped

#: Bytes of a text that are cut into words at a time.
PART = 1 << 20
#: Letters and digits in lower case, and every byte of other characters; all else separates.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_FOUND = "array<struct<rule:int,label:string,first:bigint,last:bigint,priority:int,weight:double,base:boolean,kept:boolean>>"


class Scanner:
    """Rules by the words that they need."""

    def __init__(self, ordered: list[Rule]):
        self.rules = ordered
        self.by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(ordered):
            for word in rule.needs[0]:
                self.by_word.setdefault(word, []).append(i)
        self.keywords = frozenset(w for r in ordered for group in r.needs for w in group)

    def gated(self, present: set[bytes]) -> list[int]:
        """The rules whose needs are met by the words."""
        some = {i for w in present for i in self.by_word.get(w, ())}
        return sorted(i for i in some if all(not group.isdisjoint(present) for group in self.rules[i].needs))

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """The number of words, and what is found: (rule, first word, last word, kept), in the order of the rules."""
        plain = text.encode("utf-8", "replace").translate(_PLAIN)
        count, present, parts, at = 0, set(), [], 0
        while at < len(plain):
            end = len(plain) if at + PART >= len(plain) else plain.find(b" ", at + PART)
            end = len(plain) if end < 0 else end
            words = plain[at:end].split()
            count += len(words)
            present |= self.keywords.intersection(words)
            if words:
                parts.append(b" ".join(words))
            at = end
        gated = self.gated(present)
        if not gated:
            return count, []
        spaced = b" " + b" ".join(parts) + b" "
        spaces = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
        spans = [(i, m.start(), m.end()) for i in gated for m in self.rules[i].pattern.finditer(spaced)]
        if not spans:
            return count, []
        rule, start, end = np.array(spans).T
        first, last = np.searchsorted(spaces, start), np.searchsorted(spaces, end) - 1
        kept = self.unsuppressed(rule, first, last)
        return count, list(zip(rule.tolist(), first.tolist(), last.tolist(), kept.tolist()))

    def unsuppressed(self, rule: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which intervals stay."""
        priority = np.array([r.priority for r in self.rules])[rule]
        base = np.array([r.base for r in self.rules])[rule]
        # From the highest rank on; of equal intervals and ranks the earlier rule comes first.
        out = np.ones(len(rule), bool)
        for level in np.unique(priority):
            above = np.flatnonzero(priority >= level)
            # Wider intervals stand first, and of equal ones those that win.
            order = above[np.lexsort((rule[above], -priority[above], -last[above], first[above]))]
            reach = np.maximum.accumulate(last[order])
            within = np.concatenate([[False], reach[:-1] >= last[order][1:]])
            out[order[within & (priority[order] == level)]] = False
        return out | base


@functools.cache
def scanner() -> Scanner:
    return Scanner(rules())


def license_detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules find in each text.

    Columns: id, n_words, and found, an array of structs: rule (its place in the order), label, first and last word of
    the interval (from 0), priority, weight, base (whether the rule is one of the base phrases), and kept (not
    suppressed).
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        scan = scanner()
        fields = [("rule", pa.int32()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_())]
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1):
                n, spans = scan.scan(text.as_py() or "")
                counts.append(n)
                found.append([(i, scan.rules[i].label, a, b, scan.rules[i].priority, scan.rules[i].weight, scan.rules[i].base, k) for i, a, b, k in spans])
            listed = pa.array([[dict(zip([f[0] for f in fields], x)) for x in row] for row in found], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), listed], names=[id_col, "n_words", "found"])

    return shipped(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, found {_FOUND}")


def license_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A text's labels: id, n_words, n_base, first_word and last_word (of the base places), base_labels, labels and score.

    ``labels`` are those of the intervals that are kept, base places among them; the score is the highest weight of them.
    """
    base, kept = F.filter("found", lambda x: x["base"]), F.filter("found", lambda x: x["kept"])
    starts = F.transform(base, lambda x: x["first"])
    shown = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return license_detections(df, id_col, text_col).select(
        F.col(f"`{id_col}`"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        shown(base).alias("base_labels"), shown(kept).alias("labels"), F.coalesce(F.array_max(F.transform(kept, lambda x: x["weight"])), F.lit(0.0)).alias("score"),
    )
