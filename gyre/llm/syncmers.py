"""Document fingerprints from closed syncmers.

The letters are words, but characters in runs of a script without spaces and in runs of over ``LONG`` characters. They
are hashed; each K of them in a row are a candidate, and it is an anchor if the least hash of its inner pairs of letters
lies at its first or last place. Whether a candidate is an anchor depends on its own letters only, so equal passages have
equal anchors wherever they stand. A fingerprint lists all anchors by their hashes, each with its place. Besides those of
the letters it has, for every text, the anchors of the ``EDGE`` characters at its start and at its end, with characters as
letters: they are few beside the words of a long text, and what a text of a few words is known by. Its likeness to another
is the share of common hashes among those of both. All of it is DataFrame functions on the JVM.

Cases: a null text is empty, and so is its fingerprint; every other text has an anchor: where no candidate is one, the
first edge's candidate of least hash, and with fewer than K characters the text itself; two empty fingerprints are alike
(1), an empty one and another are not (0); rows with equal or null identifiers are neighbours in the order of their texts'
hashes, null ones last; a single row is its own neighbour; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of an anchor, and characters of the longest run that is one letter.
K, LONG = 5, 32
#: Characters at either end of a text that are letters as well.
EDGE = 32
#: A character of a script that is written without spaces.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: A character beyond those of scripts with spaces that come first in Unicode; all of ``UNSPACED`` are.
BEYOND = r"[^\x{0}-\x{DFF}]"
_SPACE = r"[\x20\x09-\x0D]+"
#: Bits of an anchor's number that hold its place, below those of its hash.
PLACE_BITS = 24
#: Rows dealt to one window of neighbours, windows at most, and identifiers sampled for the edges of each.
ROWS, WINDOWS, SAMPLED = 500, 20_000, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _anchor(hashed: Column, place: Column) -> Column:
    low = (1 << PLACE_BITS) - 1
    return hashed.bitwiseAND(F.lit(~low)).bitwiseOR(F.least(place, F.lit(low)).cast("long"))


def _closed(pairs: Column, first: Column | None = None, least: bool = False) -> Column:
    """The anchors among candidates of K letters, by the hashes of pairs of letters; places count from ``first``.

    ``least`` takes the candidate of least hash where there is no anchor.
    """
    place = lambda i: i if first is None else i + first
    hashed = lambda i: F.xxhash64(F.get(pairs, i), F.get(pairs, i + 1), F.get(pairs, i + (K - 2)))
    # The last letter's pair is no pair, and is left out.
    starts = F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - (K - 1), F.lit(0)))

    def look(first_pair: Column, i: Column) -> Column:
        inner = [F.get(pairs, i + j) for j in range(1, K - 2)]
        at_edge = F.least(first_pair, F.get(pairs, i + (K - 2))) <= F.least(*inner)
        return F.when(at_edge, _anchor(hashed(i), place(i)))

    found = F.array_compact(F.transform(starts, look))
    if not least:
        return found
    one = lambda: F.array_compact(F.array(F.array_min(F.transform(starts, lambda _, i: _anchor(hashed(i), place(i))))))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(one()))


def anchors(text: Column, kept: int | None = None) -> Column:
    """The anchors of a text's letters, or the ``kept`` least, as rising numbers: the hash in the upper 40 bits, the place below.

    A text of fewer than K letters has none. Places from 2**24 on, in texts of some hundred MB, are given as 2**24 - 1.
    """
    cut = lambda found: found if kept is None else F.slice(let(found, _first_places), 1, kept)

    def pick(words: Column) -> Column:
        pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
        return cut(F.array_sort(let(pairs, lambda p: _closed(p))))

    return let(_letters(text), pick)


def fingerprint(text: Column) -> Column:
    """A text's anchors, those of its letters and of the characters at its edges, as rising numbers."""
    n = F.length(text)

    def edge(part: Column, first: Column, least: bool) -> Column:
        pairs = lambda c: F.transform(c, lambda x, i: F.xxhash64(F.lit("edge"), x, F.get(c, i + 1)))
        # The first place is bound as well: the length of a text takes a pass over it.
        return let(first, lambda at: let(F.split(part, ""), lambda c: let(pairs(c), lambda p: _closed(p, at, least))))

    head = edge(F.left(text, F.lit(EDGE)), F.lit(0), True)
    tail = edge(F.right(text, F.lit(EDGE)), F.greatest(n - EDGE, F.lit(0)), False)
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(_anchor(F.xxhash64(text), F.lit(0))))
    return F.when(n < K, whole).otherwise(F.array_sort(F.concat(anchors(text), F.array_union(head, tail))))


def _letters(text: Column) -> Column:
    """Words, or characters of a run of them without spaces."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    # Scripts are looked up character by character; a plain range tells most texts to have none of them.
    dense = lambda t: t.rlike(BEYOND) & t.rlike(UNSPACED)
    long = lambda w: F.length(w) > LONG
    apart = lambda words: F.flatten(F.transform(words, lambda w: F.when(long(w) | dense(w), F.split(w, "")).otherwise(F.array(w))))
    return let(F.split(trimmed, _SPACE), lambda words: F.when(F.exists(words, long) | dense(text), apart(words)).otherwise(words))


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def _first_places(rising: Column) -> Column:
    """Of anchors with one hash the first."""
    return F.filter(rising, lambda a, i: (i == 0) | (_hash(a) != _hash(F.get(rising, i - 1))))


def likeness(a: Column, b: Column) -> Column:
    """The share of common hashes among those of both, 0 to 1."""

    def of(x: Column, y: Column) -> Column:
        either = F.size(F.array_union(x, y))
        return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / either)

    hashes = lambda c: F.transform(c, _hash)
    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y)))


def common_places(a: Column, b: Column) -> Column:
    """Where two fingerprints' common anchors stand first: an array of (place in a, place in b)."""
    low = F.lit((1 << PLACE_BITS) - 1)

    def side(c: Column, n: int) -> Column:
        one = lambda x: F.struct(_hash(x).alias("h"), F.lit(n).alias("s"), x.bitwiseAND(low).alias("p"))
        return F.transform(let(c, _first_places), one)

    def meet(rising: Column) -> Column:
        after = lambda i: F.get(rising, i + 1)
        found = F.transform(rising, lambda x, i: F.when(x["h"] == after(i)["h"], F.struct(x["p"].alias("a"), after(i)["p"].alias("b"))))
        return F.array_compact(found)

    return let(F.array_sort(F.concat(side(a, 0), side(b, 1))), meet)


def shown(anchor_list: Column) -> Column:
    """A fingerprint as text: ``hash:place`` of its anchors, joined by commas."""
    low = F.lit((1 << PLACE_BITS) - 1)
    one = lambda a: F.concat(
        F.lpad(F.hex(F.shiftrightunsigned(a, PLACE_BITS)), 10, "0"), F.lit(":"), a.bitwiseAND(low).cast("string")
    )
    return F.array_join(F.transform(anchor_list, one), ",")


def with_next(df: DataFrame, id_col: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Add ``next_<column>``: the values of the next row by descending identifier, after the last the first.

    Columns in ``derived`` are computed once a row, after the shuffle, and given for both rows.

    Windows hold ranges of identifiers of about ``ROWS`` rows, more beyond ``WINDOWS`` windows; a window is sorted
    on disk and streams through its task. Their edges come from a sample of identifiers of any type that has an
    order, which shifts work between tasks, not results. The first row of each window ends the one before, too.
    """
    n = df.count()
    windows = max(1, min(WINDOWS, n // ROWS))
    place = F.lit(0)
    if windows > 1:
        drawn = df.select(id_col).where(F.col(id_col).isNotNull()).sample(min(1.0, SAMPLED * windows / n), 7).collect()
        drawn = sorted(r[0] for r in drawn)
        cuts = sorted({drawn[i * len(drawn) // windows] for i in range(1, windows)}) if drawn else []
        place = _bracket(F.col(id_col), cuts, df.schema[id_col].dataType)
    placed = df.withColumn("_part", place).withColumn("_tie", F.xxhash64(columns[0]))
    by_id = [F.col(id_col).desc_nulls_last(), F.col("_tie")]
    first = Window.partitionBy("_part").orderBy(*by_id)
    heads = placed.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    # Parts fall with the order of rows: a head goes to the next part above its own, that of the highest to the lowest.
    # The numbers of the parts alone, ``WINDOWS`` at most, meet in one task and are broadcast.
    downward = Window.orderBy(F.col("_part").desc())
    whole = downward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = placed.select("_part").distinct()
    goes = parts.select("_part", F.coalesce(F.lag("_part").over(downward), F.last("_part").over(whole)).alias("_to"))
    ends = heads.join(F.broadcast(goes), "_part").withColumn("_part", F.col("_to")).drop("_to")
    rows = placed.withColumn("_end", F.lit(False)).unionByName(ends.withColumn("_end", F.lit(True)))
    rows = rows.repartition("_part").sortWithinPartitions("_part", "_end", *by_id).withColumns(derived or {})
    given = [*columns, *(derived or {})]
    led = rows.withColumn("_next", F.lead(F.struct(*given)).over(Window.partitionBy("_part").orderBy("_end", *by_id)))
    return led.where("NOT _end").select(*df.columns, *(derived or {}), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in given])


def _bracket(value: Column, cuts: list, kind: T.DataType) -> Column:
    """How many of the rising cuts are at most the value, by halving; null comes before all."""
    at = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(T.ArrayType(kind))

    def search(rising: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
            below = F.coalesce(F.get(rising, middle) <= value, F.lit(False))
            open_ = state["lo"] < state["hi"]
            return F.struct(
                F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"),
                F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"),
            )

        zero = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), zero, step)["lo"]

    return F.when(value.isNull(), F.lit(-1)).otherwise(search(at))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last third gives way to the start of the next document.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Texts alone are shuffled, since their anchors take as much room again.
    rows = with_next(base, "_id", ["_text"], {"_own": fingerprint(F.col("_text"))})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("_text").cast("long"))
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next__text"), F.lit(1), third)
    )
    own = F.col("_own")
    other = let(edited, lambda e: let(fingerprint(e), lambda a: F.struct(F.sha2(e, 256).alias("sha"), shown(a).alias("shown"), likeness(own, a).alias("near"))))
    compared = F.struct(shown(own).alias("shown"), other.alias("edited"), likeness(own, F.col("next__own")).alias("next"))
    return rows.select(F.col("_id").alias(id_col), "n_chars", compared.alias("_e")).select(
        id_col,
        "n_chars",
        F.col("_e.edited.sha").alias("edited_sha256"),
        F.col("_e.shown").alias("fingerprint"),
        F.col("_e.edited.shown").alias("edited_fingerprint"),
        F.col("_e.edited.near").alias("near_edited"),
        F.col("_e.next").alias("near_next"),
    )
