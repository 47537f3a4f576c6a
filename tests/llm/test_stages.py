"""Which rows and lines the pipeline's stages take away, by plain versions on small tables."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from gyre.llm import pipeline, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, name string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "n", "k") for i, t, s in rows], SCHEMA)


def words(tag, n):
    return " ".join(f"{tag}{j}" for j in range(n))


def test_near_keeps_one_of_each_group(spark):
    a, b, c = words("a", 40), words("b", 40), words("c", 3)
    rows = [(5, a, "s"), (None, a, "s"), (None, a, "s"), (7, a, "t"), (8, a + " more", "t")]  # one group, of which 5 stays
    rows += [(None, b, "s"), (None, b + " x", "s"), (None, b, "s")]  # none has an identifier: one stays
    rows += [(9, c, "s"), (9, c, "s"), (9, words("d", 20), "s")]  # an identifier given twice to one text, and to another
    rows += [(None, None, "s"), (None, None, "s"), (11, "", "s"), (11, "", "s"), (12, " \n", "s")]  # without words
    out = Counter((r.doc_id, r.text) for r in pipeline.near(spark, frame(spark, rows), "").collect())
    left = Counter({(5, a): 1, (9, c): 1, (9, words("d", 20)): 1, (None, None): 2, (11, ""): 2, (12, " \n"): 1})
    assert all(out[k] == n for k, n in left.items())
    rest = out - left
    assert sum(rest.values()) == 1 and all(i is None and t.startswith(b) for i, t in rest)


def test_near_against_components(spark):
    rows = [(i, words("w", 30 + i % 4) if i % 3 else words(f"v{i % 7}", 25), f"s{i}") for i in range(60)]
    want = brute.components([(i, t) for i, t, _ in rows], 5, 80)
    out = pipeline.near(spark, frame(spark, rows).repartition(5), "").collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, (_, c) in want.items() if c == i)


def test_lines_cut_what_five_sites_carry(spark):
    rows = [(i, f"own {i}\nMenu | Home\n\nrare {i % 4}\n Menu | Home \nend", f"s{i % 6}") for i in range(24)] + [(30, None, "s1"), (31, "", None), (None, "Menu | Home", None)]
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line.strip()].add(s)
    bad = {line for line, of in sites.items() if line and len(of) >= 5}
    want = Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad)) for i, t, _ in rows)
    out = pipeline.lines(spark, frame(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == want and bad >= {"Menu | Home", "end"}
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)


def test_passages_cut_the_later_one(spark):
    passage = words("p", 60)
    rows = [(1, f"{words('a', 10)} {passage}", "s"), (2, f"{passage} {words('b', 12)}", "t"), (3, passage, "u"), (4, words("p", 49), "v"), (None, None, "w")]
    out = {r.doc_id: r.text and r.text.strip() for r in pipeline.passages(spark, frame(spark, rows), "").collect()}
    assert out == {1: rows[0][1], 2: words("b", 12), 4: words("p", 49), None: None}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_archives_give_identifiers_back(spark, kind):
    names = ["a\r\nContent-Length: 1", "", "x>y z%41+", "é中", None, "plain"] if kind == "string" else [1, -5, None, 0]
    rows = [(n, "http://e.org/", f"<p>{i}</p>") for i, n in enumerate(names)] + [(names[0], "u", "same"), (names[1], "u", "same")]
    df = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    out = warc.warc_round_trip(df).collect()
    assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)
    again = [r for r in out if r.record_type == "revisit"]
    assert [(r.page_id, r.refers_to) for r in again] == [(min(names[:2]), max(names[:2]))]
