"""Rows of null or repeated ids and different texts are told apart in every stage."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from lotwise.llm import lines, quality, superminhash  # noqa: E402

X, U1, U2, Y = "one line of words that comes again", "the first text has this line alone", "and the second text has another one", "some other line that is here twice"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], H.DOCS).repartition(3)


def test_line_dedup(spark):
    rows = [(None, f"{U1}\n{X}"), (None, f"{X}\n{U2}"), (7, f"{Y}\nseven, a line with words"), (7, f"{Y}\nother words stand here"), (7, f"{Y}\nother words stand here")]
    got = Counter((r.doc_id, r.text) for r in lines.dedup_lines(_docs(spark, rows)).collect())
    assert got[None, U1] == 1 and got[None, f"{X}\n{U2}"] == 1  # x stays once, no other line is lost
    both = Counter({(None, U1): 1, (None, f"{X}\n{U2}"): 1})
    ways = [
        both + Counter({(7, f"{Y}\nseven, a line with words"): 1, (7, "other words stand here"): 2}),
        both + Counter({(7, "seven, a line with words"): 1, (7, f"{Y}\nother words stand here"): 2})]
    assert got in ways, got
    n = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in lines.line_report(_docs(spark, rows)).collect())
    assert n[:2] == [(0, 2, 0), (0, 2, 1)] and sum(x[2] for x in n[2:]) in (1, 2)


def test_keep_good(spark):
    good, bad = "several plain words make a text that passes " + " ".join(f"w{i}" for i in range(60)), "no"
    rows = [(None, good), (None, bad), (5, bad), (5, good)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter((r.doc_id, r.text) for r in quality.keep_good(_docs(spark, rows), labels).collect()) == Counter([(None, good), (5, good)])


def test_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(80))
    near, other, third = long + " end", " ".join(f"other{i}" for i in range(50)), " ".join(f"third{i}" for i in range(50))
    rows = [
        (None, long), (None, near), (None, long), (3, long),  # one group, most of it without id
        (None, other), (None, other),  # a group without ids
        (4, third), (4, third), (4, "a text of its own"), (9, third + " end"),
        (None, None), (None, ""), (8, " ")]
    got = Counter((r.doc_id, r.text) for r in superminhash.keep_one(_docs(spark, rows)).collect())
    group = [k for k in got if k[1] in (long, near)]
    assert len(group) == 1 and group[0][0] is None and got[group[0]] == 1
    assert got - Counter({group[0]: 1}) == Counter([(None, other), (4, third), (4, "a text of its own"), (None, None), (None, ""), (8, " ")])
