"""License scans: base places by brute force, rules on small texts."""
import re

from brute import base_report
from sessionloom.llm import licenses


def scanned(df):
    return {r["doc_id"]: r for r in licenses.scan(df).collect()}


def test_base_places(larger_docs):
    rows = scanned(larger_docs)
    for d in larger_docs.collect():
        r = rows[d["doc_id"]]
        n, places, first, last, labels = base_report(d["text"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_rules_and_suppression(table):
    texts = {
        1: "Licensed under CC BY-NC 4.0.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "permit license; summit licenses",
        4: "Apache License and MIT License and the MIT License", 5: "SPDX-License-Identifier: BSD-3-Clause", 6: "GNU Lesser General Public Licence 2.1 or Mozilla Public License 2.0",
        7: "mit, license", 8: "CC BY", 9: "nothing here",
    }
    rows = scanned(table(list(texts.items())))
    labels = {k: r["labels"] for k, r in rows.items()}
    assert labels[1] == "cc-by,cc-by-nc" and labels[2] == "gpl,gpl-3.0" and labels[3] == "" and labels[5] == "bsd-3-clause"
    assert labels[4] == "apache,mit" and labels[6] == "lgpl-2.1,mpl-2.0" and labels[7] == "mit" and labels[8] == "cc-by" and labels[9] == ""
    assert rows[4]["n_base"] == 3 and (rows[4]["first_word"], rows[4]["last_word"]) == (0, 7)
    assert rows[9]["score"] == 0 and rows[2]["score"] == 1
    # The version of the licence lies inside the longer notice: one detection is left.
    assert len(rows[2]["detections"]) == 1


def test_many_hand_written_rules():
    rules = licenses.default_rules()
    assert len(rules) > 200 and all(re.compile(r.pattern) and r.keyword and r.priority in (1, 2, 3) for r in rules)


def test_awkward_rows(table, awkward):
    rows = licenses.scan(table([*awkward, (20, "the apache license " * 3000)])).collect()
    assert len(rows) == len(awkward) + 1
    assert all(r["labels"] == "" and r["n_base"] == 0 and r["first_word"] is None for r in rows if r["doc_id"] in (1, 2, 3))
    assert [r["n_base"] for r in rows if r["doc_id"] == 20] == [3000]
    assert licenses.scan(table([])).count() == 0
