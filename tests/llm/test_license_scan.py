import re

import pytest

from tickerloom.llm.license_rules import KINDS, Rule, rules
from tickerloom.llm.license_scan import PHRASE_WEIGHT, PHRASES, license_scan

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def better(e, d):
    """``e`` contains ``d`` and prevails; both are (start, end, rule)."""
    if not (e[0] <= d[0] and e[1] >= d[1]):
        return False
    if e[2].priority != d[2].priority:
        return e[2].priority < d[2].priority
    return e[:2] != d[:2] or e[2].order < d[2].order


def brute(text, table):
    text = (text or "").translate(FOLD)
    words = re.findall(WORD, text)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
          if words[i : i + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), r) for r in table if r.keyword in text for m in re.finditer(r.pattern, text)]
    best = {label: PHRASE_WEIGHT for _, label in at}
    for d in found:
        if not any(better(e, d) for e in found):
            best[d[2].label] = max(best.get(d[2].label, 0), d[2].weight)
    rest = 1.0
    for weight in best.values():
        rest *= 1 - weight
    return (
        len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
        ",".join(sorted({label for _, label in at})), ",".join(sorted(best)), pytest.approx(1 - rest, abs=1e-6),
    )


TEXTS = [
    None, "", "no rights here", "CC BY", "cc-by, cc_by cc\nby ccby cc  b", "All rights reserved. ALL RIGHTS reserved",
    "é all rights reservedé all...rights---reserved 1cc by", "GNU General Public License, version 3, or (at your option) any later version",
    "under the GNU General Public License", "* Licensed under the Apache\n * License, Version 2.0 (the License);",
    "Licensed under CC BY-NC 4.0 and cc by-nc-sa 4.0 and CC-BY-SA", "Released under the MIT License. permission is hereby granted, free of charge, to any person obtaining a copy",
    "SPDX-License-Identifier: (GPL-2.0-only OR MIT)", "https://creativecommons.org/licenses/by-sa/4.0/ and www.gnu.org/licenses/gpl-3.0.html",
    "© 2019 Who. Copyright (c) 2001-2003, 2005. Alle Rechte vorbehalten", "all rights reserved " * 700, "gpl " * 500 + "w " * 60_000 + "gplv3",
    "GPL-2.0-or-later gplv2+ LGPLv2.1 agpl", "Dieses Werk steht unter der Creative-Commons-Lizenz", "İ all rights reserved 日本 mit license",
]


def test_rows_equal_brute_force(spark):
    table = rules()
    rows = [(i, t, "x", 0, "y") for i, t in enumerate(TEXTS)] + [(None, "cc by", "x", 0, "y"), (3, TEXTS[3], "x", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, _row int, label string")
    got = license_scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute("cc by" if r.doc_id is None else TEXTS[r.doc_id], table), r
    named = {r.doc_id: r.labels for r in got}
    assert named[7] == "gpl,gpl-3.0-or-later" and named[9] == "apache-2.0"
    assert named[10] == "cc-by,cc-by-nc-4.0,cc-by-nc-sa-4.0,cc-by-sa,licensed"
    assert license_scan(docs.limit(0)).count() == 0


def test_containment_and_ties(spark):
    def rule(order, priority, label, pattern):
        return Rule(order, priority, "name", label, "a", pattern, 0.5)

    table = [rule(0, 1, "ab", "ab"), rule(1, 1, "ab-again", "ab"), rule(2, 2, "abc", "abc"), rule(3, 2, "b", "b"),
             rule(4, 0, "c", "cc"), rule(5, 1, "bcc", "bcc")]
    texts = {1: "ab", 2: "abc", 3: "abcc", 4: "b a", 5: "ab abc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r.labels for r in license_scan(docs, table).collect()}
    assert rows == {k: brute(t, table)[5] for k, t in texts.items()}
    # equal spans: the first rule; a better priority inside a worse one takes nothing away
    assert rows[1] == "ab" and rows[2] == "ab,abc" and rows[3] == "ab,abc,bcc,c"


def test_rule_list():
    table = rules()
    assert len(table) > 300 and [r.order for r in table] == list(range(len(table)))
    assert set(KINDS) == {r.kind for r in table}
    for r in table:
        assert 0 < r.weight < 1 and not re.compile(r.pattern).match("")
