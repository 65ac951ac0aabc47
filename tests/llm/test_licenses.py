import re

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, values
from tideline.llm import licenses
from tideline.llm.common import table


def pairs(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return set(zip(words, words[1:]))


def brute(docs, threshold=0.8):
    known = [(name, pairs(text)) for name, text in licenses.TEMPLATES]
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        for unit in lines + ([text] if len(lines) > 1 else []):
            own = pairs(unit)
            if own:
                dice, _, name = max((2 * len(own & k) / (len(own) + len(k)), -i, n) for i, (n, k) in enumerate(known))
                if dice >= threshold:
                    n, best = out.get((doc_id, name), (0, 0))
                    out[doc_id, name] = (n + 1, max(best, dice))
    return sorted(((d, name, n, best) for (d, name), (n, best) in out.items()), key=repr)


COLUMNS = ("doc_id", "license", "n_units", "best_dice")


def test_edges(spark):
    full = licenses.TEMPLATES[-3][1]
    rows = DOCS + [
        (20, full.upper()), (21, full.replace(" ", "\n")), (22, "x " + full.replace("free", "paid")), (None, "Licensed under CC BY 4.0."),
        (23, "Licensed under CC BY-NC 4.0\nLicensed under CC BY-NC-SA 4.0."), (24, "under the"), (25, "Released under the MIT License " * 3000),
    ]
    assert values(licenses.scan_licenses(docs_frame(spark, rows)), *COLUMNS) == brute(rows)
    assert licenses.scan_licenses(docs_frame(spark, [])).count() == 0


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert values(licenses.scan_licenses(table(spark, SMALL, "documents")), *COLUMNS) == brute(docs)


def test_low_threshold_needs_all_sizes(spark):
    rows = [(i, text[: 40 + 7 * i]) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    assert values(licenses.scan_licenses(docs_frame(spark, rows), 0.3), *COLUMNS) == brute(rows, 0.3)


def test_no_python_and_no_cross_join(spark):
    plan = licenses.scan_licenses(docs_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "InPandas", "Cartesian", "NestedLoop"))


HEADER = (
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
)


def text_named(name):
    return dict(licenses.TEXTS)[name]


def test_whole_texts_and_headers(spark):
    mit = text_named("MIT").replace("<year> <copyright holders>", "2026 Some Body")
    rows = [(1, mit), (2, HEADER), (3, text_named("GPL-3.0")), (4, text_named("BSD-3-Clause")), (5, text_named("Apache-2.0")), (6, text_named("LGPL-2.1"))]
    got = values(licenses.scan_licenses(docs_frame(spark, rows)), *COLUMNS)
    assert got == brute(rows)
    assert {(r[0], r[1]) for r in got} == {(1, "MIT"), (2, "GPL-3.0"), (3, "GPL-3.0"), (4, "BSD-3-Clause"), (5, "Apache-2.0"), (6, "LGPL-2.1")}


def stretches(text, threshold=0.8):
    """Every stretch from a run's first bigram to a run's last, then those no better one overlaps."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    own, hits = list(zip(words, words[1:])), []
    for number, (name, template) in enumerate(licenses.TEMPLATES):
        known = pairs(template)
        most = int((len(re.findall("[a-z0-9]+", template.lower())) - 1) * (2 - threshold) / threshold + 1e-9)
        inside = [p in known for p in own]
        firsts = [i for i, x in enumerate(inside) if x and not (i and inside[i - 1])]
        lasts = [i for i, x in enumerate(inside) if x and not (i + 1 < len(inside) and inside[i + 1])]
        for at in firsts:
            ends = [e for e in lasts if at <= e < at + most]
            scored = [(2 * len(known & (b := set(own[at : e + 1]))) / (len(known) + len(b)), -e) for e in ends]
            if scored and max(scored)[0] >= threshold:
                dice, back = max(scored)
                hits.append((dice, -number, -at, back, name))
    beaten = lambda h: any(-g[2] <= -h[3] and -h[2] <= -g[3] and g[:3] > h[:3] for g in hits)
    return [(h[4], -h[2], -h[3] + h[2] + 2, h[0]) for h in hits if not beaten(h)]


def by_stretches(docs):
    return sorted(((d, *s) for d, text in docs for s in stretches(text)), key=repr)


PLACED = ("doc_id", "license", "at", "n_words", "dice")
PROSE = "Some other words stand here and go on for a while before anything else.\n" * 5


def test_passages_across_lines_and_inside_them(spark):
    mit = text_named("MIT")
    rows = DOCS + [
        (30, "Some other sentence ends here. Released under the MIT License."), (31, PROSE + HEADER + "\n" + PROSE),
        (32, PROSE + mit + PROSE + text_named("ISC") + PROSE), (33, "Released under the MIT License " * 50), (34, "the mit license under the mit " * 9),
        (35, PROSE + "This work is licensed under the\nGNU General Public License, version 2. " + PROSE + HEADER), (35, "Licensed under\nCC BY 4.0. " + PROSE),
        (36, mit[:700] + PROSE), (37, PROSE + text_named("BSD-3-Clause").replace("source", "x y") + PROSE), (37, PROSE + mit.replace("without", "a b c") + PROSE),
    ]
    got = values(licenses.passage_hits(docs_frame(spark, rows)), *PLACED)
    assert got == by_stretches(rows)
    found = {(r[0], r[1]) for r in got}
    assert {(30, "MIT"), (31, "GPL-3.0"), (32, "MIT"), (32, "ISC"), (33, "MIT"), (35, "GPL-2.0"), (35, "GPL-3.0"), (35, "CC-BY-4.0")} <= found
    assert licenses.scan_passages(docs_frame(spark, [])).count() == 0


def test_no_stretch_of_any_size_is_better(spark):
    """All windows of words, not only those between runs."""
    name, template = licenses.NOTICES[0]
    words = "zz this program is licensed under x the gnu affero general license version 3 qq this program is yy".split()
    own, known = list(zip(words, words[1:])), pairs(template)
    best = max(2 * len(known & set(own[i:j])) / (len(known) + len(set(own[i:j]))) for i in range(len(own)) for j in range(i + 1, len(own) + 1))
    got = licenses.passage_hits(docs_frame(spark, [(1, " ".join(words))]), 0.5, [(name, template)]).collect()
    assert max(r.dice for r in got) == best


def test_passages_of_a_whole_text_in_a_longer_one(spark):
    rows = [(1, PROSE + text_named("GPL-2.0") + PROSE), (2, PROSE + text_named("Apache-2.0") + PROSE + "Released under the MIT License.")]
    got = {(r.doc_id, r.license) for r in licenses.passage_hits(docs_frame(spark, rows)).collect()}
    assert got == {(1, "GPL-2.0"), (2, "Apache-2.0"), (2, "MIT")}


def test_passages_have_no_python_and_no_cross_join(spark):
    plan = licenses.scan_passages(docs_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "InPandas", "Cartesian", "NestedLoop"))
