"""Licence passages against a plain Dice over all templates."""
import re

from llm_tables import docs  # noqa: F401

from forumlens.llm.licenses import TEMPLATES, scan_licenses


def bigrams(text):
    words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), text)).strip().split(" ")
    return set(zip(words, words[1:]))


def plain(rows, templates=TEMPLATES, threshold=0.8):
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        for n, passage in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            own = bigrams(passage)
            scored = []
            for name, body in templates:
                of = bigrams(body)
                dice = 2 * len(own & of) / (len(own) + len(of)) if own or of else 0
                if dice >= threshold:
                    scored.append((-dice, name))
            if scored:
                out.append((key, n, min(scored)[1], round(-min(scored)[0], 9)))
    return out


LONG = TEMPLATES[12][1]
ROWS = [
    (1, "words\nThis work is licensed under the GNU General Public License, version 3.\nmore words"),
    (2, "This work is LICENSED under the GNU General Public License (version 2)!"),
    (3, LONG.replace(", ", ",\n")), (4, LONG + "\n" + "other text " * 3000), (5, None), (6, ""), (7, "one"),
    (8, "All rights reserved.\n\nAll rights reserved."), (8, "All rights reserved."), (None, "Released under the MIT License."),
    (9, "license " * 4000), (10, "All rights of the author are reserved."), (11, "all, rights — reserved é"),
    (12, "Licensed under CC BY-NC 4.0"), (13, "Licensed under CC BY 4.0 or later"),
]


def found(rows):
    return sorted(((r.doc_id, r.line, r.license, round(r.dice, 9)) for r in rows.collect()), key=str)


def test_against_all_templates(spark, docs):
    assert found(scan_licenses(docs(ROWS))) == sorted(plain(ROWS), key=str)
    loose = scan_licenses(docs(ROWS), threshold=0.5)
    assert found(loose) == sorted(plain(ROWS, threshold=0.5), key=str)


def test_own_templates_ties_and_empty(spark, docs):
    same = (("b", "x y z"), ("a", "x y z"))
    assert found(scan_licenses(docs([(1, "X, y; z")]), same)) == [(1, 0, "a", 1.0)]
    assert scan_licenses(docs(ROWS), ()).collect() == []
    assert scan_licenses(docs([])).collect() == []
    clashing = docs(ROWS).withColumnRenamed("n_chars", "line").withColumnRenamed("lang", "license")
    assert found(scan_licenses(clashing)) == sorted(plain(ROWS), key=str)
