"""License notices that prefilters once lost."""

import itertools
import re._constants as sre
import re._parser as parser

import pytest

from glyphwell.llm import licenses


def unfiltered(text):
    """Every rule over the text, without keywords, and suppression."""
    rules = [(n, rule, pattern) for _, some in licenses._compiled() for n, rule, pattern in some]
    return [(a, b, n) for _, a, b, n in licenses.resolve([(r.priority, m.start(), m.end(), n) for n, r, p in rules for m in p.finditer(text)])]


@pytest.mark.parametrize("text", ["(c) 2015 Jane Doe", "\u00a9 2019 Acme", "(C)1999, 2001", "\u00a9\n2001-2004", "Copyright (c) 2015", "copyright \u00a9 2015", "Copyright 2015", "(c) copyright 2015"])
def test_copyright_notices_without_the_word(spark, text):
    found = licenses.scan(text)
    assert found == unfiltered(text)
    assert [licenses.RULES[n].license for *_, n in found] == ["Copyright-notice"]
    docs = spark.createDataFrame([(1, f"Before. {text}. After.")], "doc_id bigint, text string")
    assert [r.license for r in licenses.detections(docs).collect()] == ["Copyright-notice"]


def least_matches(parsed):
    """Texts of a parsed expression with the fewest repeats, one for each choice of alternatives."""
    parts = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.IN:
            parts.append(["1" if kind is sre.CATEGORY and what is sre.CATEGORY_DIGIT else " " if kind is sre.CATEGORY and what is sre.CATEGORY_SPACE else chr(what) if kind is sre.LITERAL else "x" for kind, what in arg])
        elif op is sre.ANY:
            parts.append(["x"])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            parts.append([t * arg[0] for t in least_matches(arg[2])] if arg[0] else [""])
        elif op is sre.SUBPATTERN:
            parts.append(least_matches(arg[3]))
        elif op is sre.BRANCH:
            parts.append([t for some in arg[1] for t in least_matches(some)])
        else:
            assert op in (sre.ASSERT, sre.ASSERT_NOT), op
    return list(dict.fromkeys("".join(x) for x in itertools.product(*parts)))


def test_every_rule_passes_gate_and_keyword(spark):
    texts = []
    for keyword, rules in licenses._compiled():
        for n, rule, pattern in rules:
            some = [t for t in least_matches(parser.parse(pattern.pattern, pattern.flags)) if pattern.fullmatch(t)]
            assert some, rule
            for t in some:
                assert keyword in t.lower(), (rule, t)
                assert any(g in t.lower() for g in licenses.GATES), (rule, t)
            texts.append(some[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in licenses.detections(docs).select("doc_id").collect()} == set(range(len(licenses.RULES)))


@pytest.mark.parametrize("text,license", {
    "https://scripts.sil.org/ofl": "OFL-1.1",
    "https://www.latex-project.org/lppl": "LPPL-1.3c",
    "https://mariadb.com/bsl11": "BUSL-1.1",
    "http://vimdoc.sourceforge.net/htmldoc/uganda": "Vim",
    "released under Attribution-ShareAlike 3.0": "CC-BY-SA-3.0",
    "published under Attribution 4.0": "CC-BY-4.0",
}.items())
def test_only_signal_of_a_document(spark, text, license):
    docs = spark.createDataFrame([(1, f"Before. {text} after.")], "doc_id bigint, text string")
    assert [r.license for r in licenses.detections(docs).collect()] == [license]


@pytest.mark.parametrize("expression,names", {
    "MIT": ["MIT"],
    "MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "(GPL-2.0-only AND BSD-3-Clause).": ["GPL-2.0", "BSD-3-Clause"],
    "((MIT OR ISC) AND (Zlib OR CC-BY-4.0)) and more": ["MIT", "ISC", "Zlib", "CC-BY-4.0"],
    "GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT-0": ["GPL-2.0", "MIT-0"],
    "LicenseRef-Acme OR MIT": ["MIT"],
    "MIT, or ISC": ["MIT"],
    "MIT ORISC": ["MIT"],
}.items())
def test_every_identifier_of_an_expression(expression, names):
    assert [licenses.RULES[n].license for *_, n in licenses.scan(f"// SPDX-License-Identifier: {expression}\ncode")] == names
