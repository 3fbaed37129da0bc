"""License scans by ordered signature rules.

A rule is a regular expression with a keyword, the license that it names, and a
priority. ``RULES`` holds hand-written expressions: for every license its name,
its SPDX tag, its address and its notice, and sentences of license texts. A text
is read by a rule only if it holds the rule's keyword; texts that hold none of
``GATES``, one of which is in every text that any rule can match, never become
Python strings.

Detections are resolved in order of priority (the lowest number first), then
length (the longest first), start, and order of the rules: one whose interval is
contained in that of an accepted detection is suppressed. Detections that overlap
without containment all stand.

Matching ignores ASCII and Unicode case, and any run of whitespace stands for a
space of a rule, so notices that are wrapped at line ends are found.

Defined results: null and empty texts have no detections, and neither has an
empty table. Each row of a repeated document is reported; a row without ``doc_id``
is reported without it. Offsets count code points; ``stop`` is past the last. A
text of any length is read whole. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm.arrow import map_batches, record

#: SPDX id | expression of the name | further expression of the address (without scheme), or nothing
_NAMES = r"""
MIT | (?:the )?(?:MIT|Expat) license | opensource\.org/licen[sc]es/mit(?:-license)?(?:\.php|\.html)?
MIT-0 | MIT No Attribution(?: license)? | opensource\.org/licen[sc]es/mit-0
Apache-2.0 | Apache(?: Software)? License,? (?:Version |v)?2(?:\.0)? | (?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
Apache-1.1 | Apache(?: Software)? License,? (?:Version |v)?1\.1 | (?:www\.)?apache\.org/licenses/LICENSE-1\.1
Apache-1.0 | Apache(?: Software)? License,? (?:Version |v)?1\.0 | (?:www\.)?apache\.org/licenses/LICENSE-1\.0
GPL-1.0 | GNU General Public License,? (?:as published by the Free Software Foundation[,;] )?(?:either )?(?:version |v)1(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
GPL-2.0 | GNU General Public License,? (?:as published by the Free Software Foundation[,;] )?(?:either )?(?:version |v)2(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-3.0 | GNU General Public License,? (?:as published by the Free Software Foundation[,;] )?(?:either )?(?:version |v)3(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/gpl-3\.0
LGPL-2.0 | GNU Library General Public License,? (?:version |v)2(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
LGPL-2.1 | GNU Lesser General Public License,? (?:version |v)2\.1 | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL-3.0 | GNU Lesser General Public License,? (?:version |v)3(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/lgpl-3\.0
AGPL-1.0 | Affero General Public License,? (?:version |v)1(?:\.0)?(?!\.?\d) | (?:www\.)?affero\.org/oagpl
AGPL-3.0 | (?:GNU )?Affero General Public License,? (?:version |v)3(?:\.0)?(?!\.?\d) | (?:www\.)?gnu\.org/licenses/agpl-3\.0
GFDL-1.1 | GNU Free Documentation License,? (?:version |v)1\.1 | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1
GFDL-1.2 | GNU Free Documentation License,? (?:version |v)1\.2 | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
GFDL-1.3 | GNU Free Documentation License,? (?:version |v)1\.3 | (?:www\.)?gnu\.org/licenses/fdl-1\.3
BSD-4-Clause | (?:4|four)[- ]clause BSD license|(?:original|old)(?: style)? BSD license | directory\.fsf\.org/wiki/license:bsd-4clause
BSD-3-Clause | (?:3|three)[- ]clause BSD license|(?:new|modified|revised) BSD license|BSD[- ]3[- ]clause license | opensource\.org/licen[sc]es/bsd-3-clause
BSD-2-Clause | (?:2|two)[- ]clause BSD license|(?:simplified|FreeBSD) (?:BSD )?license|BSD[- ]2[- ]clause license | opensource\.org/licen[sc]es/bsd-2-clause
0BSD | (?:zero[- ]clause|0[- ]clause) BSD license|BSD zero clause license | opensource\.org/licen[sc]es/0bsd
ISC | ISC license | opensource\.org/licen[sc]es/isc
MPL-1.0 | Mozilla Public License,? (?:version |v)?1\.0 | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/mpl-1\.0
MPL-1.1 | Mozilla Public License,? (?:version |v)?1\.1 | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1
MPL-2.0 | Mozilla Public License,? (?:version |v)?2(?:\.0)? | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0
EPL-1.0 | Eclipse Public License,? ?-? ?(?:version |v)?1\.0 | (?:www\.)?eclipse\.org/legal/epl-v10
EPL-2.0 | Eclipse Public License,? ?-? ?(?:version |v)?2\.0 | (?:www\.)?eclipse\.org/legal/epl-(?:v20|2\.0)
CDDL-1.0 | Common Development and Distribution License(?: \(CDDL\))?,? (?:version |v)?1\.0 | opensource\.org/licen[sc]es/cddl-1\.0
CDDL-1.1 | Common Development and Distribution License(?: \(CDDL\))?,? (?:version |v)?1\.1 | opensource\.org/licen[sc]es/cddl-1\.1
CPL-1.0 | Common Public License,? (?:version |v)?1\.0 | opensource\.org/licen[sc]es/cpl1\.0
IPL-1.0 | IBM Public License,? (?:version |v)?1\.0 | opensource\.org/licen[sc]es/ipl-1\.0
EUPL-1.1 | European Union Public Licen[sc]e,? (?:\(EUPL\) )?(?:version |v)?\.? ?1\.1 | joinup\.ec\.europa\.eu/software/page/eupl/licence-eupl
EUPL-1.2 | European Union Public Licen[sc]e,? (?:\(EUPL\) )?(?:version |v)?\.? ?1\.2 | joinup\.ec\.europa\.eu/collection/eupl
CECILL-2.1 | CeCILL(?: free software)? licen[sc]e(?: agreement)?,? (?:version |v)?2\.1 | (?:www\.)?cecill\.info/licences/licence_cecill_v2\.1
CECILL-B | CeCILL-B(?: free software)? licen[sc]e | (?:www\.)?cecill\.info/licences/licence_cecill-b
CECILL-C | CeCILL-C(?: free software)? licen[sc]e | (?:www\.)?cecill\.info/licences/licence_cecill-c
Artistic-1.0 | Artistic License,? (?:version |v)?1\.0 | opensource\.org/licen[sc]es/artistic-license-1\.0
Artistic-2.0 | Artistic License,? (?:version |v)?2\.0 | opensource\.org/licen[sc]es/artistic-license-2\.0
BSL-1.0 | Boost Software License,? ?-? ?(?:version |v)?1\.0 | (?:www\.)?boost\.org/license_1_0\.txt
Zlib | zlib(?:/libpng)? license | (?:www\.)?zlib\.net/zlib_license
libpng | libpng license | (?:www\.)?libpng\.org/pub/png/src/libpng-license
Unlicense | (?:the )?Unlicense license|released into the public domain under the Unlicense | (?:www\.)?unlicense\.org
WTFPL | do what the fuck you want to public license | (?:www\.)?wtfpl\.net
PSF-2.0 | Python Software Foundation License(?:,? (?:version |v)?2)? | docs\.python\.org/(?:3/)?license
PHP-3.01 | PHP License,? (?:version |v)?3\.01 | (?:www\.)?php\.net/license/3_01
Ruby | Ruby license | (?:www\.)?ruby-lang\.org/en/about/license
OFL-1.1 | SIL Open Font License,? (?:version |v)?1\.1 | scripts\.sil\.org/ofl
OpenSSL | OpenSSL license | (?:www\.)?openssl\.org/source/license
PostgreSQL | PostgreSQL license | (?:www\.)?postgresql\.org/about/licence
W3C | W3C Software (?:Notice and )?License | (?:www\.)?w3\.org/consortium/legal/copyright-software
X11 | X11 license | (?:www\.)?x\.org/docs/license
NCSA | University of Illinois/NCSA Open Source License | opensource\.org/licen[sc]es/ncsa
MS-PL | Microsoft Public License | opensource\.org/licen[sc]es/ms-pl
MS-RL | Microsoft Reciprocal License | opensource\.org/licen[sc]es/ms-rl
OSL-3.0 | Open Software License,? (?:version |v)?3\.0 | opensource\.org/licen[sc]es/osl-3\.0
AFL-3.0 | Academic Free License,? (?:version |v)?3\.0 | opensource\.org/licen[sc]es/afl-3\.0
QPL-1.0 | Q Public License(?:,? (?:version |v)?1\.0)? | opensource\.org/licen[sc]es/qpl-1\.0
UPL-1.0 | Universal Permissive License(?: \(UPL\))?,? (?:version |v)?1\.0 | oss\.oracle\.com/licenses/upl
MulanPSL-2.0 | Mulan Permissive Software License,? (?:version |v)?2 | license\.coscl\.org\.cn/mulanpsl2
SSPL-1.0 | Server Side Public License,? (?:version |v)?1 | (?:www\.)?mongodb\.com/licensing/server-side-public-license
BUSL-1.1 | Business Source License,? (?:version |v)?1\.1 | mariadb\.com/bsl11
Elastic-2.0 | Elastic License,? (?:version |v)?2(?:\.0)? | (?:www\.)?elastic\.co/licensing/elastic-license
ODbL-1.0 | Open (?:Data Commons Open )?Database License(?: \(ODbL\))?,? (?:version |v)?1\.0 | opendatacommons\.org/licenses/odbl
ODC-By-1.0 | Open Data Commons Attribution License,? (?:version |v)?1\.0 | opendatacommons\.org/licenses/by
PDDL-1.0 | Public Domain Dedication (?:and|&) License(?: \(PDDL\))?,? (?:version |v)?1\.0 | opendatacommons\.org/licenses/pddl
OGL-UK-3.0 | Open Government Licen[sc]e,? (?:version |v)?3\.0 | (?:www\.)?nationalarchives\.gov\.uk/doc/open-government-licence/version/3
Vim | Vim license | vimdoc\.sourceforge\.net/htmldoc/uganda
LPPL-1.3c | LaTeX Project Public License,? (?:version |v)?1\.3c? | (?:www\.)?latex-project\.org/lppl
Beerware | beer-?ware license | people\.freebsd\.org/~phk
CC0-1.0 | (?:CC0|Creative Commons Zero)(?: (?:license|v))?,? ?(?:version |v)?1\.0(?: Universal)?(?: license)? | creativecommons\.org/publicdomain/zero/1\.0
CC-PDDC | Creative Commons Public Domain Dedication(?: license)? | creativecommons\.org/licenses/publicdomain
"""
_CC = {"BY": "Attribution", "BY-SA": "Attribution[- ]Share ?Alike", "BY-ND": "Attribution[- ]No ?Deriv(?:ative)?s?(?: Works)?", "BY-NC": "Attribution[- ]Non-?Commercial", "BY-NC-SA": "Attribution[- ]Non-?Commercial[- ]Share ?Alike", "BY-NC-ND": "Attribution[- ]Non-?Commercial[- ]No ?Deriv(?:ative)?s?(?: Works)?"}
#: License | keyword | expression: sentences of license texts and notices
_TEXTS = r"""
MIT | permission | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | permission | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
ISC | permission | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
BSD-2-Clause | redistribution | Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
BSD-2-Clause | redistribution | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-3-Clause | endorse | Neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
BSD-4-Clause | advertising | All advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
Apache-2.0 | apache | you may not use this (?:file|work|software) except in compliance with the License\. You may obtain a copy of the License at https?://www\.apache\.org/licenses/LICENSE-2\.0
GPL-2.0-or-later | gnu | under the terms of the GNU General Public License as published by the Free Software Foundation[,;] either version 2 of the License, or \(at your option\) any later version
GPL-3.0-or-later | gnu | under the terms of the GNU General Public License as published by the Free Software Foundation[,;] either version 3 of the License, or \(at your option\) any later version
LGPL-2.1-or-later | gnu | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[,;] either version 2\.1 of the License, or \(at your option\) any later version
LGPL-3.0-or-later | gnu | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation[,;] either version 3 of the License, or \(at your option\) any later version
AGPL-3.0-or-later | gnu | under the terms of the GNU Affero General Public License as published by the Free Software Foundation[,;] either version 3 of the License, or \(at your option\) any later version
GPL-unversioned | gnu | GNU General Public License
LGPL-unversioned | gnu | GNU (?:Lesser|Library) General Public License
AGPL-unversioned | affero | (?:GNU )?Affero General Public License
GFDL-unversioned | gnu | GNU Free Documentation License
GFDL-1.3 | gnu | Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1\.3
Apache-unversioned | apache | Apache(?: Software)? License
BSD-unversioned | bsd | BSD(?:-style)? license
MPL-2.0 | mozilla | This Source Code Form is subject to the terms of the Mozilla Public License, v\. 2\.0
MPL-unversioned | mozilla | Mozilla Public License
EPL-unversioned | eclipse | Eclipse Public License
CC-unversioned | creative commons | (?:licensed under (?:a |the )?)?Creative Commons(?: licen[sc]e)?
Zlib | altered | Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
BSL-1.0 | boost | Distributed under the Boost Software License, Version 1\.0
Unlicense | public domain | This is free and unencumbered software released into the public domain
WTFPL | wtfpl | (?:licensed|released) under (?:the )?WTFPL
CC0-1.0 | waived | has waived all copyright and related or neighbou?ring rights
OFL-1.1 | font | This Font Software is licensed under the SIL Open Font License
Public-domain | public domain | (?:this work|this software|this document|this text|this file) (?:is|has been placed) in(?:to)? the public domain
Public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
Proprietary | rights reserved | all rights reserved
Proprietary | confidential | proprietary and confidential
Proprietary | without | (?:no part of this|this) (?:work|publication|document|text) may (?:not )?be reproduced .{0,80}?without (?:the )?(?:prior )?(?:written )?permission
Proprietary | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: and (?:copying|reproduction|distribution|use))? (?:of this \w+,? )?is (?:strictly )?prohibited
Proprietary | personal | for personal(?:,| and) non-?commercial use only
Proprietary | license agreement | end[- ]user license agreement
Copyright-notice | (c) | (?:copyright )?\(c\) ?(?:copyright )?\d{4}(?: ?[-–,] ?\d{4})*
Copyright-notice | © | (?:copyright )?© ?(?:copyright )?\d{4}(?: ?[-–,] ?\d{4})*
Copyright-notice | copyright | copyright ?(?:\(c\)|©)? ?\d{4}(?: ?[-–,] ?\d{4})*
Unknown-license | licen | (?:licensed|released|distributed|published|available) under (?:the terms of )?(?:an? |the )?[\w.+-]+ licen[sc]e
"""

_TAG = r"SPDX-License-Identifier: ?\(?"
_IDENTIFIER = r"(?:\(\s*)*[\w+-]+(?:[.:][\w+-]+)*"
#: A tag with its whole expression: identifiers, AND, OR, WITH and brackets.
_EXPRESSION = re.compile(rf"SPDX-License-Identifier:\s*({_IDENTIFIER}(?:[\s)]*\s(?:AND|OR|WITH)\s+{_IDENTIFIER}|[\s)]*\)(?:AND|OR|WITH)\s+{_IDENTIFIER})*)", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    name: str
    license: str
    priority: int
    keyword: str
    pattern: str


def _keyword(pattern: str) -> str:
    """The longest run of literal letters that every match of an expression of one alternative holds, in lower case."""
    flat, depth = "", 0
    for token in re.findall(r"\\.|\[[^\]]*\]\??|\(\?[:!]|\(|\)\??|[^\\\[\]()]", pattern):
        if token.startswith("("):
            depth += 1
            flat += "\0"
        elif token.startswith(")"):
            depth -= 1
        elif depth:
            continue
        elif token.startswith("\\") and token[1] in ".-/":
            flat += token[1]
        elif token == "?":
            flat = flat[:-1] + "\0"
        elif token.startswith("[") or token.startswith("\\") or token in "|{}*+.":
            flat += "\0"
        else:
            flat += token
    return max((p.strip() for p in flat.lower().split("\0")), key=len)


def _rules() -> tuple[Rule, ...]:
    out = []
    add = lambda kind, lic, priority, keyword, pattern: out.append(Rule(f"{kind}:{lic}:{len(out)}", lic, priority, keyword, pattern))
    rows = [[c.strip() for c in re.split(r" \| ", line)] for line in _NAMES.strip().split("\n")]
    texts = [[c.strip() for c in line.split(" | ", 2)] for line in _TEXTS.strip().split("\n")]
    for lic, name, address in rows:
        tag = re.escape(lic)
        if re.match(r"A?L?GPL|GFDL", lic):
            tag += "(?:-only|-or-later|\\+)?"
        add("tag", lic, 10, "spdx-license-identifier", rf"{_TAG}{tag}(?![\w-]|\.\w)")
        add("address", lic, 30, _keyword(address), rf"https?://{address}")
        for alternative in re.split(r"\|(?![^(]*\))", name):
            key = _keyword(alternative)
            add("notice", lic, 20, key, rf"(?:(?:this|the) (?:work|software|program|file|document|text|project|library|package) is )?(?:dual[- ])?(?:licen[sc]ed|released|distributed|published|available|provided|covered) under (?:the terms (?:and conditions )?of )?(?:the |an? )?{alternative}")
            add("name", lic, 40, key, alternative)
    for code, words in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            lic, v = f"CC-{code}-{version}", re.escape(version)
            add("tag", lic, 10, "spdx-license-identifier", rf"{_TAG}{re.escape(lic)}(?![\w-]|\.\w)")
            add("notice", lic, 20, version, rf"(?:(?:this|the) (?:work|text|document|article|content|page) is )?(?:licen[sc]ed|released|published|available) under (?:the |an? )?(?:CC[- ]{code}[- ]{v}|(?:Creative Commons )?{words} {v})(?:[- ]International| Unported| Generic)?(?: licen[sc]e)?")
            add("address", lic, 30, "creativecommons.org", rf"https?://(?:www\.)?creativecommons\.org/licenses/{code.lower()}/{v}")
            add("name", lic, 40, version, rf"(?<![\w-])(?:CC[- ]{code}[- ]{v}(?![\w.]*\w)|Creative Commons {words} {v})")
    for lic, keyword, pattern in texts:
        add("text", lic, 60 if lic.endswith("-unversioned") else 90 if lic in ("Copyright-notice", "Unknown-license", "Proprietary") else 20, keyword, pattern)
    return tuple(out)


RULES: tuple[Rule, ...] = _rules()


def _gates() -> tuple[str, ...]:
    """A word of each rule's keyword, without those that hold another one."""
    words = {"licen" if "licen" in r.keyword else max(r.keyword.split(" "), key=len) for r in RULES}
    return tuple(sorted(w for w in words if not any(v in w for v in words - {w})))


#: One of these, in lower case, is in every text that any rule can match, as keywords are.
GATES = _gates()


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[str, list[tuple[int, Rule, re.Pattern]]]]:
    """The rules by keyword, compiled; a space of a rule is any run of whitespace."""
    by: dict[str, list] = {}
    for n, rule in enumerate(RULES):
        spaced = re.sub(r"(?<!\[-) (?![^\[]*\])\??", lambda m: r"\s*" if m.group(0).endswith("?") else r"\s+", rule.pattern)
        by.setdefault(rule.keyword.split(" ")[0] if " " in rule.keyword else rule.keyword, []).append((n, rule, re.compile(spaced, re.IGNORECASE)))
    return list(by.items())


@lru_cache(maxsize=1)
def _identifiers() -> list[tuple[int, Rule, re.Pattern]]:
    """The tag rules with their identifiers alone."""
    return [(n, rule, re.compile(rule.pattern.removeprefix(_TAG), re.IGNORECASE)) for n, rule in enumerate(RULES) if rule.pattern.startswith(_TAG)]


def expressions(text: str) -> list[tuple[int, int, int, int]]:
    """Priority, start, stop and rule number of every identifier in tags' expressions; a first one is also in its tag's match, which contains it."""
    found = []
    for tag in _EXPRESSION.finditer(text):
        for word in re.finditer(r"[\w+-]+(?:[.:][\w+-]+)*", tag.group(1)):
            at = tag.start(1) + word.start()
            found += [(rule.priority, m.start(), m.end(), n) for n, rule, pattern in _identifiers() if (m := pattern.match(text, at))]
    return found


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The accepted ones of (priority, start, stop, rule number), by start.

    A hit is contained in an accepted one if the furthest stop of those that start
    no later reaches its own; a Fenwick tree over the starts keeps that, so many
    hits in a long text cost little more than sorting them.
    """
    rank = {start: k for k, start in enumerate(sorted({h[1] for h in found}), 1)}
    furthest = [-1] * (len(rank) + 1)
    kept: list[tuple[int, int, int, int]] = []
    for hit in sorted(found, key=lambda h: (h[0], h[1] - h[2], h[1], h[3])):
        k, reach = rank[hit[1]], -1
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach >= hit[2]:
            continue
        kept.append(hit)
        k = rank[hit[1]]
        while k < len(furthest):
            furthest[k] = max(furthest[k], hit[2])
            k += k & -k
    return sorted(kept, key=lambda h: (h[1], h[2], h[3]))


def scan(text: str) -> list[tuple[int, int, int]]:
    """Start, stop and rule number of the accepted detections of a text."""
    low = text.lower()
    found = []
    for keyword, rules in _compiled():
        if keyword in low:
            for n, rule, pattern in rules:
                found += [(rule.priority, m.start(), m.end(), n) for m in pattern.finditer(text)]
    if "spdx-license-identifier" in low:
        found += expressions(text)
    return [(start, stop, n) for _, start, stop, n in resolve(found)]


_OUT = {"doc_id": pa.int64(), "license": pa.string(), "rule": pa.string(), "start": pa.int64(), "stop": pa.int64()}


def detections(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``license``, ``rule``, ``start``, ``stop`` of every accepted detection; a narrow step."""

    gate = "|".join(map(re.escape, GATES))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        # One automaton of all gates over the batch's bytes; the texts that pass become strings.
        batch = batch.filter(pc.match_substring_regex(batch.column(1), gate, ignore_case=True))
        rows = [(doc, RULES[n].license, RULES[n].name, start, stop) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for start, stop, n in scan(text)]
        return record(_OUT, **dict(zip(_OUT, map(list, zip(*rows))))) if rows else None

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where(F.length("text") > 0)
    return map_batches(slim, run, "doc_id bigint, license string, rule string, start bigint, stop bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return detections(spark.read.parquet(f"{sf_dir}/documents.parquet"))
