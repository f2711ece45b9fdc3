"""Every name that a license rule takes passes the rule's own keyword gate and is found."""

import itertools
import math
import random
import re
from re import _constants as op, _parser

import regex

from themescope.llm import license_scan
from themescope.llm.license_rules import ANCHORS, FAMILIES, NOTICES, rules


def spelled(parsed):
    """All texts that a small pattern takes; a repeat without a bound is not one of these."""
    parts = []
    for kind, arg in parsed:
        if kind == op.LITERAL:
            parts.append([chr(arg)])
        elif kind == op.IN:
            parts.append([chr(c) for k, x in arg for c in ([x] if k == op.LITERAL else range(x[0], x[1] + 1))])
        elif kind == op.BRANCH:
            parts.append([t for branch in arg[1] for t in spelled(branch)])
        elif kind == op.SUBPATTERN:
            parts.append(spelled(arg[3]))
        elif kind == op.MAX_REPEAT:
            low, high, inner = arg
            parts.append(["".join(x) for n in range(low, high + 1) for x in itertools.product(spelled(inner), repeat=n)])
        else:
            raise ValueError(kind)
    return ["".join(x) for x in itertools.product(*parts)]


def test_names_pass_their_gate():
    for label, keyword, pattern in FAMILIES:
        for name in spelled(_parser.parse(pattern)):
            assert keyword in name.split(), (label, name)
    for label, keyword, _, _, pattern in NOTICES:
        if keyword == "apache":  # other licenses have the sentence too, so it asks for the name besides
            continue
        assert re.search(rf"\b{keyword}\b", pattern), (label, pattern)
        assert any(a in pattern.replace("[cs]", "c") for a in ANCHORS), (label, pattern)


def test_joined_spellings(spark):
    names = {"AGPLv3": "agpl-3.0", "LGPLv2": "lgpl-2.0", "LGPLv2.1": "lgpl-2.1", "LGPLv3": "lgpl-3.0", "MPLv2": "mpl-2.0",
             "MPLv2.0": "mpl-2.0", "gpl2": "gpl-2.0", "gpl3": "gpl-3.0", "GPLv2": "gpl-2.0", "GPLv3.0": "gpl-3.0",
             "agpl3": "agpl-3.0", "lgpl2": "lgpl-2.0", "lgpl2.1": "lgpl-2.1", "lgpl3": "lgpl-3.0", "mpl2": "mpl-2.0",
             "GNU AGPLv3": "agpl-3.0", "FreeBSD": "bsd-2-clause", "0BSD": "bsd-0-clause", "BSD 2-Clause": "bsd-2-clause"}
    texts = [(f, label) for n, label in names.items() for f in (f"The {n} License", f"SPDX-License-Identifier: {n}", f"licensed under the {n}")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(frame).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(texts)} == {t: label for t, label in texts}


#: Texts with the labels that rules must give them.
SEEN = {
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit",
    "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR MPL-2.0": "bsd-3-clause,gpl-2.0,mpl-2.0",
    "GPL-2.0-only": "gpl-2.0",
    "AGPL-3.0-or-later": "agpl-3.0",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "https://opensource.org/licenses/MIT": "mit",
    "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl-2.0",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "http://mozilla.org/MPL/2.0/": "mpl-2.0",
    "our ruby license plates": "",
    "may be copied under the Ruby license": "ruby",
    "see the Ruby license terms": "ruby",
    "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "zlib",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-4-clause",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of":
        "lgpl-2.1",
    "": "", "the license of my car": "",
}


def test_signatures_addresses_and_operands(spark):
    frame = spark.createDataFrame(list(enumerate(SEEN)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(frame).collect()}
    assert {t: got[i] for i, t in enumerate(SEEN)} == SEEN


def plainly(text: str, table) -> tuple[str, float]:
    """Labels and score by every rule on its own, and every pair of detections."""
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    joined, runs = " " + " ".join(found) + " ", []
    for r in table:
        if r.keyword in found:
            runs += [(*m.span(), r) for m in regex.finditer(r.pattern, joined, regex.ASCII) if m.end() > m.start()]
    stand = [(a, b, r) for a, b, r in runs if not any(
        x <= a and b <= y and (q.priority, y - x, -q.rank) > (r.priority, b - a, -r.rank) for x, y, q in runs)]
    weight: dict[str, float] = {}
    for _, _, r in stand:
        weight[r.label] = max(weight.get(r.label, 0), r.weight)
    for phrase, label in license_scan.BASE.items():
        if f" {phrase} " in joined:
            weight[label] = max(weight.get(label, 0), 0.8)
    return ",".join(sorted(weight)), round(1 - math.prod(1 - w for w in weight.values()), 6)


def test_suppression_and_score_against_every_pair(spark):
    draw = random.Random(5)
    names = [draw.choice(spelled(_parser.parse(p))) for _, _, p in FAMILIES]
    frames = ["the {} license", "licensed under the {}", "SPDX-License-Identifier: {}", "SPDX-License-Identifier: {} OR {}",
              "see the {} license file", "https://spdx.org/licenses/{}.html", "released under the terms of the {} or any later version",
              "All rights reserved.", "under the MIT license", "cc by nc", "a word", "Wörter"]
    texts = list(SEEN) + [" ".join(
        f.format(*draw.choices(names, k=2)) for f in draw.choices(frames, k=draw.randint(1, 6))) for _ in range(250)]
    texts += [texts[-1], texts[-1]]
    frame = spark.createDataFrame([(None if i % 50 == 0 else i % 200, i, t, "x") for i, t in enumerate(texts)],
                                  "doc_id long, labels long, text string, score string")
    got = sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in license_scan.license_scan(frame).collect())
    table = rules()
    want = sorted((0 if i % 50 == 0 else i % 200, *plainly(t, table)) for i, t in enumerate(texts))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))  # the last digit depends on the order of a product
