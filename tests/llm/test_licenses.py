"""The license scan's filter against no filter, on matches made from every rule."""

import random
from re import _constants as c
from re import _parser

import pytest

from setaudit.llm.license_rules import RULES
from setaudit.llm.licenses import Scanner, resolve

GAPS = [" ", "\n", "  ", "\n * ", "\n# ", "\r\n// ", " \t", " "]
SCANNER = Scanner()


def joined(parts):
    out = [""]
    for p in parts:
        out = [a + b for a in out for b in p]
    return out


def matches(parsed):
    """Texts for each choice that an expression leaves, repeats at their least and one more."""
    parts = []
    for op, a in parsed:
        if op is c.LITERAL:
            parts.append([chr(a)])
        elif op is c.ANY:
            parts.append(["x"])
        elif op is c.IN:
            parts.append(["x"] if a[0][0] is c.NEGATE else [chr(v) if o is c.LITERAL else chr(v[0]) if o is c.RANGE else {c.CATEGORY_DIGIT: "7"}.get(v, " ") for o, v in a])
        elif op is c.BRANCH:
            parts.append([x for b in a[1] for x in matches(b)])
        elif op is c.SUBPATTERN:
            parts.append(matches(a[3]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            parts.append([x for k in sorted({a[0], min(a[1], a[0] + 1)}) for x in joined([matches(a[2])] * k)])
    return joined(parts)


@pytest.mark.parametrize("n", range(len(RULES)))
def test_filter_keeps_every_rule(n):
    name, priority, _, pattern = RULES[n]
    texts, tried = ["SPDX-License-Identifier: " + name] if priority == 90 else matches(_parser.parse(pattern)), 0
    for text in texts:
        for gap in GAPS:
            for t in (text.replace(" ", gap), text.upper().replace(" ", gap), text.replace("s", "ſ").replace(" ", gap)):
                if SCANNER.detections(t, [n]):
                    tried += 1
                    assert n in SCANNER.candidates(t), t
    assert tried


@pytest.mark.parametrize("text, license", [
    ("GNU General\n * Public License, version 2", "GPL-2.0-only"),
    ("# Permission is hereby\n# granted, free of charge, to any person obtaining a copy of this software\n# and associated documentation files", "MIT"),
    ("may not be copied in any form without prior written permission", "Proprietary"),
    ("released under the MIT  Licence", "MIT"),
    ("the CreativeML Open\nRAIL-M licence", "OpenRAIL"),
])
def test_wrapped_keywords(text, license):
    assert license in [d[0] for d in SCANNER.scan(text)]
    assert SCANNER.scan(text) == resolve(SCANNER.detections(text))


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
NOTICES = [
    (GPL, "GPL-3.0-or-later"), (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (LGPL.replace("version 2.1", "version 3"), "LGPL-3.0-or-later"), (AGPL, "AGPL-3.0-or-later"), (BSD, "BSD-3-Clause"),
    ("under the Common Development and Distribution License,\nVersion 1.0", "CDDL-1.0"), ("Common Development and Distribution License\n(CDDL) 1.1", "CDDL-1.1"), ("may not be copied, in whole or\nin part, without prior\nwritten permission", "Proprietary"),
]


@pytest.mark.parametrize("margin", ["", " * ", "# ", "// ", " " * 60 + "* "])
@pytest.mark.parametrize("text, license", NOTICES)
def test_wrapped_notices(text, license, margin):
    text = margin + text.replace("\n", "\n" + margin)
    assert license in [d[0] for d in SCANNER.scan(text)]
    assert SCANNER.scan(text) == resolve(SCANNER.detections(text))


def test_windows_end():
    far = "GNU General Public License " + "word " * 30 + "version 3 of the License, or any later version"
    assert [d[0] for d in SCANNER.scan(far)] == ["GPL"]
    assert [d[0] for d in SCANNER.scan("may not be copied " + " *\n" * 50_000)] == []


def test_ids_far_behind_their_tag():
    line = "SPDX-License-Identifier: " + " OR ".join(f"LicenseRef-{k}" for k in range(60)) + " OR Apache-2.0"
    assert [d[0] for d in Scanner().scan(line + "\nMIT")] == ["Apache-2.0"]
    assert [d[0] for d in Scanner().scan("spdx-license-identifier: (MIT AND BSD-3-Clause). SPDX-License-Identifier: ISC")] == ["MIT", "BSD-3-Clause", "ISC"]


def test_many_detections_in_time():
    import time

    text = "(c) 2020\n" * 100_000
    began = time.time()
    assert len(Scanner().scan(text)) == 100_000 and time.time() - began < 30


def test_resolve_by_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        found = [(rng.choice("ABC"), rng.choice([10, 20, 20, 30]), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 20) for _ in range(rng.randint(0, 14)))]
        strong = lambda d: (-d[1], d[2] - d[3], d[2], d[0])
        every = set(found)
        want = {d for d in every if not any(strong(k) < strong(d) and k[2] <= d[2] and d[3] <= k[3] for k in every)}
        assert set(resolve(found)) == want
