"""License scans and token counts."""

import os

import numpy as np
import pytest

from corpusflow.llm import licenses, tokencounts

from .data import collected, documents, empty, prose, rows


@pytest.mark.parametrize(("text", "name"), [(w, n) for n, w, _ in licenses.TEMPLATES])
def test_templates_name_themselves(text, name):
    assert licenses.classify(text)[0] == name
    assert licenses.classify("* " + text.upper().replace(",", " ,"))[0] in (name, "")


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This program is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 4.", ""),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-XX 4.0.", ""),
        ("Licensed under CC BY 9.0.", ""),
        ("This is licensed under the GNU Lesser General Public License, version 2.", "LGPL-2.0"),
        ("This is licensed under the GNU Library General Public License, version 3.", ""),
        ("Licensed under the GNU GPL v2", "GPL-2.0"),
        ("Licensed under the GPLv3 or any later version", "GPL-3.0"),
        ("GNU General Public License v2 or later is the license here", "GPL-2.0"),
        ("Released under the BSD 2-Clause License", "BSD-2-Clause"),
        ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This is NOT licensed under the GNU General Public License, version 3.", ""),
        ("It was never released under the MIT License", ""),
        ("We do not sell it. Released under the MIT License.", "MIT"),
        ("We have no licence to print money.", ""),
    ],
)
def test_wording_differences_decide(text, name):
    assert licenses.classify(text)[0] == name


def test_blocks_cover_every_cue_of_long_lines():
    text = prose(3000, 1).replace("\n", " ") + " Released under the MIT License. " + prose(3000, 2).replace("\n", " ")
    found = [licenses.classify(text[a:b]) for a, b in licenses.blocks(text)]
    assert len(found) == 1 and len(text) > 30_000


def test_license_query(spark):
    got = {r["doc_id"]: r for r in licenses.license_report(documents(spark)).collect()}
    assert len(collected(licenses.license_report(documents(spark)))) == len(rows())
    named = {i for i, r in got.items() if r["licenses"]}
    assert named == {r[0] for r in rows() if "Apache License" in (r[1] or "")}
    assert licenses.license_report(empty(spark)).count() == 0


GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version. */"""
MIT_BODY = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of Example Inc. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""


BSD_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("License: MIT", [("MIT", "License: MIT")]),
        ('license = "Apache-2.0"', [("Apache-2.0", 'license = "Apache-2.0')]),
        ('"license": "BSD-3-Clause",', [("BSD-3-Clause", 'license": "BSD-3-Clause')]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", [("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "Apache-2.0")]),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND ISC.", [("GPL-2.0", "SPDX-License-Identifier: (GPL-2.0-only"), ("ISC", "ISC")]),
        ("license: [LGPL-2.1+, CC-BY-NC-4.0]", [("LGPL-2.1", "license: [LGPL-2.1+"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0")]),
        ("License: see the file", []),
        (BSD_TWO, [("BSD-2-Clause", BSD_TWO[BSD_TWO.index("Redistributions") : -1])]),
    ],
)
def test_fields_and_clauses(text, found):
    assert scanned(text) == found


def test_two_clauses_of_three_are_no_license_of_their_own():
    assert [n for n, _ in scanned(BSD_TWO + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")] == ["BSD-3-Clause"]


def scanned(text):
    return [(n, text[a + c : a + d]) for a, b in licenses.blocks(text) for _, n, c, d in licenses.notices(text[a:b])[0]]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (GPL.format("", 2), ["GPL-2.0"]),
        (GPL.format("", 3), ["GPL-3.0"]),
        (GPL.format("Lesser ", 3), ["LGPL-3.0"]),
        (GPL.format("Affero ", 3), ["AGPL-3.0"]),
        (GPL.format("", 4), []),
        (MIT_BODY, ["MIT"]),
        (MIT_BODY.upper(), ["MIT"]),
        (BSD_BODY, ["BSD-3-Clause"]),
        (BSD_BODY.split("3.")[0], []),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", ["GPL-3.0"]),
        ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.", ["MPL-2.0"]),
    ],
)
def test_full_texts_and_wrapped_headers(text, names):
    assert [n for n, _ in scanned(text)] == names
    assert [n for n, _ in scanned(prose(900, 3) + "\n" + text + "\n" + prose(900, 4))] == names


def test_every_notice_of_a_block_has_its_span():
    apache, mit, cc = "Licensed under the Apache License, Version 2.0", "Released under the MIT License", "Licensed under CC BY 4.0"
    assert scanned(f"{apache}. {mit}.") == [("Apache-2.0", apache), ("MIT", mit)]
    assert scanned(f"{mit}. {mit}.") == [("MIT", mit)] * 2
    assert scanned(f"{apache}. {mit}. {cc}.".upper()) == [("Apache-2.0", apache.upper()), ("MIT", mit.upper()), ("CC-BY-4.0", cc.upper())]
    assert scanned(f"\u0130\u0130 {mit}.") == [("MIT", mit)]


@pytest.mark.parametrize("gap", range(250, 700, 7))
def test_notices_are_whole_at_window_ends(gap):
    text = "x" * 1500 + " licence " + "y" * gap + " Licensed under CC BY 4.0. " + "z" * 1500
    assert scanned(text) == [("CC-BY-4.0", "Licensed under CC BY 4.0")]


def brute_notices(block):
    """Every part of the block against every template, by plain recursion; the order of taking is that of the docstring."""
    own, with_template = licenses.compressors()
    data = licenses.plain(block)
    saved = [len(own.compress(data)) - len(c.compress(data)) for c in with_template]
    have, near = licenses.words(block), []
    for rank, i in enumerate(sorted(range(len(saved)), key=lambda i: (-saved[i], i))):
        name, wording, telling = licenses.TEMPLATES[i]
        template, needed = licenses.words(wording), set(licenses.words(telling))
        if not needed <= set(have):
            continue
        most, by_end = int(licenses.MOST_DIFFERENT * len(template)), {}
        for a in range(len(have)):
            row = [[0] * (len(have) - a + 1) for _ in range(len(template) + 1)]
            for x in range(len(template) + 1):
                for y in range(len(have) - a + 1):
                    if not x:
                        row[x][y] = y
                        continue
                    cost = [row[x - 1][y] + (most + 1 if template[x - 1] in needed else 1)]
                    if y:
                        cost.append(row[x][y - 1] + 1)
                        if have[a + y - 1] == template[x - 1]:
                            cost.append(row[x - 1][y - 1])
                    row[x][y] = min(cost)
            for y in range(1, len(have) - a + 1):
                if row[-1][y] <= most:
                    by_end[a + y] = min(by_end.get(a + y, (most + 1, 0)), (row[-1][y], -a))
        by_start = {}
        for b, (n, a) in by_end.items():
            by_start[-a] = min(by_start.get(-a, (most + 1, 0)), (n, b))
        no_part = {"redistributions binary reproduce disclaimer materials distribution": {"neither", "endorse"}}.get(telling, set())
        near += [(n, rank, a, b, name) for a, (n, b) in by_start.items() if not set(have[a:b]) & licenses.QUALIFIERS - set(template) and not no_part & set(have)]
    taken, found = set(), []
    at = [m.span() for m in licenses._WORD.finditer(block.lower())]
    for name, start, end in licenses.fields(block):
        a, b = next(i for i, x in enumerate(at) if x[0] >= start), next(i for i, x in enumerate(at) if x[1] >= end) + 1
        near.append((0, -1, a, b, name))
    for n, _, a, b, name in sorted(near):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            found.append((n, name, a, b))
    return sorted(found, key=lambda x: x[2])


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_notices_equal_brute_force(k):
    """Each template with words dropped and added, among other notices and prose."""
    rng = np.random.default_rng(k)
    name, wording, telling = licenses.TEMPLATES[k]
    needed, other = set(licenses.words(telling)), licenses.TEMPLATES[int(rng.integers(0, 12))][1]
    for changes in (0, 6):
        w = wording.split()
        for _ in range(changes):
            at = int(rng.integers(0, len(w) + 1))
            if rng.random() < 0.5:
                w.insert(at, "word")
            elif at < len(w) and not set(licenses.words(w[at])) & needed:
                w.pop(at)
        block = " ".join(["Some", "words", *w, "and", *other.split(), "more."])
        at = [m.span() for m in licenses._WORD.finditer(block.lower())]
        got, _ = licenses.notices(block)
        assert list(got) == [(n, x, at[a][0], at[b - 1][1]) for n, x, a, b in brute_notices(block)]
        if not changes:
            assert name in {x for _, x, *_ in got}


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", ["GPL-3.0"]),
        ("SPDX-License-Identifier: LicenseRef-Own", []),
        ("The files are released under the mit license.", ["MIT"]),
        ("All of it is licensed under cc by 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY 4.0. Released under the MIT License.", ["CC-BY-4.0", "MIT"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ],
)
def test_tags_and_sentences(text, names):
    assert [n for n, _ in scanned(text)] == names


def test_many_notices_of_a_very_long_line():
    """Cues all along: one block, whose notices are all found in time that grows with its length."""
    text = "Released under the MIT License. Licensed under CC BY 4.0. " * 4000
    assert [n for n, _ in scanned(text)] == ["MIT", "CC-BY-4.0"] * 4000


def test_attribution_rules():
    starts, ends = np.array([0, 10, 12]), np.array([10, 12, 20])
    a, b = np.array([0, 7, 11, 16]), np.array([7, 11, 16, 20])  # 7-11 and 11-16 cross
    chosen, crosses = tokencounts.attribute(a, b, starts, ends)
    assert chosen.tolist() == [0, 0, 2, 2] and crosses.tolist() == [False, True, True, False]
    assert tokencounts.attribute(a, b, starts, ends, "first")[0].tolist() == [0, 0, 1, 2]
    assert tokencounts.attribute(np.array([8]), np.array([12]), starts, ends)[0].tolist() == [0]  # a tie: the earlier one
    with pytest.raises(ValueError):
        tokencounts.attribute(a, b, starts, ends, "none")


@pytest.mark.skipif(not os.path.exists(tokencounts.DEFAULT_RANKS), reason="no vocabulary")
def test_token_query_equals_brute_force(spark):
    """The oracle places each token by decoding the pieces one after another."""
    enc, _ = tokencounts.encoding(tokencounts.DEFAULT_RANKS)
    expected = []
    for r in rows():
        data = (r[1] or "").encode()
        bounds, at = [], 0
        for line in data.split(b"\n")[:-1]:
            bounds.append((at, at + len(line) + 1))
            at += len(line) + 1
        if at < len(data):
            bounds.append((at, len(data)))
        counts, crossing, at, line = [0] * len(bounds), 0, 0, 0
        ids = enc.encode_ordinary(r[1]) if r[1] else []
        for t in ids:
            end = at + len(enc.decode_single_token_bytes(t))
            while bounds[line][1] <= at:
                line += 1
            share, last = [], line
            while last < len(bounds) and bounds[last][0] < end:
                share.append(min(bounds[last][1], end) - max(bounds[last][0], at))
                last += 1
            crossing += len(share) > 1
            counts[line + share.index(max(share))] += 1
            at = end
        expected.append((r[0], len(ids), len(bounds), crossing, counts))
    got = tokencounts.token_counts(documents(spark))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert all(r["n_tokens"] == r["heading_tokens"] + r["table_tokens"] + r["blank_tokens"] + r["body_tokens"] for r in got.collect())
    assert tokencounts.token_counts(empty(spark)).count() == 0
