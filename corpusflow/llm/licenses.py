"""License scans by conditional compression, confirmed by exact wording differences.

A text's candidate blocks are the windows of ``WINDOW`` characters around its license cues, ended by their paragraph (a
run of lines with words) and joined where they meet. Each block is compressed alone and with each template as a
zstandard raw dictionary, which ranks the templates by the bytes saved. Every template whose own words (the license's
name and version) occur in the block is aligned with all of its words at once: for each end the start with the fewest
differences, for each start the best end. A part that holds a qualifier of another license (lesser, sharealike, ...) or a
denial is no notice. Ids in license fields (``license: MIT OR Apache-2.0``) are confirmed first, each with its own span,
then notices with their spans, those with fewer differences first, then by the templates' rank, then by place; one that
overlaps a confirmed one is left out. A block reaches WINDOW characters beyond its outermost cues, more than any template
is long, so that no notice is cut.

Defined cases: a null or empty text has no blocks; blocks that no template explains are counted and not confirmed;
repeated rows give repeated results; an empty table gives an empty table; a very long text is scanned whole, in time that
grows with its length; only the id and the text column are read.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CUE = re.compile(r"licen[sc]e|licensed|copyright|spdx|permission is (?:hereby )?granted|permission to use|redistribution|neither the name|creative\s+commons|unencumbered", re.IGNORECASE)
#: A window reaches further from its cue than the longest template is long.
WINDOW = 600
#: Share of the template's and block's words that may differ.
MOST_DIFFERENT = 0.5

#: License id, wording of a notice, header or body, and the words which tell it from others. Fixed values.
WORDINGS: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "bsd 3-clause"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0.", "cc0 1.0"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission granted charge restriction merge sublicense sell"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse promote derived"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public 3"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu lesser general public 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu affero general public 3"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991", "gnu general public 2"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", "gnu general public 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "gnu lesser general public 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", "gnu affero general public 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution-sharealike 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution-noncommercial 4.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", "cc0 1.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache 2.0"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser general public 2.1"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission purpose fee granted provided appear copies"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "permission anyone commercial alter redistribute freely restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1.0"),
)
#: More wordings. Fixed values; those of license families are made below.
WORDINGS += (
    ("BSD-2-Clause", "Released under the BSD 2-Clause License.", "bsd 2-clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions binary reproduce disclaimer materials distribution"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu library general public 2"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991", "gnu library general public 2"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999", "gnu lesser general public 2.1"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2.0"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", "contributor grants perpetual irrevocable derivative works sublicense object"),
)
#: GNU licenses: id without version, the words between GNU and General, the short name, and versions; Creative Commons ones: the
#: short and the long name; and their versions.
GNU = (("GPL", "", "GPL", ("2", "3")), ("LGPL", "Lesser ", "LGPL", ("2", "2.1", "3")), ("AGPL", "Affero ", "AGPL", ("3",)))
COMMONS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def dotted(version: str) -> str:
    return version if "." in version else f"{version}.0"


def family_wordings() -> list[tuple[str, str, str]]:
    """Notices of the GNU licenses by long and short name, and of the Creative Commons ones, in the usual forms."""
    found = []
    for name, middle, short, versions in GNU:
        for v in versions:
            long = f"GNU {middle}General Public License"
            which = f"{name}-{dotted(v)}"
            found.append((which, f"This work is licensed under the {long}, version {v}.", f"gnu {middle}general public {v}"))
            found.append((which, f"Licensed under the {long} v{v} or later", f"gnu {middle}general public v{v}"))
            found.append((which, f"Licensed under the GNU {short} v{v}", f"gnu {short} v{v}"))
            found.append((which, f"Licensed under the GNU {short} version {v}", f"gnu {short} {v}"))
            found.append((which, f"Licensed under the {short}v{v}", f"{short}v{v}"))
    for short, long in COMMONS:
        for v in COMMONS_VERSIONS:
            found.append((f"CC-{short}-{v}", f"Licensed under CC {short} {v}.", f"cc {short} {v}"))
            found.append((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {long} {v} International License.", f"creative commons {long} {v}"))
    return found


#: License ids that files name in a field, and the endings that the GNU ones have there. Fixed values.
NAMED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0")
ENDINGS = ("", "-only", "-or-later", "+")
#: A field with an expression of such ids, as in ``SPDX-License-Identifier: MIT OR Apache-2.0`` or ``license = "MIT"``.
FIELD = re.compile(r"""(?i)\b(?:spdx-license-identifier|licen[sc]e)["']?\s*[:=]\s*["'\[{(]*([a-z0-9][-a-z0-9.+]*(?:["')\]\s]*(?:\b(?:and|or|with)\b|[,/|])["'(\[\s]*[a-z0-9][-a-z0-9.+]*)*)""")


def tag(name: str, shown: str) -> tuple[str, str, str]:
    return name, f"SPDX-License-Identifier: {shown}", f"spdx-license-identifier {shown}"


def named_ids() -> dict[str, str]:
    """License by lower-case id as fields show it."""
    gnu = {f"{name}-{dotted(v)}{e}": f"{name}-{dotted(v)}" for name, _, _, versions in GNU for v in versions for e in ENDINGS}
    commons = {f"CC-{short}-{v}": f"CC-{short}-{v}" for short, _ in COMMONS for v in COMMONS_VERSIONS}
    return {shown.lower(): name for shown, name in ({n: n for n in NAMED} | gnu | commons).items()}


IDS = named_ids()
_known = {(n, w) for n, w, _ in WORDINGS}
TEMPLATES = WORDINGS + tuple(x for x in family_wordings() if x[:2] not in _known) + tuple(tag(n, shown) for shown, n in ((s.upper() if s != "unlicense" else "Unlicense", n) for s, n in IDS.items()) if n == shown or not shown.endswith("+"))

#: Words that make a notice one of another license, or of none, where they stand in it and not in the template. Fixed values.
QUALIFIERS = frozenset(
    ["lesser", "library", "affero", "not", "never", "sharealike", "noncommercial", "noderivatives"]
    + [short.lower() for short, _ in COMMONS[1:]] + [long.lower() for _, long in COMMONS[1:]]
)
DENIALS = frozenset(["not", "never"])
DENIAL_REACH = 80  # characters before a notice
#: Words which, anywhere in a block, tell that a template's wording is part of another license there. Fixed values.
EXCLUDED = {"redistributions binary reproduce disclaimer materials distribution": frozenset(["neither", "endorse"])}

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


#: Lines without a word, which end a paragraph.
_BREAK = re.compile(r"\n[^\w\n]*(?=\n)")
#: Costs are in steps of this; smaller amounts carry the start of the alignment.
_STEP = 1 << 32


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


@functools.cache
def compressors():
    import zstandard

    own = zstandard.ZstdCompressor(level=3)
    with_template = []
    for _, wording, _ in TEMPLATES:
        held = zstandard.ZstdCompressionDict(plain(wording), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        with_template.append(zstandard.ZstdCompressor(level=3, dict_data=held))
    return own, with_template


@functools.cache
def template_words(i: int) -> tuple[list[str], frozenset[str]]:
    """A template's words, and those which tell it from others."""
    return words(TEMPLATES[i][1]), frozenset(words(TEMPLATES[i][2]))


def aligned(places: dict[str, np.ndarray], n_words: int, template: list[str], telling: frozenset[str]) -> list[tuple[int, int, int]]:
    """(differences, first word, end) of the parts of a block that are near to the template: words that they lack and words
    that they add, within the bound, the telling words all there. ``places``: where each word of the block stands."""
    most = int(MOST_DIFFERENT * len(template))
    at = np.arange(n_words + 1, dtype=np.int64)
    cost = -at  # an alignment may start anywhere, at no cost; later starts are the less
    for w in template:
        new = cost + (_STEP * (most + 1) if w in telling else _STEP)
        if w in places:
            j = places[w]
            new[j + 1] = np.minimum(new[j + 1], cost[j])
        cost = np.minimum.accumulate(new - _STEP * at) + _STEP * at
    differences = -(-cost // _STEP)
    end = np.flatnonzero(differences <= most)
    n = differences[end]
    start = n * _STEP - cost[end]
    order = np.lexsort((end, n, start))
    best = order[np.concatenate(([True], start[order][1:] != start[order][:-1]))] if len(order) else order
    return [(d, a, b) for d, a, b in zip(n[best].tolist(), start[best].tolist(), end[best].tolist(), strict=True) if a < b]


def contradicted(low: str, at: list[tuple[int, int]], said: list[str], start: int, end: int, i: int) -> bool:
    """Whether a block denies that its words start to end are a notice of the template, or makes them one of another license.

    A denial counts in the words themselves and in the part of their sentence that stands before them."""
    wording, _ = template_words(i)
    if not EXCLUDED.get(TEMPLATES[i][2], frozenset()).isdisjoint(said):
        return True
    before = re.split(r"[.;!?]\s", low[max(0, at[start][0] - DENIAL_REACH) : at[start][0]])[-1]
    return not DENIALS.isdisjoint(words(before)) or not QUALIFIERS.intersection(said[start:end]) <= set(wording)


def fields(block: str) -> list[tuple[str, int, int]]:
    """(license, start, end) of the known ids in the block's license fields; that of a field's first id begins with the field."""
    found = []
    for m in FIELD.finditer(block):
        start = m.start()
        for x in re.finditer(r"(?i)[a-z0-9][-a-z0-9.+]*", m[1]):
            if (name := IDS.get(x[0].rstrip(".").lower())) is not None:
                at = m.start(1) + x.start()
                found.append((name, at if start is None else start, at + len(x[0].rstrip("."))))
                start = None
    return found


def notices(block: str) -> tuple[tuple[tuple[int, str, int, int], ...], int]:
    """The confirmed notices (differences, license id, start, end) of a block, by start, and the bytes that the best template saves."""
    own, with_template = compressors()
    data = plain(block)
    alone = len(own.compress(data))
    saved = [alone - len(c.compress(data)) for c in with_template]
    ranked = sorted(range(len(TEMPLATES)), key=lambda i: (-saved[i], i))
    low = block.lower()
    if len(low) != len(block):  # some letters become two; keep the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in block)
    at = [m.span() for m in _WORD.finditer(low)]
    said = [low[a:b] for a, b in at]
    listed: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(at):
        listed.setdefault(low[a:b], []).append(i)
    places = {w: np.array(v) for w, v in listed.items()}
    near = []
    for rank, i in enumerate(ranked):
        wording, telling = template_words(i)
        if telling <= places.keys():
            near += [(n, rank, a, b) for n, a, b in aligned(places, len(at), wording, telling) if not contradicted(low, at, said, a, b, i)]
    taken, found = np.zeros(len(at), bool), []
    begins = [a for a, _ in at]
    for name, start, end in fields(block):  # spelled ids, without differences
        a, b = bisect.bisect_right(begins, start) - 1, bisect.bisect_left(begins, end)
        taken[max(a, 0) : b] = True
        found.append((0, name, start, end))
    for n, rank, a, b in sorted(near):
        if not taken[a:b].any():
            taken[a:b] = True
            found.append((n, TEMPLATES[ranked[rank]][0], at[a][0], at[b - 1][1]))
    return tuple(sorted(found, key=lambda x: x[2])), saved[ranked[0]]


#: Blocks of up to so many characters are remembered, since notices repeat from text to text.
REMEMBERED = 4096


@functools.lru_cache(maxsize=20_000)
def remembered(block: str) -> tuple[tuple[tuple[int, str, int, int], ...], int]:
    return notices(block)


def classify(block: str) -> tuple[str, int]:
    """License id of a block's notice with the fewest differences, or an empty string, and the bytes that the best template saves."""
    found, saved = notices(block)
    return (min(found)[1] if found else ""), saved


def blocks(text: str) -> list[tuple[int, int]]:
    """Character ranges of the candidate blocks, in order and apart from each other."""
    found: list[tuple[int, int]] = []
    cues = [m.span() for m in CUE.finditer(text)]
    breaks = [m.span() for m in _BREAK.finditer(text)] if cues else []
    firsts = [a for a, _ in breaks]
    for start, end in cues:
        n = bisect.bisect_right(firsts, start)
        a = breaks[n - 1][1] + 1 if n else 0
        b = breaks[n][0] if n < len(breaks) else len(text)
        a, b = max(a, start - WINDOW), min(max(b, end), end + WINDOW)
        if found and a <= found[-1][1]:
            found[-1] = (min(a, found[-1][0]), max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


COLUMNS = "n_blocks long, n_confirmed long, licenses string, spans string, most_saved long"


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_blocks, n_confirmed (notices), licenses (sorted), spans (license:start:end of each notice), most_saved (bytes)."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                at = blocks(text or "")
                named = [(a, *(remembered if b - a <= REMEMBERED else notices)(text[a:b])) for a, b in at]
                sure = [(n, a + c, a + d) for a, held, _ in named for _, n, c, d in held]
                rows.append((len(at), len(sure), ",".join(sorted({n for n, _, _ in sure})), ",".join(f"{n}:{a}:{b}" for n, a, b in sure), max((s for *_, s in named), default=0)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_blocks", "n_confirmed", "licenses", "spans", "most_saved"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, {COLUMNS}")
