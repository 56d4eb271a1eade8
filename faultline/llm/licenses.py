"""License scan by conditional compression.

Sentences that bear on licensing are joined into candidate blocks. A block is compressed by zstandard alone and with each
template as raw dictionary; templates are ranked by how much smaller the block becomes. The best ones are then compared word by
word: a template is confirmed when nearly all its words are in the block in order and no version or variant word differs. The
words missing and added are returned.

Edge cases: null or blank texts, and texts without a candidate, give no rows. Each block gives one row, with a null license if
no template is confirmed. Ties in rank go to the template that sorts first. Repeated rows give their rows each. Other columns
are dropped. A text is scanned whole; a block has no upper length.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from faultline.llm.common import pieces
from faultline.session import ship_package

#: Public license notices and texts (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A sentence with one of these is part of a candidate block.
_CUE = regex.compile(
    rb"(?i)licen[sc]e|copyright|\(c\) ?\d{4}|creative commons|\bcc[ -]?(?:by|0)\b|free software|public domain|permission (?:is|to)|redistribut|warrant(?:y|ies)|hereby granted|all rights reserved"
)
_SENTENCE = regex.compile(r"(?:[^.!?\n]|[.!?](?!\s|$))+(?:[.!?]+|(?=\n)|$)")
_WORD = regex.compile(r"\w+(?:[.\-]\w+)*")
#: Words in which licenses differ although little else does.
_TELLING = frozenset("nc sa nd by-nc by-sa by-nd by-nc-sa by-nc-nd noncommercial sharealike noderivatives lesser library affero attribution attribution-noncommercial attribution-sharealike 2-clause 3-clause bsd mit apache mozilla boost isc".split())
#: Templates looked at word by word, the share of their words a block needs, and sentences a block may skip.
BEST, SHARE, GAP = 3, 0.85, 1


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _size(text: str, dictionary: zstandard.ZstdCompressionDict | None) -> int:
    settings = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, write_dict_id=0)
    return len(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary).compress(text.encode()))


@cache
def _dictionaries() -> list[tuple[str, zstandard.ZstdCompressionDict, list[str]]]:
    made = []
    for name, text in sorted(TEMPLATES.items()):
        raw = zstandard.ZstdCompressionDict(_plain(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, raw, _WORD.findall(_plain(text))))
    return made


def _telling(words: list[str]) -> set[str]:
    return {w for w in words if w in _TELLING or any(c.isdigit() for c in w)}


@lru_cache(maxsize=4096)
def _remembered(block: str) -> tuple[str | None, float, bool, str, str]:
    return _judged(block)


def judged(block: str) -> tuple[str | None, float, bool, str, str]:
    """Notices repeat in millions of documents; long blocks are not kept."""
    return _remembered(block) if len(block) <= 2000 else _judged(block)


def _judged(block: str) -> tuple[str | None, float, bool, str, str]:
    """(license, size reduction, exact, words missing, words added) of one block."""
    text = _plain(block)
    alone = _size(text, None)
    ranked = sorted(((1 - _size(text, raw) / alone, name, words) for name, raw, words in _dictionaries()), key=lambda r: (-r[0], r[1]))
    words = _WORD.findall(text)
    best = None
    for gain, name, template in ranked[:BEST]:
        matches = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        if not matches:
            continue
        missing, added, a, b = [], [], 0, matches[0].b
        for m in matches:
            missing += template[a : m.a]
            added += words[b : m.b]
            a, b = m.a + m.size, m.b + m.size
        missing += template[a:]
        share = 1 - len(missing) / len(template)
        if share >= SHARE and not _telling(missing) and not _telling(added):
            found = (share, gain, name, not missing and not added, " ".join(missing), " ".join(added))
            if best is None or found[:2] > best[:2]:
                best = found
    if best is None:
        return None, ranked[0][0], False, "", ""
    return best[2].removesuffix("-notice").removesuffix("-text"), best[1], best[3], best[4], best[5]


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start, block): sentences with a cue, and those between two of them that are at most GAP + 1 apart."""
    start = end = None
    skipped = 0
    for found in _SENTENCE.finditer(text):
        if _CUE.search(found[0].encode()):
            if start is None or skipped > GAP:
                if start is not None:
                    yield start, text[start:end]
                start = found.start() + len(found[0]) - len(found[0].lstrip())
            end, skipped = found.end(), 0
        else:
            skipped += 1
    if start is not None:
        yield start, text[start:end]


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, block, license, reduction, exact, missing, added) of every candidate block; start counts code points."""
    ship_package(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            raw = batch.column(text).cast(pa.large_binary())
            rows, found = [], []
            for i, value in enumerate(raw):
                data = value.as_py()
                if data and _CUE.search(data):
                    for start, block in blocks(data.decode("utf-8", "replace")):
                        rows.append(i)
                        found.append((start, block, *judged(block)))
            columns = list(zip(*found)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "start", "block", "license", "reduction", "exact", "missing", "added"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(scan, f"doc_id {kind}, start long, block string, license string, reduction double, exact boolean, missing string, added string")
