import re
import textwrap

import pytest

from pitwright.llm import license, queries

GNU_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."


def gnu(name, version, program="This program"):
    return f"{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\n{GNU_TAIL}"


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 1990, Someone Else. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAME = "\n3. Neither the name of Some Institute, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
WHOLE = [
    ("mit", MIT),
    ("bsd-2-clause", BSD),
    ("bsd-3-clause", BSD + BSD_NAME),
    ("apache-2.0", APACHE),
    ("gpl-2.0-or-later", gnu("General Public License", "2")),
    ("gpl-3.0-or-later", gnu("General Public License", "3", "Frobnicator 2")),
    ("lgpl-2.1-or-later", gnu("Lesser General Public License", "2.1", "This library")),
    ("lgpl-3.0-or-later", gnu("Lesser General Public License", "3")),
    ("agpl-3.0-or-later", gnu("Affero General Public License", "3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", ISC),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, Some Body has waived all copyright and related or neighboring rights to This Work."),
    ("cc-by-nc-sa-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n"),
]


def wrapped(text, sign="", width=60):
    return "\n".join("\n".join(sign + line for line in textwrap.wrap(p, width)) or sign.rstrip() for p in text.split("\n") if True)


def sentences(text):
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    lines = re.sub(license.BEFORE, r"\1", lines)
    lines = re.sub(license.AFTER.replace(r"\z", r"\Z"), r"\1", lines)
    lines = re.sub(license.SHORT, r"\1\2", lines)
    by_line = re.split(r"\n+", re.sub(r"([.!?])[ \t]+", r"\1\n", lines))
    blocks = [b.replace("-\n", "-").replace("\n", " ") for b in re.split(r"\n\n+|(?<=:)\n", lines)]
    return [s for b in blocks for s in re.split(r"(?<=[.!?])[ \t]+", b)], by_line


def ids_of(sentences):
    out = []
    for s in sentences:
        s = license.plain_normalise(s)
        if s.startswith(license.SPDX):
            own = re.split(" (?:or|and) ", re.sub(r" with [^ ]+", "", s[len(license.SPDX) :]))
            out += [license.SENTENCES.get(license.SPDX + o) for o in own]
        else:
            out.append(license.SENTENCES.get(s))
    return [i for i in out if i]


def plain_scan(text):
    readings = [ids_of(r) for r in sentences(text)]
    found = []
    for n, r in enumerate(license.RULES):
        loose, seq = [], []
        for p in r.sequence:
            if p == "...":
                loose.append(len(seq))
            else:
                seq.append(p)

        def match(ids, i, k):
            if k == len(seq):
                return True
            places = range(i, len(ids)) if k in loose else [i]
            return any(j < len(ids) and ids[j] == seq[k] and match(ids, j + 1, k + 1) for j in places)

        if any(match(ids, i, 0) for ids in readings for i in range(len(ids))):
            found.append((n, r))
    names = {r.license for _, r in found} - {x for _, r in found for x in r.instead}
    if len(names) > 1:
        names -= {r.license for r in license.RULES if r.instead == ("*",)}
    return ",".join(sorted(names)), ",".join(readings[0]), ",".join(readings[1]), ",".join(str(n) for n, _ in found)


def test_query_equals_brute_force(spark, sample):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    rows = queries.op5_license_scan(spark, sample).collect()
    assert {r.doc_id: (r.licenses, r.paragraph_ids, r.line_ids, r.rules) for r in rows} == {d: plain_scan(t) for d, t in text.items()}
    assert any(r.licenses for r in rows)


def scanned(spark, texts):
    return [(r.text, r.licenses, (",".join(r.licenses), ",".join(x.id for x in r.paragraph_sentences), ",".join(x.id for x in r.line_sentences), ",".join(map(str, r.rules)))) for r in license.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]


def test_wrapped_and_commented_licences(spark):
    cases = []
    for name, text in WHOLE:
        for sign in ("", "# ", " * ", "// ", "-- ", "  "):
            for width in (50, 72, 10_000):
                cases.append((name, wrapped(text, sign, width)))
        cases.append((name, "/*\n" + wrapped(text, " * ") + "\n */\nint main() { return 0; }"))
        cases.append((name, wrapped(text, "# ").replace("\n", "\r\n")))
    for (name, _), (text, licenses, whole) in zip(cases, scanned(spark, [t for _, t in cases])):
        assert licenses == [name], text
        assert whole == plain_scan(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: Apache-2.0", ["apache-2.0"]),
        ("# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)", ["gpl-2.0", "mit"]),
        ("SPDX-License-Identifier: GPL-3.0+", ["gpl-3.0-or-later"]),
        ("Some words.\nReleased under the MIT License.\nAll rights reserved.", ["mit"]),
        ("All rights reserved.", ["proprietary"]),
        ("Copyright 2001 Someone. All rights reserved.", ["proprietary"]),
        ("the licence of nothing", []),
        ("x " * 50_000 + "\nLicensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("Our dataset is distributed under the terms of the GNU Affero General Public License, version 3.", ["agpl-3.0"]),
        ("Licensed under the GNU Lesser General Public License, version 2.1, or (at your option) any later version.", ["lgpl-2.1-or-later"]),
        ("Permission is hereby granted to leave.", []),
    ],
)
def test_notices(spark, text, want):
    [(_, licenses, whole)] = scanned(spark, [text])
    assert licenses == want and whole == plain_scan(text)


def test_odd_rows(spark, odd, empty):
    assert license.scan(odd).where("size(licenses) > 0").count() == 0 and license.scan(odd).count() == odd.count()
    assert license.scan(empty).count() == 0
    clash = spark.createDataFrame([("Released under the MIT License.", 1, 2, 3, 4)], "text string, __ids int, __MATCHED int, __cleaned int, rules int")
    [row] = license.scan(clash).collect()
    assert (row["__ids"], row["__MATCHED"], row["__cleaned"], row.licenses) == (1, 2, 3, ["mit"]) and row.rules != 4


def test_every_sentence_of_the_table_is_found(spark):
    found = scanned(spark, list(license.SENTENCES))
    assert len(found) == len(license.SENTENCES)
    for text, _, whole in found:
        own = license.SENTENCES[text]
        assert whole == plain_scan(text) and whole[1] == whole[2] == own, text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under MIT.", ["mit"]),
        ("x y z. This library is distributed under GPLv3. x", ["gpl-3.0"]),
        ("Some words.\n# Published under CC BY 4.0.\nx", ["cc-by-4.0"]),
        ("/* This is free and unencumbered software released into the public\n * domain. */", ["unlicense"]),
        ("All rights\nreserved.", ["proprietary"]),
        ("Released under the beautiful MIT.", []),
    ],
)
def test_notices_without_the_word_licence(spark, text, want):
    [(_, licenses, whole)] = scanned(spark, [text])
    assert licenses == want and whole == plain_scan(text)


def test_long_runs(spark):
    header = APACHE.split(" You may obtain")[0]
    texts = [f"Released under MIT.\n{run * 1_000_000}y" for run in (" ", "*", ".", "-", "word ")] + [(header + "\n\n") * 20_000, (header + "\n\n") * 20_000 + "You may obtain a copy of the License at:\n"]
    assert [licenses for _, licenses, _ in scanned(spark, texts)] == [["mit"]] * 5 + [["apache-2.0"]] * 2


def test_sequences_with_others_between(spark):
    [a, b] = [s for s, i in license.SENTENCES.items() if i in ("zlib-warranty", "zlib-grant")]
    other = "Version 2.0, January 2004"
    texts = ["\n\n".join(t) for t in ((a, b), (a, other, other, b), (b, other, a), (b, a, other, a, b), (a, other), (b, b))]
    for (text, _, whole), zlib in zip(scanned(spark, texts), (True, True, False, True, False, False)):
        assert whole == plain_scan(text) and (whole[0] == "zlib") == zlib, text
