"""Licence scans by sentence rules.

A text's sentences are normalised and looked up in a table of known licence sentences; the identifiers that are found,
in order of the text, are matched against ordered rules, each a sequence of identifiers that must follow one another
(other known sentences may stand between only where a rule says so). Every sentence of every text is normalised and
looked up; none is passed over by its words. All is DataFrame expressions on one row, without a shuffle.

A text is read twice. By lines: sentences end at line breaks too, so notices on a line of their own are found. By
paragraphs: comment signs are taken off each line and the lines between two blank ones are joined, so sentences that
are wrapped over lines are found. A rule matches within one reading. Sentences end at . ! ? before white space, and at
a colon that ends a line.

Normalising lower-cases, takes any run of other than letters, digits, dots, plus signs and hyphens as one space, drops
dots and hyphens around words, and brings the parts that vary (names of holders and programs, verbs of notices) to one
wording (TEMPLATES). A null or empty text has no sentences; repeated sentences count each time. "All rights reserved"
alone is `proprietary`; beside any licence it says nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Wordings that vary, after normalising, and what they become, in this order. Written for Java, Python and RE2 alike.
TEMPLATES = (
    (r"^[0-9]+ ", ""),
    (r"^(?:this|the|these|all|our|its) (?:work|works|program|software|file|files|project|code|source code|library|package|document|documentation|text|content|contents|module|repository|material|data|dataset|article|page|site) (?:is|are) ", ""),
    (r"^(?:dual |dual-)?(?:licensed|released|distributed|published|available|made available|provided|offered|issued) under ", "under "),
    (r"^under (?:the terms of |the terms and conditions of )?(?:the |an |a )?", "under "),
    (r"^copyright .*all rights reserved$", "all rights reserved"),
    (r"^neither the names? of .* nor the names of .*contributors may be used", "neither the name of the holder nor the names of its contributors may be used"),
    (r"^in no event shall .* be liable for any", "in no event shall the holders be liable for any"),
    (r"^provided by .* as is and any express", "provided by the holders as is and any express"),
    (r"^.* is free software you can redistribute it", "free software you can redistribute it"),
    (r"^all advertising materials mentioning features or use of this software must display the following acknowledg.*$", "all advertising materials must display the following acknowledgement"),
    (r"^to the extent possible under law .* waived all copyright and related or neighboring rights.*$", "to the extent possible under law all copyright and related or neighboring rights are waived"),
)


def plain_normalise(sentence: str) -> str:
    """words() and worded() of one sentence, for the table, in Python."""
    s = re.sub(r"[^a-z0-9.+\-]+", " ", sentence.lower())
    s = re.sub(r"(^| )[.\-]+", r"\1", s)
    s = re.sub(r"[.\-]+( |$)", r"\1", s)
    s = re.sub(r" +", " ", s).strip(" ")
    for pattern, to in TEMPLATES:
        s = re.sub(pattern, to, s)
    return s


#: Names by which notices call a licence ("licensed under NAME"). Names of public licences.
NAMES = {
    "mit": ("MIT License", "MIT", "Expat License", "MIT/X11 License"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache-2.0 License", "Apache License, Version 2.0 (the License)"),
    "bsd-2-clause": ("BSD 2-Clause License", "BSD-2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "isc": ("ISC License", "ISC"),
    "mpl-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "epl-1.0": ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "EPL-1.0"),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "zlib": ("zlib License", "zlib/libpng License"),
    "unlicense": ("Unlicense", "Unlicense License"),
    "cc0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0-1.0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "wtfpl": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "ofl-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"),
}
#: The GNU licences: short name, name, versions.
GNU = (("gpl", "General Public License", ("2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("agpl", "Affero General Public License", ("3",)))
#: Elements of the Creative Commons licences, and their versions with the words that follow the number.
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))

#: Sentences of licence texts and headers. The wording of public licences.
TEXTS = {
    "mit-title": ("The MIT License", "MIT License", "The MIT License (MIT)"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice-clause": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    "mit-warranty": ('The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',),
    "mit-liability": ("In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",),
    "apache-2-title": ("Apache License Version 2.0, January 2004",),
    "apache-title": ("Apache License",),
    "version-2.0-january-2004": ("Version 2.0, January 2004",),
    "apache-2-header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',),
    "apache-2-compliance": ("You may not use this file except in compliance with the License.",),
    "apache-2-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-2-basis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "apache-2-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source-clause": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary-clause": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-advertising-clause": ("All advertising materials must display the following acknowledgement",),
    "bsd-name-clause": ("Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd-warranty": ('This software is provided by the holders "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "unlicense-release": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-grant": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "mpl-2-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "bsl-1-grant": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',),
    "cc0-waiver": ("To the extent possible under law all copyright and related or neighboring rights are waived",),
    "cc0-dedication": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",),
    "cc0-title": ("CC0 1.0 Universal",),
    "wtfpl-copying": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "epl-2-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "mpl-2-title": ("Mozilla Public License Version 2.0",),
    "all-rights-reserved": ("All rights reserved.",),
}


@dataclass(frozen=True)
class LicenseRule:
    """sequence: identifiers that follow one another; `...` lets known sentences stand between two of them. instead: the
    licences that are left out where this rule matches; `*`: this one is left out beside any other."""

    license: str
    sequence: tuple[str, ...]
    instead: tuple[str, ...] = ()


def _tables() -> tuple[dict[str, str], tuple[LicenseRule, ...]]:
    """The sentences' identifiers, and the rules: those of texts and headers, then notices, SPDX lines and titles."""
    sentences = {plain_normalise(s): i for i, own in TEXTS.items() for s in own}
    rules = [
        LicenseRule("mit", ("mit-grant", "mit-notice-clause", "mit-warranty", "mit-liability")),
        LicenseRule("mit", ("mit-grant", "mit-notice-clause")),
        LicenseRule("apache-2.0", ("apache-2-header", "...", "apache-2-copy")),
        LicenseRule("apache-2.0", ("apache-2-header",)),
        LicenseRule("apache-2.0", ("apache-2-title",)),
        LicenseRule("apache-2.0", ("apache-title", "version-2.0-january-2004")),
        LicenseRule("bsd-4-clause", ("bsd-source-clause", "bsd-binary-clause", "bsd-advertising-clause"), ("bsd-2-clause",)),
        LicenseRule("bsd-3-clause", ("bsd-source-clause", "bsd-binary-clause", "bsd-name-clause"), ("bsd-2-clause",)),
        LicenseRule("bsd-2-clause", ("bsd-source-clause", "bsd-binary-clause")),
        LicenseRule("isc", ("isc-grant",)),
        LicenseRule("0bsd", ("0bsd-grant",)),
        LicenseRule("unlicense", ("unlicense-release",)),
        LicenseRule("mpl-2.0", ("mpl-2-header",)),
        LicenseRule("mpl-2.0", ("mpl-2-title",)),
        LicenseRule("zlib", ("zlib-warranty", "...", "zlib-grant")),
        LicenseRule("bsl-1.0", ("bsl-1-grant",)),
        LicenseRule("cc0-1.0", ("cc0-waiver",)),
        LicenseRule("cc0-1.0", ("cc0-dedication",)),
        LicenseRule("cc0-1.0", ("cc0-title",)),
        LicenseRule("wtfpl", ("wtfpl-copying",)),
        LicenseRule("epl-2.0", ("epl-2-header",)),
    ]

    def known(sentence: str, identifier: str) -> None:
        sentences.setdefault(plain_normalise(sentence), identifier)

    names = {license: list(own) for license, own in NAMES.items()}
    spdx = {license: [license] for license in [*NAMES, "0bsd", "bsd-4-clause"]}
    free = "This program is free software: you can redistribute it and/or modify it under the terms of"
    by = "as published by the Free Software Foundation"
    for short, name, versions in GNU:
        for v in versions:
            number = v if "." in v else f"{v}.0"
            only, later = f"{short}-{number}", f"{short}-{number}-or-later"
            called = [f"GNU {name}, version {v}", f"GNU {name} version {number}", f"GNU {name} v{v}", f"GNU {name} v{number}", f"GNU {short} v{v}", f"GNU {short} version {v}", f"GNU {short}v{v}", f"{short}v{v}", f"{short} v{v}", f"{short} {number}", f"{short}-{number}", f"{short} version {v}"]
            names[only] = list(dict.fromkeys(called))
            names[later] = [f"{c}{tail}" for c in called for tail in (" or later", ", or (at your option) any later version", "+")]
            spdx[only], spdx[later] = [only, f"{only}-only"], [later, f"{only}+"]
            grant, later_grant = f"{only}-grant", f"{later}-grant"
            known(f"{free} the GNU {name} {by}, either version {v} of the License, or (at your option) any later version.", later_grant)
            for s in (f"{free} the GNU {name} version {v} {by}.", f"{free} the GNU {name} {by}, version {v}.", f"{free} the GNU {name} {by}; version {v} of the License.", f"{free} version {v} of the GNU {name} {by}.", f"{free} the GNU {name}, version {v}, {by}."):
                known(s, grant)
            rules += [LicenseRule(later, (later_grant,), (only,)), LicenseRule(only, (grant,))]
            title = f"{short}-title"
            known(f"GNU {name}", title)
            dates = {"gpl-2.0": "June 1991", "gpl-3.0": "29 June 2007", "lgpl-2.1": "February 1999", "lgpl-3.0": "29 June 2007", "agpl-3.0": "19 November 2007"}
            known(f"Version {v}, {dates[only]}", f"version-{v}-{plain_normalise(dates[only]).replace(' ', '-')}")
            known(f"GNU {name} Version {v}, {dates[only]}", f"{only}-title")
            rules += [LicenseRule(only, (title, f"version-{v}-{plain_normalise(dates[only]).replace(' ', '-')}")), LicenseRule(only, (f"{only}-title",))]
    for code, words in CC.items():
        for version, tail in CC_VERSIONS:
            license = f"cc-{code}-{version}"
            whole = f"Creative Commons {words} {version}"
            names[license] = [f"CC {code} {version}", f"CC-{code}-{version}", f"CC {code} {version} License", whole, f"{whole} License", f"{whole} {tail}", f"{whole} {tail} License", f"{whole} {tail} Public License", f"{whole} {tail} (CC {code} {version})", f"{whole} {tail} License (CC {code} {version})"]
            spdx[license] = [license]
    for license, called in names.items():
        later = (license.removesuffix("-or-later"),) if license.endswith("-or-later") else ()
        for name in called:
            known(f"Licensed under the {name}.", f"{license}-notice")
        for name in spdx.get(license, ()):
            known(f"SPDX-License-Identifier: {name}", f"{license}-spdx")
        rules += [LicenseRule(license, (f"{license}-notice",), later), LicenseRule(license, (f"{license}-spdx",), later)]
    for license in ("0bsd", "bsd-4-clause"):
        known(f"SPDX-License-Identifier: {license}", f"{license}-spdx")
        rules.append(LicenseRule(license, (f"{license}-spdx",)))
    rules.append(LicenseRule("proprietary", ("all-rights-reserved",), ("*",)))
    return sentences, tuple(rules)


SENTENCES, RULES = _tables()

SPDX = "spdx-license-identifier "
END = "\x01"
MARK = re.compile(r"[.+\-]")

#: Signs of comments before and after the text of a line.
BEFORE = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|%+)?[ \t]*"
AFTER = r"[ \t]*(?:\*+/|-->)?[ \t]*(\n|\z)"
#: Abbreviations whose dot ends no sentence.
SHORT = r"(?i)\b(inc|ltd|corp|co|llc|v)\.([ \t\n])"


#: AFTER and SHORT for Java, which would try each place of a long run of blanks or stars.
AFTER_RUNS = r"(?<![ \t])[ \t]*+(?:(?:(?<!\*)\*++/|-->)[ \t]*+)?(\n|\z)"
SHORT_DOT = r"\.(?=[ \t\n])(?<=(?i:\b(?:inc|ltd|corp|co|llc|v))\.)"
#: All characters but a-z, digits, dot, plus sign, hyphen, blank, line feed and END. Java is slow with [^...].
OTHERS = r"[\x00\x02-\x09\x0B-\x1F!-*,/:-`{-\x{10FFFF}]+"
#: A run of blanks, dots and hyphens with a blank in it is one blank; a single blank is left.
BLANKS = r"(?<![.\-])(?:[.\-]++ [ .\-]*+| [ .\-]++)"
#: Where any of the TEMPLATES fits. What none of them fits, they leave as it is.
ANY = "^(?:" + "|".join(p.removeprefix("^") for p, _ in TEMPLATES) + ")"


def clean(text: Column) -> Column:
    """Lines without comment signs, the white space around them, and the dots of abbreviations."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, BEFORE, "$1"), AFTER_RUNS, "$1"), SHORT_DOT, "")


def words(cleaned: Column) -> Column:
    """The cleaned text in lower case with END where a sentence ends in both readings, and blanks for other signs. Done
    once for the whole text; what is left to do for a sentence alone is worded()."""
    ended = F.regexp_replace(cleaned, r"[.!?](?:[ \t]+|\n+)|:\n+", "." + END)
    return F.regexp_replace(F.lower(ended), OTHERS, " ")


def by_lines(words: Column) -> Column:
    return F.split(F.regexp_replace(words, BLANKS, " "), f"[\n{END}]+")


def by_paragraphs(words: Column) -> Column:
    blocks = F.regexp_replace(words, r"\n\n+", END)
    joined = F.replace(F.replace(blocks, F.lit("-\n"), F.lit("-")), F.lit("\n"), F.lit(" "))
    return F.split(F.regexp_replace(joined, BLANKS, " "), END + "+")


def worded(sentence: Column) -> Column:
    for pattern, to in TEMPLATES:
        sentence = F.regexp_replace(sentence, pattern, to)
    return sentence


def _parts(sentence: Column) -> Column:
    """The normalised sentence; one for each licence of an SPDX line that names several."""
    ids = F.split(F.regexp_replace(F.substr(sentence, F.lit(len(SPDX) + 1)), r" with [^ ]+", ""), r" (?:or|and) ")
    return F.when(F.startswith(sentence, F.lit(SPDX)), F.transform(ids, lambda i: F.concat(F.lit(SPDX), i))).otherwise(F.array(sentence))


def pattern_of(sequence: tuple[str, ...]) -> str:
    """For identifiers joined as |a|b|c|, in the SQL. Java recurses for each identifier that `...` passes over."""
    out = ""
    for s in sequence:
        out += r"(?:[^|]+\|)*?" if s == "..." else MARK.sub(r"\\\g<0>", s) + r"\|"
    return r"\|" + out


def _follow(ids: Column, sequence: tuple[str, ...]) -> Column:
    """Whether the identifiers joined as |a|b|c| hold the sequence. The first place of each run is taken: if a later one
    lets the rest follow, so does the first."""
    runs = [f"|{'|'.join(run)}|" for keep, run in groupby(sequence, lambda s: s != "...") if keep]
    at = F.position(F.lit(runs[0]), ids)
    for last, run in pairwise(runs):
        # The sign that ends one run begins the next.
        at = F.when(at > 0, F.position(F.lit(run), ids, at + len(last) - 1)).otherwise(0)
    return at > 0


def scan(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with paragraph_sentences and line_sentences (lists of place from 0 and identifier, in order, of the two
    readings), licenses (distinct, sorted) and rules (numbers of the matched rules, in order). Columns of df of these
    names are replaced; others are kept, whatever their names."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    kind = "array<struct<place:int,id:string>>"
    read = fresh(df, "read")
    ids, matched = fresh(df, "ids"), fresh(df, "matched")

    def named(sentences: Column) -> Column:
        placed = F.transform(sentences, lambda s, i: F.struct(i.alias("place"), F.btrim(s, F.lit(" .-")).alias("s")))
        # The table's search is slow: it is left to sentences that are in it, or may be when a template is applied.
        near = F.filter(placed, lambda x: x["s"].isin(list(SENTENCES)) | F.startswith(x["s"], F.lit(SPDX)) | x["s"].rlike(ANY))
        # The inner lambda sees a sentence that is worded once.
        normal = F.transform(near, lambda x: F.struct(x["place"].alias("place"), worded(x["s"]).alias("s")))
        parts = F.transform(normal, lambda x: F.transform(_parts(x["s"]), lambda p: F.struct(x["place"].alias("place"), F.try_element_at(table, p).alias("id"))))
        return F.filter(F.flatten(parts), lambda x: x["id"].isNotNull()).cast(kind)

    out = df.withColumn(read, words(clean(text)))
    out = out.withColumn("paragraph_sentences", named(by_paragraphs(F.col(read)))).withColumn("line_sentences", named(by_lines(F.col(read))))
    # Of each reading: |a|b|. A rule's sequence is looked for in one reading at a time.
    out = out.withColumn(ids, F.transform(F.array("paragraph_sentences.id", "line_sentences.id"), lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|"))))
    # A text with known sentences is rare; only there are the rules tried.
    tried = F.array(*[F.when(F.exists(F.col(ids), lambda r: _follow(r, rule.sequence)), F.lit(n)) for n, rule in enumerate(RULES)])
    none = F.array().cast("array<int>")
    out = out.withColumn(matched, F.when(F.exists(F.col(ids), lambda r: r != "||"), F.filter(tried, lambda x: x.isNotNull())).otherwise(none))
    names = F.transform(F.col(matched), lambda n: F.element_at(F.array(*[F.lit(r.license) for r in RULES]), n + 1))
    gone = F.flatten(F.transform(F.col(matched), lambda n: F.element_at(F.array(*[F.array(*[F.lit(x) for x in r.instead]).cast("array<string>") for r in RULES]), n + 1)))
    left = F.array_except(names, F.array_remove(gone, "*"))
    alone = F.array_except(left, F.array(*[F.lit(r.license) for r in RULES if r.instead == ("*",)]))
    return out.withColumn("licenses", F.array_sort(F.when(F.size(alone) > 0, alone).otherwise(left))).withColumn("rules", F.col(matched)).drop(read, ids, matched)
