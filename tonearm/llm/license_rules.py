"""Licence scans: known sentences become identifiers, and ordered rules match sequences of identifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, normalised (words in lower case, one space apart).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-line",
    "licensed under the apache license version 2 0 the license": "apache2-line",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "you may obtain a copy of the license at": "copy-at",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is-software",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 3": "gpl3-line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software": "gpl-free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-line",
    "licensed under cc by nc 4 0": "cc-by-nc4-line",
    "licensed under cc by 4 0": "cc-by4-line",
    "licensed under cc by sa 4 0": "cc-by-sa4-line",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-line",
    "this is free and unencumbered software released into the public domain": "unlicense-line",
    "all rights reserved": "reserved",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "distributed under the boost software license version 1 0": "bsl-line",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0": "epl2-grant",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "do what the fuck you want to public license": "wtfpl-title",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-line",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "this is free software released under the terms of the artistic license 2 0": "artistic2-line",
}

# Grants of the GNU licences: who is free software, the licence's name there and its version, with any later one.
_FREE = ("this program", "this library", "this file", "this package", "this software", "this project")
_GNU = {
    ("general public license", "2"): "gpl2-grant", ("general public license", "3"): "gpl3-grant",
    ("lesser general public license", "2 1"): "lgpl21-grant", ("lesser general public license", "3"): "lgpl3-grant",
    ("library general public license", "2"): "lgpl2-grant", ("affero general public license", "3"): "agpl3-grant",
}
SENTENCES |= {
    f"{who} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version": identifier
    for who in _FREE for (name, version), identifier in _GNU.items()
}

# Sentences with a place for the name of a person, product or organisation, of 1 to 12 words.
SLOT = "*"
SLOT_SENTENCES = {
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the names of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
}

# Names of licences as short statements give them ("licensed under the ...").
NAMES = {
    "mit license": "MIT", "mit": "MIT", "x11 license": "X11", "expat license": "MIT",
    "apache license": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "apache 2 0": "Apache-2.0",
    "apache license version 1 1": "Apache-1.1",
    "bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause", "bsd 3 clause license": "BSD-3-Clause", "bsd 3 clause": "BSD-3-Clause",
    "simplified bsd license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause", "bsd 2 clause license": "BSD-2-Clause", "bsd 2 clause": "BSD-2-Clause", "zero clause bsd license": "0BSD",
    "isc license": "ISC", "zlib license": "Zlib", "boost software license": "BSL-1.0", "boost software license version 1 0": "BSL-1.0", "boost software license 1 0": "BSL-1.0",
    "gnu general public license version 2": "GPL-2.0-only", "gnu general public license v2": "GPL-2.0-only", "gnu gpl version 2": "GPL-2.0-only", "gnu gpl v2": "GPL-2.0-only", "gpl v2": "GPL-2.0-only", "gplv2": "GPL-2.0-only",
    "gnu general public license version 2 or later": "GPL-2.0-or-later", "gplv2 or later": "GPL-2.0-or-later",
    "gnu general public license version 3": "GPL-3.0-only", "gnu general public license v3": "GPL-3.0-only", "gnu general public license v3 0": "GPL-3.0-only", "gnu gpl version 3": "GPL-3.0-only", "gnu gpl v3": "GPL-3.0-only", "gpl v3": "GPL-3.0-only", "gplv3": "GPL-3.0-only",
    "gnu general public license version 3 or later": "GPL-3.0-or-later", "gplv3 or later": "GPL-3.0-or-later",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only", "gnu lgpl version 2 1": "LGPL-2.1-only", "gnu lgpl v2 1": "LGPL-2.1-only", "lgplv2 1": "LGPL-2.1-only",
    "gnu lesser general public license version 2 1 or later": "LGPL-2.1-or-later",
    "gnu lesser general public license version 3": "LGPL-3.0-only", "gnu lgpl v3": "LGPL-3.0-only", "lgplv3": "LGPL-3.0-only", "gnu lesser general public license version 3 or later": "LGPL-3.0-or-later",
    "gnu affero general public license version 3": "AGPL-3.0-only", "gnu agpl v3": "AGPL-3.0-only", "agplv3": "AGPL-3.0-only", "gnu affero general public license version 3 or later": "AGPL-3.0-or-later",
    "mozilla public license version 2 0": "MPL-2.0", "mozilla public license v 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mpl 2 0": "MPL-2.0",
    "eclipse public license version 1 0": "EPL-1.0", "eclipse public license v1 0": "EPL-1.0", "eclipse public license version 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license v2 0": "EPL-2.0",
    "artistic license 2 0": "Artistic-2.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "european union public license 1 2": "EUPL-1.2",
    "creative commons zero v1 0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc by 3 0": "CC-BY-3.0", "cc by 4 0": "CC-BY-4.0", "cc by sa 3 0": "CC-BY-SA-3.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc by nc sa 4 0": "CC-BY-NC-SA-4.0", "cc by nd 4 0": "CC-BY-ND-4.0", "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0", "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0", "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}
_THINGS = ("file", "project", "software", "work", "code", "source code", "library", "program", "package", "repository", "document", "material", "module")
_VERBS = ("licensed", "released", "distributed", "available", "made available", "published", "provided")

# Identifiers that ``SPDX-License-Identifier`` lines hold, alone or joined by "or" and "and".
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0
EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL
PSF-2.0 Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
_SPDX_NAMES = {name.lower().replace("-", " ").replace(".", " "): name for name in SPDX}
_SPDX_LINE = "spdx license identifier "
# Identifiers that name a licence by themselves, without a rule.
_STATED = "is:"

# Licences and the sequences of identifiers that state them, longest first. Of two
# rules that fit, the one further up takes the sentences.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("Apache-2.0", ("apache2-line", "apache-use", "apache2-copy")),
    ("Apache-2.0", ("apache2-line", "apache-use", "copy-at")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-hope", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-hope", "gpl-copy")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-line",)),
    ("MIT", ("mit-line",)),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("MPL-2.0", ("mpl2-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-line",)),
    ("CC-BY-4.0", ("cc-by4-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-line",)),
    ("Unlicense", ("unlicense-line",)),
    ("proprietary", ("reserved",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant", "gpl-hope", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-grant", "gpl-hope", "lgpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-hope", "agpl-copy")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-notice")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSL-1.0", ("bsl-line",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-title",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("LGPL-2.0-or-later", ("lgpl2-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("EPL-1.0", ("epl1-grant",)),
    ("EPL-2.0", ("epl2-grant",)),
    ("WTFPL", ("wtfpl-title",)),
    ("CC0-1.0", ("cc0-line",)),
    ("Artistic-2.0", ("artistic2-line",)),
)


# Ends of a sentence, and ends of a line or of a part before ``;``: a sentence may go on over these.
_HARD, _SOFT = "\r", "\n"
# Comment leaders that are letters; signs are no part of a sentence anyway.
_LEADER = "(?:(?:rem|dnl|c) )?"
# Abbreviations whose point ends no sentence if a small letter or a number follows.
_SHORT = r"\b(Inc|Ltd|Corp|Co|[vV])[.]([ \t\n]+[a-z0-9])"


def stretches(text: Column) -> Column:
    """A text's words in lower case, one space apart, with _SOFT and _HARD where sentences may or must end.

    Sentences end at .!? before white space, but for abbreviations amid one, and at lines without letters or digits. They
    may end at a line's end and at ``;`` before white space.
    """
    lines = F.regexp_replace(F.translate(text, "\r", " "), r"\n[^A-Za-z0-9\n]+", "\n")
    whole = F.regexp_replace(F.regexp_replace(lines, r"\n\n+", _HARD), _SHORT, "$1$2")
    ended = F.regexp_replace(whole, r"[.!?][ \t\n\r]+", _HARD)
    parted = F.regexp_replace(ended, r";[ \t\n]+", _SOFT)
    words = F.lower(F.regexp_replace(parted, r"[^A-Za-z0-9\n\r]+", " "))
    return F.concat(F.lit(_HARD), F.regexp_replace(words, r"^ | $| ?([\n\r]) ?", "$1"), F.lit(_HARD))


def _trie(known: Iterable[str], gap: str) -> str:
    """A pattern for any of the given word sequences that shares their beginnings, longest first.

    So a place in a text is compared with each first word, not with each sentence, however many there are.
    """
    tree: dict = {}
    for sentence in known:
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def spell(node: dict) -> str:
        ways = []
        for word, below in node.items():
            if word:
                start = f"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,11}}?" if word == SLOT else word
                ways.append(start + "".join(spell(below)))
        longer = "|".join(ways)
        if "" not in node:
            return f"{gap}(?:{longer})" if len(ways) > 1 else f"{gap}{longer}"
        return f"(?:{gap}(?:{longer}))?" if ways else ""

    return "|".join((f"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,11}}?" if word == SLOT else word) + spell(below) for word, below in tree.items())


def _pattern(soft: str) -> str:
    """Any known sentence; ``soft`` is the pattern of an end that a sentence may go on over."""
    gap = f"(?: |{soft}{_LEADER})"

    def spaced(*words: str) -> str:
        return gap.join(word.replace(" ", gap) for word in words)

    things = spaced("(?:this|the)", f"(?:{_trie(_THINGS, gap)})", "is")
    names = _trie([*NAMES, *(n.replace("license", "licence") for n in NAMES if "license" in n)], gap)
    line = f"(?:{things}{gap})?(?:{_trie(_VERBS, gap)}){gap}under(?:{gap}the{gap}terms{gap}of)?(?:{gap}the)?{gap}(?:{names})"
    listed = f"(?:{_trie(_SPDX_NAMES, ' ')})"
    spdx = f"{_SPDX_LINE}{listed}(?: (?:or|and) {listed})*"
    return "|".join((_trie([*SENTENCES, *SLOT_SENTENCES], gap), line, spdx))


def sentences(text: Column) -> Column:
    """The known sentences of a text in order, normalised; of those that start at one place the longest.

    A sentence fills a stretch from one end to another, over any number of line ends between.
    """
    pattern = f"(?<=[{_SOFT}{_HARD}]){_LEADER}({_pattern(_SOFT)})(?=[{_SOFT}{_HARD}])"
    return F.transform(F.regexp_extract_all(stretches(text), F.lit(pattern), F.lit(1)), lambda s: F.regexp_replace(s, _SOFT + _LEADER, " "))


def _slot_pattern(sentence: str) -> str:
    return f"^{sentence.replace(SLOT, '[a-z0-9 ]+')}$"


# The licence's name at the end of a short statement, and the names in an SPDX line.
_LINE = f"under (?:the terms of )?(?:the )?({_trie(NAMES, ' ')})$"
_LISTED = f"({_trie(_SPDX_NAMES, ' ')})"


def _map(items: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def identifiers(found: Column) -> Column:
    """The identifiers of normalised known sentences; an SPDX line has one for each licence in it."""
    fixed, names, listed = _map(SENTENCES), _map(NAMES), _map(_SPDX_NAMES)

    def of(s: Column) -> Column:
        slot = F.coalesce(*[F.when(s.rlike(_slot_pattern(sentence)), F.lit(i)) for sentence, i in SLOT_SENTENCES.items()])
        stated = F.concat(F.lit(_STATED), names[F.regexp_extract(F.replace(s, F.lit("licence"), F.lit("license")), _LINE, 1)])
        several = F.transform(F.regexp_extract_all(F.substring(s, len(_SPDX_LINE) + 1, F.length(s)), F.lit(_LISTED), F.lit(1)), lambda n: F.concat(F.lit(_STATED), listed[n]))
        return F.when(s.startswith(_SPDX_LINE), several).otherwise(F.array(F.coalesce(fixed[s], slot, stated)))

    return F.flatten(F.transform(found, of))


def _sequence(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in identifiers)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licenses of every whole text of ``docs``, both as arrays in the order of text.

    ``sentence_ids`` are the identifiers of the sentences that are known, on one line or wrapped over several, in
    comments too; unknown ones don't part a sequence. Known are whole sentences, sentences with a place for a name
    (``SLOT_SENTENCES``), short statements ("this file is licensed under ...") and SPDX lines; the last two name
    their licence themselves. ``licenses`` are the distinct licences so named, or whose rules match stretches of the identifiers; a sentence is
    used by one rule at most, longer rules first.

    Null and empty texts have empty arrays. Very long texts are read whole. Repeated rows stay; a null doc_id
    stays null. Other columns are not looked at, and an empty table gives no rows.
    """
    rows = docs.select("doc_id", identifiers(sentences(F.coalesce("text", F.lit("")))).alias("sentence_ids"))
    spelt = F.replace(F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">")), F.lit("<" + _STATED), F.lit("<="))
    matched = reduce(lambda text, rule: F.replace(text, F.lit(_sequence(rule[1])), F.lit(f"<={rule[0]}>")), RULES, spelt)
    names = F.array_distinct(F.regexp_extract_all(matched, F.lit("<=([^>]*)>"), F.lit(1)))
    return rows.select("doc_id", "sentence_ids", names.alias("licenses"))


def scan_sql(documents: str = "documents") -> str:
    """The same as SQL, with both arrays joined by commas.

    Its patterns can't look around, so every end is doubled: one for the sentence before it, one for the next.
    """
    def listed(values: Iterable[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def known(items: Mapping[str, str]) -> str:
        return f"map({listed(items)}, {listed(items.values())})"

    matched = f"replace('<' || array_to_string(ids, '><') || '>', '<{_STATED}', '<=')"
    for name, rule in RULES:
        matched = f"replace({matched}, '{_sequence(rule)}', '<={name}>')"
    slots = " ".join(f"WHEN regexp_matches(x, '{_slot_pattern(sentence)}') THEN '{i}'" for sentence, i in SLOT_SENTENCES.items())
    wide = r"\n\n"
    return f"""
    WITH k AS (SELECT {known(SENTENCES)} AS fixed, {known(NAMES)} AS named, {known(_SPDX_NAMES)} AS spdx),
    a AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(13), ' '), '\\n[^A-Za-z0-9\\n]+', chr(10), 'g') AS t FROM {documents}),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\n\\n+', chr(13), 'g'), '{_SHORT}', '\\1\\2', 'g'), '[.!?][ \\t\\n\\r]+', chr(13), 'g') AS t FROM a),
    c AS (SELECT doc_id, lower(regexp_replace(regexp_replace(t, ';[ \\t\\n]+', chr(10), 'g'), '[^A-Za-z0-9\\n\\r]+', ' ', 'g')) AS t FROM b),
    d AS (SELECT doc_id, chr(13) || regexp_replace(t, '^ | $| ?([\\n\\r]) ?', '\\1', 'g') || chr(13) AS t FROM c),
    e AS (SELECT doc_id, regexp_extract_all(regexp_replace(t, '([\\n\\r])', '\\1\\1', 'g'), '[\\n\\r]{_LEADER}({_pattern(wide)})[\\n\\r]', 1) AS found FROM d),
    s AS (SELECT doc_id, list_transform(found, lambda x: regexp_replace(x, '\\n\\n{_LEADER}', ' ', 'g')) AS found FROM e),
    f AS (SELECT doc_id, flatten(list_transform(found, lambda x: CASE WHEN starts_with(x, '{_SPDX_LINE}')
            THEN list_transform(regexp_extract_all(substr(x, {len(_SPDX_LINE) + 1}), '{_LISTED}', 1), lambda n: '{_STATED}' || spdx[n])
            ELSE [coalesce(fixed[x], CASE {slots} END, '{_STATED}' || named[regexp_extract(replace(x, 'licence', 'license'), '{_LINE}', 1)])] END)) AS ids FROM s, k),
    m AS (SELECT doc_id, ids, regexp_extract_all({matched}, '<=([^>]*)>', 1) AS found FROM f)
    SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
           coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses FROM m"""
