"""Licences by sentence rules: sentences become identifiers, and ordered rules match sequences of identifiers.

Lines lose their comment marks; blank ones end a paragraph. A paragraph is cut into sentences after . ; : ! ? before
white space, and sentences are normalised (lower case, no punctuation, single spaces). Known sentences lie in one
tree of words, so a sentence is looked up with a probe a word, however many are known. One may start at any line of a
sentence and go over as many lines as it is wrapped to, up to the end of one; it gives its identifier, and any other
line with a licence word gives unknown. Rules are tried in order on what is left of the sequence, and each use
takes away the identifiers it matched, in order but not necessarily side by side. An SPDX line gives each identifier
of its expression; one that is no expression gives unknown.

Defined results: a null or empty text has no sentences and no licence; each row gives one row, repeated or not;
null ids pass through. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_rows

#: A sentence with one of these that is not known counts as unknown.
TELLING = re.compile(r"\blicen[cs](e[ds]?|ing)\b|\bcopyright|\bspdx-|\bwarrant(y|ies)\b|\bredistribut(e|ion)", re.I)
_ENDS = re.compile(r"(?<=[.;:!?])(?<!\bv\.)\s+")
#: Comment marks before a line.
_MARKS = re.compile(r"\s*(?:(?:/\*+!?|\*+/?|//+!?|#+|;+|%+|--+|<!--+|\.\.|(?:dnl|rem)\b)(?=\s|$)\s*)+", re.I)
_OTHER = re.compile(r"[^a-z0-9.+-]+")
_FIRST = re.compile(r"[a-z0-9+][a-z0-9.+-]*")

#: How a licence is named: the stem of its identifiers, the licence, its names. [a|b] may be left out, (a|b) may not.
NAMES = [
    ("apache2", "Apache-2.0", "apache [software] license [version|v] (2|2.0|v2|v2.0) [the license]"),
    ("apache2", "Apache-2.0", "apache-2.0 [license]"),
    ("apache11", "Apache-1.1", "apache [software] license [version|v] (1.1|v1.1)"),
    ("mit", "MIT", "(mit|mit x11|expat) [license|licence]"),
    ("agpl3", "AGPL-3.0", "(gnu affero general public license|gnu agpl|agpl|affero gpl) [version|v] (3|3.0|v3|v3.0) [only]"),
    ("lgpl3", "LGPL-3.0", "(gnu lesser general public license|gnu lgpl|lgpl) [version|v] (3|3.0|v3|v3.0) [only]"),
    ("lgpl21", "LGPL-2.1", "(gnu lesser general public license|gnu lgpl|lgpl) [version|v] (2.1|v2.1) [only]"),
    ("lgpl2", "LGPL-2.0", "(gnu library general public license|gnu lgpl|lgpl) [version|v] (2|2.0|v2|v2.0) [only]"),
    ("gpl3", "GPL-3.0", "(gnu general public license|gnu gpl|gpl) [version|v] (3|3.0|v3|v3.0) [only]"),
    ("gpl2", "GPL-2.0", "(gnu general public license|gnu gpl|gpl) [version|v] (2|2.0|v2|v2.0) [only]"),
    ("gpl1", "GPL-1.0", "(gnu general public license|gnu gpl|gpl) [version|v] (1|1.0|v1) [only]"),
    ("mpl2", "MPL-2.0", "(mozilla public license|mpl) [version|v] (2.0|2|v2.0)"),
    ("mpl11", "MPL-1.1", "(mozilla public license|mpl) [version|v] (1.1|v1.1) [the license]"),
    ("epl2", "EPL-2.0", "eclipse public license [version|v] (2.0|v2.0)"),
    ("epl1", "EPL-1.0", "eclipse public license [version|v] (1.0|v1.0)"),
    ("cddl11", "CDDL-1.1", "common development and distribution license [cddl] [version|v] (1.1|v1.1)"),
    ("cddl1", "CDDL-1.0", "common development and distribution license [cddl] [version|v] (1.0|v1.0) [the license]"),
    ("eupl12", "EUPL-1.2", "(european union public licence|eupl) [version|v] (1.2|v1.2)"),
    ("eupl11", "EUPL-1.1", "(european union public licence|eupl) [version|v] (1.1|v1.1)"),
    ("artistic2", "Artistic-2.0", "artistic license [version|v] (2.0|v2.0)"),
    ("artistic1", "Artistic-1.0", "artistic license [version|v] (1.0|v1.0)"),
    ("ofl11", "OFL-1.1", "sil open font license [version|v] (1.1|v1.1)"),
    ("bsl1", "BSL-1.0", "boost software license [version|v] (1.0|v1.0)"),
    ("busl11", "BUSL-1.1", "business source license [version|v] (1.1|v1.1)"),
    ("sspl1", "SSPL-1.0", "server side public license [version|v] (1|1.0|v1)"),
    ("mspl", "MS-PL", "microsoft public license [ms-pl]"),
    ("msrl", "MS-RL", "microsoft reciprocal license [ms-rl]"),
    ("upl1", "UPL-1.0", "universal permissive license [version|v] (1.0|v1.0|v 1.0)"),
    ("afl3", "AFL-3.0", "academic free license [version|v] (3.0|v3.0)"),
    ("osl3", "OSL-3.0", "open software license [version|v] (3.0|v3.0)"),
    ("php301", "PHP-3.01", "php license [version|v] (3.01|v3.01) [of the php license]"),
    ("psf2", "Python-2.0", "(psf license|python software foundation license) [version|v] [agreement] [2]"),
    ("mulan2", "MulanPSL-2.0", "mulan (psl|permissive software license) [version|v] (2|v2|2.0)"),
    ("ruby", "Ruby", "(ruby license|ruby s license)"),
    ("wtfpl", "WTFPL", "(wtfpl|do what the fuck you want to public license) [version|v] [2]"),
    ("postgresql", "PostgreSQL", "postgresql (license|licence)"),
    ("zlib", "Zlib", "(zlib|zlib libpng) license"),
    ("isc", "ISC", "isc (license|licence)"),
    ("ncsa", "NCSA", "university of illinois ncsa open source license"),
    ("bsd2", "BSD-2-Clause", "(bsd 2-clause|2-clause bsd|simplified bsd|freebsd|bsd 2 clause) [simplified] license"),
    ("bsd3", "BSD-3-Clause", "(bsd 3-clause|bsd 3 clause|3-clause bsd|new bsd|modified bsd|revised bsd) [new|revised] [or revised] license"),
    ("bsd4", "BSD-4-Clause", "(bsd 4-clause|4-clause bsd|original bsd|bsd 4 clause) license"),
    ("bsd0", "0BSD", "(zero-clause bsd|bsd zero clause|0bsd|bsd 0-clause) [license]"),
    ("bsd", "BSD", "bsd license"),
    ("ccbyncsa4", "CC-BY-NC-SA-4.0", "(cc by-nc-sa 4.0|creative commons attribution-noncommercial-sharealike 4.0 *)"),
    ("ccbyncnd4", "CC-BY-NC-ND-4.0", "(cc by-nc-nd 4.0|creative commons attribution-noncommercial-noderivatives 4.0 *)"),
    ("ccbync4", "CC-BY-NC-4.0", "(cc by-nc 4.0|creative commons attribution-noncommercial 4.0 *)"),
    ("ccbynd4", "CC-BY-ND-4.0", "(cc by-nd 4.0|creative commons attribution-noderivatives 4.0 *)"),
    ("ccbysa4", "CC-BY-SA-4.0", "(cc by-sa 4.0|creative commons attribution-sharealike 4.0 *)"),
    ("ccbysa3", "CC-BY-SA-3.0", "(cc by-sa 3.0|creative commons attribution-sharealike 3.0 *)"),
    ("ccby4", "CC-BY-4.0", "(cc by 4.0|creative commons attribution 4.0 *)"),
    ("ccby3", "CC-BY-3.0", "(cc by 3.0|creative commons attribution 3.0 *)"),
    ("cc0", "CC0-1.0", "(cc0 1.0|cc0|creative commons zero) [universal] [license]"),
]
#: What a sentence says of a name, in two parts: these stand before it. The identifier is the stem with -by.
SAID = (
    "[this|the] [work|file|software|project|program|code|library|source code|material|package] [is|are|may be] [hereby] "
    "(licensed|released|distributed|available|made available|provided|published|governed|covered) (under|by|subject to)"
)
OF = "[the|a] [terms of|terms and conditions of] [the|a]"
#: A name that stands alone as a line or sentence is a title; these words may follow it. The identifier ends with -title.
TITLES = {
    "apache2": "january 2004 [http www.apache.org licenses]", "gpl3": "29 june 2007", "gpl2": "june 1991", "lgpl3": "29 june 2007", "lgpl21": "february 1999", "agpl3": "19 november 2007",
    "ofl11": "26 february 2007", "bsl1": "august 17th 2003", "wtfpl": "december 2004",
}
#: Other known sentences, in the same notation; * stands for any words, and at the end for the rest of a sentence of
#: which only the start is looked at.
SENTENCES = [
    ("apache2-by", "the asf licenses this file to you under the apache license version 2.0 [the license]"),
    ("apache2-compliance", "[and] you may not use this (file|work|software) except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at [*]"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *"),
    ("apache-asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software *"),
    ("mit-notice", "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind *"),
    ("x11-name", "except as contained in this notice the (name|names) of * shall not be used in advertising *"),
    ("gpl-free", "(this program|this library|this file|this software|this package|this|it) is free software"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license [as published by the free software foundation]"),
    ("gpl3-later", "you can redistribute it and or modify it under the terms of the gnu general public license * either version 3 *"),
    ("gpl2-later", "you can redistribute it and or modify it under the terms of the gnu general public license * either version 2 *"),
    ("gpl3-by", "you can redistribute it and or modify it under the terms of the gnu general public license version 3 *"),
    ("gpl2-by", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 *"),
    ("lgpl-terms", "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license [as published by the free software foundation]"),
    ("lgpl3-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license * either version 3 *"),
    ("lgpl21-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license * either version 2.1 *"),
    ("lgpl2-later", "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license * either version 2 *"),
    ("agpl-terms", "you can redistribute it and or modify it under the terms of the gnu affero general public license [as published by the free software foundation]"),
    ("agpl3-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license * either version 3 *"),
    ("either-3", "either version 3 of the license or [at your option] any later version"),
    ("either-21", "either version 2.1 of the license or [at your option] any later version"),
    ("either-2", "either version 2 of the license or [at your option] any later version"),
    ("gpl-no-warranty", "(this program|this library|this file|this software|this package|it) is distributed in the hope that it will be useful but without any warranty *"),
    ("gpl-see", "see the gnu [lesser|library|affero] general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu [lesser|library|affero] general public license *"),
    ("cc0", "[this work is] (released|dedicated|licensed|placed) (into|to|in) the public domain"),
    ("cc0", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software *"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted *"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice *"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice *"),
    ("bsd-advertising", "all advertising materials mentioning features or use of this software must display the following [acknowledgement|acknowledgment]"),
    ("bsd-endorse", "neither the (name|names) of * may be used to endorse or promote products *"),
    ("bsd-endorse", "the (name|names) of * may not be used to endorse or promote products *"),
    ("bsd-as-is", "this software is provided by the (copyright holders|author|authors|regents|copyright holder) * as is *"),
    ("bsd-as-is", "this software is provided by * as is and any express or implied warranties *"),
    ("ncsa-endorse", "neither the names of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl2-by", "this source code form is subject to the terms of the mozilla public license [version|v] 2.0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("mpl11-by", "the contents of this file are subject to the mozilla public license version 1.1 [the license]"),
    ("cddl1-by", "the contents of this file are subject to the terms of the common development and distribution license [*]"),
    ("epl2-by", "this program and the accompanying materials are made available under the terms of the eclipse public license [version|v] 2.0 [*]"),
    ("epl1-by", "this program and the accompanying materials are made available under the terms of the eclipse public license [version|v] 1.0 [*]"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose *"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd0-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted $"),
    ("isc-as-is", "the software is provided as is and * disclaims all warranties *"),
    ("postgresql-grant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted *"),
    ("hpnd-grant", "permission to use copy modify [and] distribute [and sell] this software and its documentation for any purpose [and without fee|is hereby granted without fee|without fee] *"),
    ("zlib-as-is", "this software is provided as-is without any express or implied warranty"),
    ("zlib-liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications *"),
    ("zlib-origin", "the origin of this software must not be misrepresented *"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software *"),
    ("bsl-notice", "the copyright notices in the software and this entire statement *"),
    ("wtfpl-want", "you just do what the fuck you want to"),
    ("wtfpl-copies", "everyone is permitted to copy and distribute verbatim or modified copies of this license document *"),
    ("ofl11-by", "this font software is licensed under the sil open font license version 1.1 [*]"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("openssl-ack", "this product includes software developed by the openssl project for use in the openssl toolkit [*]"),
]
_SPDX = re.compile(r"SPDX-License-Identifier:(.*)", re.I)
#: What may stand after an expression: the end of a comment or of a sentence, or another comment.
_AFTER_SPDX = re.compile(r"\s*(?:\*/|--+>|\s(?:#|//|/\*)|[.;,]?(?:\s*[\"'`])?(?:\s*$|(?<=[.;])\s))")
_SPDX_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]*[A-Za-z0-9+])")
_OPTION = re.compile(r"\[([^\]]*)\]|\(([^)]*)\)|(\S+)")
#: Keys of the tree that are no words: any words, the end of a known sentence that holds to the end of a line, of one
#: that holds to the end of the sentence, and of one whose rest is not looked at.
_ANY, _TO_LINE_END, _TO_SENTENCE_END, _OPEN = "*", "\n", "$", "..."


def _spelled(notation: str) -> Iterator[tuple[str, ...]]:
    """The sequences of words that a notation stands for."""
    parts = [["", *m[1].split("|")] if m[1] is not None else m[2].split("|") if m[2] is not None else [m[3]] for m in _OPTION.finditer(notation)]
    for chosen in product(*parts):
        yield tuple(" ".join(chosen).split())


def _at(tree: dict, words: tuple[str, ...]) -> dict:
    for word in words:
        tree = tree.setdefault(word, {})
    return tree


def _put(tree: dict, words: tuple[str, ...], name: str) -> None:
    end = {_ANY: _OPEN, _TO_SENTENCE_END: _TO_SENTENCE_END}.get(words[-1], _TO_LINE_END)
    _at(tree, words if end == _TO_LINE_END else words[:-1]).setdefault(end, name)


def _join(at: dict, other: dict) -> None:
    """Puts other's branches below at, shared where at has none of the kind."""
    for key, below in other.items():
        if key not in at:
            at[key] = below
        elif isinstance(below, dict) and at[key] is not below:
            at[key] = dict(at[key])
            _join(at[key], below)


def _tree() -> dict:
    """All known sentences by their words; the names of licences are a branch that all that may stand before them share."""
    root: dict = {}
    named: dict = {}
    for name, notation in SENTENCES:
        for words in _spelled(notation):
            _put(root, words, name)
    for stem, _, notation in NAMES:
        for words in _spelled(notation):
            _put(named, words, f"{stem}-by")
            for after in {(), *_spelled(TITLES.get(stem, ""))}:
                if len(words) > 1 and words[-1] != _ANY:
                    _put(root, (*words, *after), f"{stem}-title")
    said: dict = {}
    for start in [_at(said, words) for words in set(_spelled(OF))]:
        _join(start, named)
    for start in [_at(root, words) for words in set(_spelled(SAID))]:
        _join(start, said)
    return root


_KNOWN = _tree()
#: Words with which a known sentence or a copyright starts.
_STARTS = frozenset(_KNOWN) | {"copyright", "c", "all"}
#: Ordered rules: the licence that a sequence of identifiers tells; longer ones stand before those they hold.
RULES = [
    ("Apache-2.0", ("apache2-by", "apache2-compliance", "apache2-copy", "apache2-as-is")),
    ("X11", ("mit-grant", "mit-notice", "mit-as-is", "x11-name")),
    ("NCSA", ("mit-grant", "bsd-source", "bsd-binary", "ncsa-endorse")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-3.0-or-later", ("gpl-terms", "either-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-or-later", ("gpl-terms", "either-2")),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "either-3")),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-2.1-or-later", ("lgpl-terms", "either-21")),
    ("LGPL-2.0-or-later", ("lgpl2-later",)),
    ("LGPL-2.0-or-later", ("lgpl-terms", "either-2")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl-terms", "either-3")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "ncsa-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("bsl-grant", "bsl-notice")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin")),
    ("WTFPL", ("wtfpl-copies", "wtfpl-want")),
    ("0BSD", ("bsd0-grant",)),
    ("ISC", ("isc-notice",)),
    ("ISC", ("isc-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("HPND", ("hpnd-grant",)),
    ("Beerware", ("beerware",)),
    ("OpenSSL", ("openssl-ack",)),
    ("CC0-1.0", ("cc0",)),
    *dict.fromkeys((licence, (f"{stem}-{kind}",)) for kind in ("by", "title") for stem, licence, _ in NAMES),
]


def normalised(sentence: str) -> str:
    return " ".join(_words(sentence))


def _words(line: str) -> list[str]:
    return [w for x in _OTHER.sub(" ", line.lower()).split() if (w := x.strip(".-"))]


def _bare(line: str) -> str:
    """The line without comment marks and white space around it, in time of its length."""
    marks = _MARKS.match(line)
    bare = (line[marks.end() :] if marks else line).rstrip()
    if bare.endswith("/"):
        end = len(bare[:-1].rstrip("*"))
        bare = bare[:end] if end < len(bare) - 1 else bare
    elif bare.endswith(">"):
        end = len(bare[:-1].rstrip("-"))
        bare = bare[:end] if end < len(bare) - 2 else bare
    elif bare.endswith(("*", "#")):
        end = len(bare.rstrip("*#"))
        bare = bare[:end] if bare[end - 1 : end].isspace() else bare
    return bare.strip()


def _may_tell(line: str) -> bool:
    """Whether the line's first word can start a known sentence."""
    first = _FIRST.search(line.lower())
    return first is not None and first[0].rstrip(".-") in _STARTS


def _spdx(said: str) -> tuple[list[str], int] | None:
    """The identifiers of the licence expression that said starts with and its end; None if it is none.

    Identifiers are joined by AND, OR and WITH, and grouped by parentheses.
    """
    found: list[str] = []
    at, depth, wanted = 0, 0, True
    while token := _SPDX_TOKEN.match(said, at):
        word = token[1]
        joins = word.upper() in ("AND", "OR", "WITH")
        if not wanted and not depth and _AFTER_SPDX.match(said, at):
            break
        if wanted == (joins or word == ")"):
            return None
        if word == "(":
            if not wanted:
                return None
            depth += 1
        elif word == ")":
            depth -= 1
            if depth < 0:
                return None
        elif joins:
            wanted = True
        else:
            found.append(word)
            wanted = False
        at = token.end()
    return (found, at) if found and not wanted and not depth and _AFTER_SPDX.match(said, at) else None


def _sentences(text: str) -> Iterator[list[str]]:
    """The lines of each sentence, without comment marks; SPDX lines stand alone."""
    paragraph: list[str] = []
    for line in [*text.split("\n"), ""]:
        bare = _bare(line)
        tag = _SPDX.search(bare) if ":" in bare else None
        if before := bare[: tag.start()].strip() if tag else bare:
            paragraph.append(before)
        if paragraph and (tag or not bare):
            for sentence in _ENDS.split("\n".join(paragraph)):
                yield sentence.split("\n")
            paragraph = []
        if tag:
            yield [tag[0]]


def _known(words: list[str], line_ends: set[int], at: int, line_end: int) -> tuple[str, int, bool] | None:
    """(identifier, its end, open) of the known sentence that starts at words[at]: the longest that ends where a line
    or the sentence does, or of which the start is known. A copyright goes to line_end, where its line ends."""
    found: tuple[str, int, bool] | None = None
    held, k = [(_KNOWN, False)] if words[at] in _KNOWN else [], at  # places in the tree, and whether any words may follow
    while held:
        for node, _ in held:
            if _OPEN in node and (found is None or found[1] < k):
                found = node[_OPEN], k, True
            if k in line_ends and _TO_LINE_END in node:
                found = node[_TO_LINE_END], k, False
            if k == len(words) and _TO_SENTENCE_END in node:
                found = node[_TO_SENTENCE_END], k, False
        if k == len(words):
            break
        after = []
        for node, any_word in held:
            if any_word:
                after.append((node, True))
            if (below := node.get(words[k])) is not None:
                after.append((below, False))
                if _ANY in below:
                    after.append((below[_ANY], True))
        held, k = after, k + 1
    if found is None:
        line = words[at:line_end]
        if (len(line) > 1 and line[0] == "copyright") or (len(line) > 2 and line[:2] == ["c", "copyright"]) or line == ["all", "rights", "reserved"]:
            return "copyright", line_end, False
    return found


def sentence_ids(text: str | None) -> list[tuple[str, str]]:
    """(identifier, normalised sentence) of each licence sentence, in the text's order. Every sentence is looked at;
    words are only made of those with a line that starts like a known one, or with a licence word."""
    text, out = text or "", []
    telling = TELLING.search(text) is not None
    for lines in _sentences(text):
        if tag := _SPDX.search(lines[0]):
            first, *after = _ENDS.split(tag[1].strip(), maxsplit=1)
            names, end = _spdx(tag[1]) or ([], len(tag[1]))
            out += [(f"spdx:{x}", normalised(tag[0][: tag.start(1) + end])) for x in names] or [("unknown", normalised(f"spdx-license-identifier {first}"))]
            out += sentence_ids(tag[1][end:] if names else "".join(after))
            continue
        if not any(_may_tell(line) or (telling and TELLING.search(line)) for line in lines):
            continue
        each = [_words(line) for line in lines]
        words = [w for line in each for w in line]
        ends = list(accumulate(map(len, each)))
        line_ends, at, done, is_open = set(ends), 0, 0, False
        for line, end in zip(lines, ends, strict=True):
            if done <= at < end:
                if found := _known(words, line_ends, at, end):
                    name, done, is_open = found
                    out.append((name, " ".join(words[at:done])))
                elif not is_open and TELLING.search(line):
                    out.append(("unknown", " ".join(words[at:end])))
            at = end
    return out


def _taken(ids: list[str], rule: tuple[str, ...]) -> list[int] | None:
    """Positions of the rule's identifiers in order, else None."""
    at, out = 0, []
    for want in rule:
        try:
            at = ids.index(want, at) + 1
        except ValueError:
            return None
        out.append(at - 1)
    return out


def licences_of(ids: list[str]) -> list[str]:
    """The licences told by a sequence of identifiers: by rules in order, each used up; SPDX lines speak for themselves."""
    left, found = [x for x in ids if not x.startswith("spdx:")], {x[5:] for x in ids if x.startswith("spdx:")}
    for name, rule in RULES:
        while (taken := _taken(left, rule)) is not None:
            found.add(name)
            left = [x for k, x in enumerate(left) if k not in set(taken)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [[name for name, _ in sentence_ids(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.string())), pa.array([licences_of(x) for x in ids], pa.list_(pa.string()))], ["doc_id", "sentences", "licences"])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers in order), licences (sorted) for each row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(plain, _scan, "doc_id long, sentences array<string>, licences array<string>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))
