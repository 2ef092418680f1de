"""Licence recognition from sentences and ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Known licence sentences (fixed values: public licence texts and notices), by identifier.
SENTENCES: dict[str, str] = {
    "mit-name": "The MIT License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-terms": "under the terms of the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "x11-advertising": "shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization",
    "ncsa-grant": "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-copyright-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "apache-patent-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-may": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2-designed": "The licenses for most software are designed to take away your freedom to share and change it",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gfdl-permission": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-not-distributed": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-contributor": "means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software",
    "epl1-accompanying": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl1-made": "are made available under the terms of the Eclipse Public License v1.0",
    "epl2-made": "are made available under the terms of the Eclipse Public License v2.0",
    "epl2-made-2": "made available under the terms of the Eclipse Public License 2.0",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "cddl-title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "eupl-licensed": "Licensed under the EUPL, Version 1.2",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-waived": "has waived all copyright and related or neighboring rights to",
    "cc0-dedicated": "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-3": "licensed under a Creative Commons Attribution 3.0",
    "cc-by-sa-3": "licensed under a Creative Commons Attribution-ShareAlike 3.0",
    "cc-by-named": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-named": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-named": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-named": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-named": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-named": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-just": "You just DO WHAT THE FUCK YOU WANT TO",
    "artistic-title": "The Artistic License 2.0",
    "artistic-everyone": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "ofl-licensed": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "ofl-goals": "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects",
    "odbl-available": "is made available under the Open Database License",
    "mspl-title": "Microsoft Public License (Ms-PL)",
    "mspl-governs": "This license governs use of the accompanying software",
    "psf-agreement": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "json-good": "The Software shall be used for Good, not Evil",
    "rights": "All rights reserved",
    "confidential": "This document contains confidential and proprietary information",
    "unauthorized": "Unauthorized copying of this file, via any medium is strictly prohibited",
}

#: Licence, the ordered sentence identifiers that state it, and whether it restricts reuse. Rules with
#: more sentences come first; a sentence used by one rule is not used again.
RULES: list[tuple[str, tuple[str, ...], bool]] = [
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), False),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-may"), False),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"), False),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), False),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-may"), False),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), False),
    ("X11", ("mit-grant", "mit-notice", "as-is", "x11-advertising"), False),
    ("JSON", ("mit-grant", "mit-notice", "json-good"), True),
    ("MIT", ("mit-grant", "mit-notice", "as-is"), False),
    ("MIT", ("mit-grant", "mit-notice"), False),
    ("MIT-0", ("mit0-grant", "as-is"), False),
    ("NCSA", ("ncsa-grant", "bsd-endorse-may"), False),
    ("ISC", ("isc-grant", "isc-disclaimer"), False),
    ("0BSD", ("0bsd-grant", "isc-disclaimer"), False),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy", "apache-unless"), False),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy"), False),
    ("Apache-2.0", ("apache-terms", "apache-copyright-grant", "apache-patent-grant"), False),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl-hope"), True),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-hope"), True),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only", "gpl-hope"), True),
    ("GPL-3.0-only", ("gpl-free", "gpl3-only", "gpl-hope"), True),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later", "gpl-hope"), True),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later"), True),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later"), True),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later"), True),
    ("GPL-2.0", ("gpl2-title", "gpl2-designed"), True),
    ("GPL-3.0", ("gpl3-title", "gpl3-copyleft"), True),
    ("MPL-2.0", ("mpl-subject", "mpl-not-distributed"), True),
    ("MPL-2.0", ("mpl-title", "mpl-contributor"), True),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered"), False),
    ("CC0-1.0", ("cc0-title", "cc0-dedicated"), False),
    ("Unlicense", ("unlicense", "unlicense-anyone"), False),
    ("BSL-1.0", ("bsl-title", "bsl-grant"), False),
    ("WTFPL", ("wtfpl-title", "wtfpl-just"), False),
    ("Artistic-2.0", ("artistic-title", "artistic-everyone"), False),
    ("OFL-1.1", ("ofl-licensed", "ofl-goals"), False),
    ("MS-PL", ("mspl-title", "mspl-governs"), False),
    *(("MIT", (k,), False) for k in ("mit-name", "mit-released", "mit-licensed", "mit-terms")),
    *(("Apache-2.0", (k,), False) for k in ("apache-licensed", "apache-licensed-the")),
    *((n, (k,), False) for n, k in (("ISC", "isc-grant"), ("0BSD", "0bsd-grant"), ("PostgreSQL", "postgresql-grant"), ("PSF-2.0", "psf-agreement"))),
    *((n, (k,), True) for n, k in (("GPL-3.0", "gpl3-work"), ("GPL-2.0-or-later", "gpl2-later"), ("GPL-3.0-or-later", "gpl3-later"), ("GPL-2.0-only", "gpl2-only"), ("GPL-3.0-only", "gpl3-only"), ("GPL-2.0", "gpl2-title"), ("GPL-3.0", "gpl3-title"))),
    *((n, (k,), True) for n, k in (("LGPL-2.1-or-later", "lgpl21-later"), ("LGPL-3.0-or-later", "lgpl3-later"), ("LGPL-2.1", "lgpl21-title"), ("LGPL-3.0", "lgpl3-title"), ("AGPL-3.0-or-later", "agpl3-later"), ("AGPL-3.0", "agpl3-title"), ("GFDL-1.3-or-later", "gfdl-permission"))),
    *((n, (k,), True) for n, k in (("MPL-2.0", "mpl-subject"), ("EPL-1.0", "epl1-accompanying"), ("EPL-1.0", "epl1-made"), ("EPL-2.0", "epl2-made"), ("EPL-2.0", "epl2-made-2"), ("CDDL-1.0", "cddl-subject"), ("CDDL-1.0", "cddl-title"), ("EUPL-1.2", "eupl-licensed"), ("ODbL-1.0", "odbl-available"))),
    *((n, (k,), False) for n, k in (("CC0-1.0", "cc0-title"), ("CC0-1.0", "cc0-waived"), ("CC0-1.0", "cc0-dedicated"), ("CC-BY-4.0", "cc-by"), ("CC-BY-4.0", "cc-by-named"), ("CC-BY-3.0", "cc-by-3"))),
    *((n, (k,), True) for n, k in (("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-SA-4.0", "cc-by-sa-named"), ("CC-BY-SA-3.0", "cc-by-sa-3"), ("CC-BY-NC-4.0", "cc-by-nc"), ("CC-BY-NC-4.0", "cc-by-nc-named"), ("CC-BY-ND-4.0", "cc-by-nd"), ("CC-BY-ND-4.0", "cc-by-nd-named"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-named"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-named"))),
    *((n, (k,), False) for n, k in (("Unlicense", "unlicense"), ("Zlib", "zlib-grant"), ("BSL-1.0", "bsl-distributed"), ("BSL-1.0", "bsl-grant"), ("WTFPL", "wtfpl-title"), ("Artistic-2.0", "artistic-everyone"), ("OFL-1.1", "ofl-licensed"))),
    ("GPL", ("gpl-free", "gpl-may"), True),
    *(("proprietary", (k,), True) for k in ("confidential", "unauthorized", "rights")),
]
TAG = "SPDX-License-Identifier: "
#: Said beside other licences too; a licence of its own only where no other is found.
ALONE = {"proprietary"}
#: Sentences of fewer words count only where a line or sentence begins; longer ones anywhere.
SHORT = 4

#: Words before a sentence, in the same one, that take it back.
DENIED = re.compile(r"(?:^| )(?:not|never|cannot|no longer|formerly|previously|used to be|was once|were once)(?: \w+){0,2} $")
#: What may stand before such words and is no denial of the licence.
NOT_DENIED = re.compile(r"(?:^| )not (?:only|just|merely)(?: \w+){0,2} $")
#: Sentences of more words are clauses of a licence, which nothing before them takes back.
NAMED = 12
EXCEPTION = re.compile(r" with ((?:[a-z0-9]+ ){0,6}?exception(?: \d+ \d+)?)(?= )")

_KEPT = set(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Bytes to words: letters and digits stay, ends of sentences and lines become line feeds, all else blanks.
TABLE = bytes(c if c in _KEPT else 10 if c in b"\n\r.!?:;" else 32 for c in range(256))


def pieces_of(text: str) -> list[str]:
    """Lower-case ASCII words with single blanks, by line and sentence; marks, quotes and comment leaders go."""
    raw = text.encode("utf-8", "surrogatepass").lower().translate(TABLE).replace(b"licence", b"license")
    return [" ".join(w) for x in raw.decode("ascii").split("\n") if (w := x.split())]


def normalise(sentence: str) -> str:
    return " ".join(pieces_of(sentence))


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        import ahocorasick

        tags = {f"spdx-{n}": (n, restricted) for n, _, restricted in rules if n not in ALONE}
        self.known = {normalise(s): k for k, s in sentences.items()} | {normalise(TAG + n): k for k, (n, _) in tags.items()}
        self.rules = sorted([*rules, *((n, (k,), x) for k, (n, x) in tags.items())], key=lambda r: -len(r[1]))
        self.words = ahocorasick.Automaton()
        for s, k in self.known.items():
            self.words.add_word(f" {s}", (len(s), s.count(" ") + 1 < SHORT, k))
        self.words.make_automaton()
        self.ids = {normalise(n): k for k, (n, _) in tags.items()}

    def identify(self, text: str) -> list[str]:
        """Identifiers of known sentences in the order of the text: from left to right, the longest at each place, none
        inside another. A sentence may be wrapped over any number of lines, with or without comment leaders, and
        stand inside a longer one."""
        pieces = pieces_of(text)
        stream = f" {' '.join(pieces)} "
        hits = []  # (first character, - length, identifier)
        starts = None
        for end, (n, short, k) in self.words.iter(stream):
            if stream[end + 1] == " ":
                if short and starts is None:
                    at, starts = 1, set()
                    for p in pieces:
                        starts.add(at)
                        at += len(p) + 1
                if not short or end + 1 - n in starts:
                    hits.append((end + 1 - n, -n, k))
        found, last, begins = [], 0, None
        for at, n, k in sorted(hits):
            if at < last:
                continue
            last = at - n
            if stream.count(" ", at, last) < NAMED and not k.startswith("spdx-"):
                if begins is None:
                    begins = [0]
                    for p in pieces:
                        begins.append(begins[-1] + len(p) + 1)
                before = stream[begins[bisect_right(begins, at) - 1] : at]  # of the same sentence
                if DENIED.search(before) and not NOT_DENIED.search(before):
                    continue
            found.append(k)
            if k.startswith("spdx-"):
                more, last = self._expression(stream, last, found)
                found += more
        return found

    def _expression(self, stream: str, at: int, found: list[str]) -> tuple[list[str], int]:
        """Identifiers that follow a tag's first: ``or``, ``and``, ``with`` an exception (which joins the identifier before it).
        Brackets are gone from the words. Returns them and where they end."""
        out: list[str] = []
        while True:
            if m := EXCEPTION.match(stream, at):
                held = out or found
                held[-1] += " WITH " + m[1].replace(" ", "-")
                at = m.end()
            if not (m := re.match(r" (?:or|and)((?: [a-z0-9]+){1,8})", stream[at : at + 200])):
                return out, at
            words = m[1].split()
            known = next((n for n in range(len(words), 0, -1) if " ".join(words[:n]) in self.ids), 0)
            if not known:
                return out, at
            name = " ".join(words[:known])
            out.append(self.ids[name])
            at += len(m[0]) - len(m[1]) + len(name) + 1

    def match(self, ids: list[str]) -> list[tuple[str, bool]]:
        """Licences whose sentences occur in the rule's order (others may stand between)."""
        # an exception is part of the licence's name
        left, out = [k.split(" WITH ")[0] for k in ids], []
        exceptions = [k[len(x) :] for k, x in zip(ids, left)]
        for name, need, restricted in self.rules:
            if not all(k in left for k in need):
                continue
            while True:
                at, used = -1, []
                for k in need:
                    try:
                        at = left.index(k, at + 1)
                    except ValueError:
                        break
                    used.append(at)
                if len(used) < len(need):
                    break
                for u in used:
                    left[u] = ""
                out.append((name + exceptions[used[0]], restricted))
        return [x for x in out if x[0] not in ALONE] or out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Recognises licences in every whole text of ``docs(doc_id, text)``.

    A text becomes normalised words; known sentences among them become identifiers, and the sequence of identifiers
    is matched against ordered rules. Returns doc_id, sentence_ids (comma-joined, in text order), n_sentences, licenses
    (sorted, distinct, comma-joined), n_licenses, restricted. All identifiers of an SPDX expression count, an exception as part of
    the licence's name; a sentence that names a licence and is denied (``not``, ``formerly``, ...) does not. Null or empty text: no sentences, empty strings, not
    restricted. Null doc_id: a row as any other. Repeated rows: a result each. Very long texts: whole, one at a time.
    Empty table: no rows. Other columns are ignored, and may have any names."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["doc_id", "sentence_ids", "n_sentences", "licenses", "n_licenses", "restricted"]

    def run(batches):
        r = Recogniser()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = r.identify(t)
                lic = sorted(set(r.match(ids))) if ids else []
                rows.append((d, ",".join(ids), len(ids), ",".join(sorted({n for n, _ in lic})), len({n for n, _ in lic}), any(x for _, x in lic)))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, sentence_ids string, n_sentences long, licenses string, n_licenses long, restricted boolean"
    )
