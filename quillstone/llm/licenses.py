"""Licence scans: sentences become identifiers, identifier sequences are matched against ordered licence rules."""

from __future__ import annotations

import json
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, in full, with their identifiers.
TEXTS = [
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("AsIs", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("AsIs", "The software is provided as is, without warranty of any kind"),
    ("MitLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice"),
    ("BsdAdvertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdAsIs", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BsdLiability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscWarranty", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("FreeGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("PublicDomain", "This is free and unencumbered software released into the public domain."),
    ("UnlicenseGrant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ZlibAsIs", "This software is provided as-is, without any express or implied warranty."),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BoostGrant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("ApacheRef", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("ApacheCompliance", "you may not use this file except in compliance with the License."),
    ("ApacheUrl", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheUrl", "You may obtain a copy of the License at"),
    ("ApacheLink", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License."),
    ("ApacheTitle", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("ApacheTerms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("ApacheGrant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("ApachePatents", "If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed."),
    ("ApacheMarks", "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file."),
    ("GnuVerbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GnuFree", "This program is free software;"),
    ("GnuFree", "This library is free software;"),
    ("GnuHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("GnuHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("GnuNoWarranty", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("MozillaNotice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MozillaUrl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MozillaUrl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EclipseNotice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("AllRights", "All rights reserved."),
]
#: GNU licences by name, with versions and the dates of their titles.
GNU = [("General", "GPL", {"2": "June 1991", "3": "29 June 2007"}), ("Lesser General", "LGPL", {"2.1": "February 1999", "3": "29 June 2007"}), ("Affero General", "AGPL", {"3": "19 November 2007"})]
#: Names by which other licences are referred to.
NAMES = {
    "MIT": ["MIT license", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause license"],
    "ISC": ["ISC license"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
#: Parts of Creative Commons licences and their versions.
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_VERSIONS = [("2.0", "Generic"), ("3.0", "Unported"), ("4.0", "International")]
PHRASES = ["licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}", "this project is licensed under the {}", "this software is licensed under the {}", "this work is licensed under the {}", "this work is licensed under a {}", "SPDX-License-Identifier: {}"]
#: Sequences by which full texts are known; their beginnings of so many sentences count too.
SEQUENCES = [
    ("MIT", ("MitGrant", "MitNotice", "AsIs", "MitLiability"), 1),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising"), 4),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability"), 4),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"), 3),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AsIs"), 4),
    ("ISC", ("IscGrant", "IscWarranty"), 1),
    ("0BSD", ("FreeGrant", "IscWarranty"), 1),
    ("Unlicense", ("PublicDomain", "UnlicenseGrant", "AsIs"), 1),
    ("Zlib", ("ZlibAsIs", "ZlibGrant"), 2),
    ("BSL-1.0", ("BoostGrant",), 1),
    ("Apache-2.0", ("ApacheRef", "ApacheCompliance", "ApacheUrl", "ApacheLink", "ApacheAsIs", "ApacheSee"), 1),
    ("Apache-2.0", ("ApacheRef", "ApacheCompliance", "ApacheUrl", "ApacheAsIs", "ApacheSee"), 4),
    ("Apache-2.0", ("ApacheTitle", "ApacheTerms", "ApacheGrant", "ApachePatents", "ApacheMarks"), 2),
    ("MPL-2.0", ("MozillaNotice", "MozillaUrl"), 1),
    ("EPL-2.0", ("EclipseNotice",), 1),
    ("Proprietary", ("AllRights",), 1),
]
_MARKS = r"[\s#*/;-]"


def _tables() -> tuple[list[tuple[str, str]], list[tuple[tuple[str, ...], str]]]:
    """Sentences with identifiers, and ordered rules, longer sequences first."""
    texts, rules = list(TEXTS), [(ids[:n], name) for name, ids, least in SEQUENCES for n in range(len(ids), least - 1, -1)]

    def refer(spdx: str, names: list[str]) -> None:
        texts.extend((f"Ref-{spdx}", phrase.format(n)) for phrase in PHRASES for n in [*names, spdx])
        rules.append(((f"Ref-{spdx}",), spdx))

    for spdx, names in NAMES.items():
        refer(spdx, names)
    rules.append((("Ref-Apache-2.0", "ApacheCompliance"), "Apache-2.0"))
    for word, short, versions in GNU:
        gnu = f"GNU {word} Public License"
        texts.append((f"{short}Terms", f"you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation;"))
        texts += [("GnuCopy", f"You should have received a copy of the {gnu} along with this {what}") for what in ("program.", "library.")]
        rules.append(((f"{short}Terms",), short))
        for v, date in versions.items():
            full = v if "." in v else f"{v}.0"
            refer(f"{short}-{full}-only", [f"{gnu}, version {v}", f"{gnu} version {v}", f"{gnu} v{full}", f"{short} v{v}", f"{short}v{v}", f"{short}-{full}"])
            refer(f"{short}-{full}-or-later", [f"{gnu}, version {v} or later", f"{gnu} v{full} or later"])
            later, title = f"{short}-{full}-later", f"{short}-{full}-title"
            for what in ("program", "library", "file"):
                texts.append((later, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {gnu} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."))
            texts += [(f"Version{v}Later", f"either version {v} of the License, or (at your option) any later version."), (title, f"{gnu} Version {v}, {date}")]
            rules += [((f"{short}Terms", f"Version{v}Later"), f"{short}-{full}-or-later"), (("GnuFree", f"{short}Terms", f"Version{v}Later"), f"{short}-{full}-or-later"), ((later,), f"{short}-{full}-or-later"), ((title, "GnuVerbatim"), f"{short}-{full}-only"), ((title,), f"{short}-{full}-only")]
    for kind, words in COMMONS:
        for v, where in COMMONS_VERSIONS:
            refer(f"CC-{kind}-{v}", [f"CC {kind} {v}", f"Creative Commons {words} {v} {where} License", f"Creative Commons {words} {v}"])
    return texts, sorted(rules, key=lambda r: -len(r[0]))


def key(sentence: str) -> str:
    """The normal form of the longest piece that sentences() cuts a known sentence into."""
    return max((normal_text(x) for x in re.split(r"(?<=[.!?;])\s+", sentence)), key=len)


def normal_text(s: str) -> str:
    """normal() for the driver's tables."""
    s = re.sub("[\"'`‘’“”]", "", s.lower())
    s = re.sub(rf"^{_MARKS}+|\s*\n{_MARKS}*", " ", s)
    return re.sub(r"[\s.;:,!]+$", "", re.sub(r"\s+", " ", s).strip(" "))


_texts, RULES = _tables()
SENTENCES = {key(text): name for name, text in reversed(_texts)}


def hints(known: dict[str, str]) -> list[str]:
    """A few strings of which every known sentence holds one: the commonest words of the sentences that hold none yet."""
    left, out = set(known), []
    while left:
        counts: dict[str, int] = {}
        for sentence in left:
            for word in {w for w in sentence.split(" ") if w}:
                counts[word] = counts.get(word, 0) + len(word) ** 2
        if not counts:
            return []  # a sentence without words: no text can be left out
        out.append(max(counts, key=lambda w: (counts[w], w)))
        left = {s for s in left if out[-1] not in s}
    return out


def normal(sentence: Column) -> Column:
    """Lower case, without comment marks and quotes, white space as one space, no closing punctuation."""
    s = F.regexp_replace(F.lower(sentence), "[\"'`‘’“”]", "")
    s = F.regexp_replace(s, rf"^{_MARKS}+|\s*\n{_MARKS}*", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"[\s.;:,!]+$", "")


def sentences(text: Column) -> Column:
    """Sentences of a text: a full stop, exclamation or question mark or semicolon before white space ends one, and so does
    an empty line (one of comment marks, too); wrapped lines are parts of one."""
    ended = F.regexp_replace(F.regexp_replace(text, rf"\n{_MARKS}*\n", "\u0001"), r"([.!?;])\s+", "$1\u0001")
    return F.split(ended, "\u0001")


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[tuple[str, ...], str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of each whole text: id_col, identifiers (in text order), licenses (by rule order, each once), unmatched.

    A sentence that is known as a whole gives its identifier; of another one each line is looked up,
    since a line may stand for itself. Rules match neighbouring identifiers, in the rules' order, and
    take them away; unmatched counts the identifiers that no rule took. ``known`` maps normal forms
    (see normal()) to identifiers; texts and sentences without any of its hints() are passed over, which
    loses none. Row by row: nothing is shuffled, repeated rows stay, null and empty texts have
    none, other columns are not read.
    """
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    words = hints(known)

    def hinted(s: Column) -> Column:
        return reduce(Column.__or__, (F.contains(s, F.lit(w)) for w in words)) if words else F.lit(bool(known))

    buckets: list[dict[str, str]] = [{} for _ in range(1 << max(0, len(known) - 1).bit_length())]
    for k, name in known.items():
        buckets[zlib.crc32(k.encode()) % len(buckets)][k] = name
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")  # one constant; a map is searched in sequence, so each is small
    none = F.array().cast("array<string>")
    look = lambda s: F.transform(F.array(normal(s)), lambda k: F.when(hinted(k), F.try_element_at(F.element_at(table, F.pmod(F.crc32(k), F.lit(len(buckets))).cast("int") + 1), k)))[0]
    lines = lambda s: F.when(F.contains(s, F.lit("\n")), F.transform(F.split(s, "\n"), look)).otherwise(none)
    each = F.transform(sentences(F.col(text_col)), lambda s: F.transform(F.array(look(s)), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(lines(s)))[0])
    ids = F.filter(F.flatten(each), lambda x: x.isNotNull())
    plain = F.translate(F.lower(F.col(text_col)), "\"'`‘’“”", "")
    out = docs.select(F.col(id_col).alias("id"), F.when(hinted(plain), ids).otherwise(none).alias("identifiers"))
    ordered = F.array(*(F.struct(F.lit("".join(f"|{x}|" for x in sequence)).alias("seek"), F.lit(name).alias("name")) for sequence, name in rules)).cast("array<struct<seek:string,name:string>>")
    begin = F.struct(F.concat(F.lit("|"), F.array_join("identifiers", "||"), F.lit("|")).alias("left"), none.alias("names"))
    taken = lambda a, r: F.when(F.contains(a["left"], r["seek"]), F.struct(F.replace(a["left"], r["seek"], F.lit("||")).alias("left"), F.array_append(a["names"], r["name"]).alias("names"))).otherwise(a)
    out = out.withColumn("end", F.when(F.size("identifiers") > 0, F.aggregate(ordered, begin, taken)).otherwise(F.struct(F.lit("").alias("left"), none.alias("names"))))
    unmatched = F.size(F.filter(F.split("end.left", r"\|+"), lambda x: x != "")).cast("long")
    return out.select(F.col("id").alias(id_col), "identifiers", F.array_distinct("end.names").alias("licenses"), unmatched.alias("unmatched"))
