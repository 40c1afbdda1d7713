"""Licence scans by sentence rules.

A text is cut in sentences, sentences are normalised and mapped to the identifiers of known licence sentences, and the
sequences of identifiers are matched against ordered rules, longer rules first (German, Manabe and Inoue 2010).

A line's end may end a sentence or not: a known sentence may run over several lines, whatever leads these (comment signs
are no words), or stand on a line of its own without a full stop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, by identifier. Case, punctuation and white space don't count.
SENTENCES = {
    "apache2": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License 2.0", "Apache License Version 2.0, January 2004"],
    "apacheLimit": ["you may not use this file except in compliance with the License"],
    "apacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apacheUrl": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "mitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mitAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "iscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Licensed under the ISC License"],
    "zeroBsdGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsdNames": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsdAsIs": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd2": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License"],
    "bsd3": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License"],
    "gpl2": ["Licensed under the GNU General Public License v2", "Released under the GPLv2", "This work is licensed under the GNU General Public License, version 2"],
    "gpl3": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3", "Released under the GPLv3"],
    "gplFree": ["This program is free software", "This file is free software"],
    "gplGrant": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gplGrant2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2"],
    "gplGrant2Or": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gplGrant3Or": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgplFree": ["This library is free software"],
    "lgplGrant": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgplGrant3Or": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agplGrant3Or": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2Or": ["either version 2 of the License, or (at your option) any later version"],
    "gpl3Or": ["either version 3 of the License, or (at your option) any later version"],
    "lgpl21Or": ["either version 2.1 of the License, or (at your option) any later version"],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "cc0": ["Licensed under CC0 1.0", "This work is licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal"],
    "ccByNc4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ccBy4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccBySa4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "rights": ["All rights reserved"],
}
#: Fixed values: (licence, sentences in order).
RULES = [
    ("Apache-2.0", ["apache2", "apacheLimit", "apacheCopy", "apacheUrl", "apacheAsIs", "apacheSee"]),
    ("Apache-2.0", ["apache2", "apacheLimit", "apacheCopy", "apacheAsIs", "apacheSee"]),
    ("Apache-2.0", ["apache2", "apacheLimit"]),
    ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit", "mitGrant", "mitNotice", "mitAsIs", "mitLiable"]),
    ("MIT", ["mitGrant", "mitNotice", "mitAsIs", "mitLiable"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("MIT", ["mitGrant"]),
    ("MIT", ["mit"]),
    ("ISC", ["iscGrant"]),
    ("0BSD", ["zeroBsdGrant"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdNames", "bsdAsIs"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdNames"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdAsIs"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("BSD-2-Clause", ["bsd2"]),
    ("BSD-3-Clause", ["bsd3"]),
    ("BSD", ["bsdGrant"]),
    ("GPL-2.0-or-later", ["gplFree", "gplGrant", "gpl2Or"]),
    ("GPL-2.0-or-later", ["gplFree", "gplGrant2Or"]),
    ("GPL-2.0", ["gplFree", "gplGrant2"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL-3.0-or-later", ["gplFree", "gplGrant", "gpl3Or"]),
    ("GPL-3.0-or-later", ["gplFree", "gplGrant3Or"]),
    ("GPL-3.0", ["gpl3"]),
    ("LGPL-2.1-or-later", ["lgplFree", "lgplGrant", "lgpl21Or"]),
    ("LGPL-3.0-or-later", ["gplFree", "lgplGrant3Or"]),
    ("LGPL-3.0-or-later", ["lgplFree", "lgplGrant3Or"]),
    ("AGPL-3.0-or-later", ["gplFree", "agplGrant3Or"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0"]),
    ("CC-BY-NC-4.0", ["ccByNc4"]),
    ("CC-BY-4.0", ["ccBy4"]),
    ("CC-BY-SA-4.0", ["ccBySa4"]),
    ("all-rights-reserved", ["rights"]),
]
#: Unknown sentences (or lines) that may stand between two sentences of one rule.
GAP = 5


def normal(text: str) -> str:
    """A known sentence as marked() shows it."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def anchors(known: list[str]) -> list[str]:
    """Words of which every known sentence has one: the word of the most sentences still without, again and again."""
    left, out = [set(s.split()) for s in known], []
    while left:
        words = sorted({w for s in left for w in s if len(w) > 2} or {w for s in left for w in s})
        out.append(max(words, key=lambda w: (sum(w in s for s in left), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def marked(text: Column) -> Column:
    """The words a-z, 0-9 of a text in lower case, each sentence or line between two marks: 1 where a sentence surely ends (. ! ? ; : before white space, an empty line), 2 at other line ends."""
    # runs are matched from their first character only and whole, so cost is linear in their length
    hard = F.regexp_replace(F.regexp_replace(text, r"(?<![.!?;:])[.!?;:]++(?=\s|$)", "\u0001"), r"\n[ \t\r]*+\n", "\u0001")
    low = F.lower(F.translate(F.regexp_replace(hard, r"\n", "\u0002"), "\u0130\u212a", "  "))
    words = F.regexp_replace(low, "[^a-z0-9\u0001\u0002]+", " ")
    one = F.regexp_replace(words, "(?<![ \u0001\u0002])[ \u0002]*+\u0001[ \u0001\u0002]*+", " \u0001 \u0001 ")
    soft = F.regexp_replace(one, "(?<![ \u0001\u0002])[ ]*+\u0002[ \u0002]*+", " \u0002 \u0002 ")
    return F.concat(F.lit("\u0001 "), F.trim(soft), F.lit(" \u0001"))


def unit_pattern(known: list[str]) -> str:
    """One sentence or line with its marks; group 1 holds it if it is known. A known one may go over marks of line ends."""
    inside = "|".join(s.replace(" ", "(?: | \u0002 \u0002 )") for s in sorted(known, key=lambda s: (-len(s), s)))
    return f"[\u0001\u0002] (?:({inside}) [\u0001\u0002]|[^\u0001\u0002]*[\u0001\u0002])"


def rule_patterns(rules: list[tuple[str, list[str]]], number: dict[str, int]) -> tuple[str, dict[str, str]]:
    """A pattern of all rules, longer ones first, over sentences written as number@position; and the licence of each match without positions."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return "|".join("".join(rf" {number[x]}@\d+ " for x in seq) for _, seq in ordered), {"".join(f" {number[x]} " for x in seq): name for name, seq in reversed(ordered)}


def scan(docs: DataFrame, sentence_ids: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """Licences named in each text: doc_id, licence, n_found, first_sentence (the place, from 0, among the sentences and lines of its text where the licence first begins).

    docs: doc_id, text. Identifiers of a text stand in the order of its sentences; at most `gap` unknown sentences or lines
    may stand between two of one rule. Matches don't overlap, and at each place the longest rule counts. Known sentences
    that no rule takes are reported with the licence `unmatched`, counted together.

    Null and empty texts name none. Repeated rows with one doc_id are scanned each, and their counts are added; a null
    doc_id is a document of its own. An empty table gives no rows. Only texts with a word of a small set that every known
    sentence has a word of are looked at in full; nothing is shuffled but what was found.
    """
    sentence_ids, rules = sentence_ids or SENTENCES, rules or RULES
    number = {name: k for k, name in enumerate(sentence_ids)}
    known = {normal(t): number[name] for name, texts in sentence_ids.items() for t in texts}
    pattern, licences = rule_patterns(rules, number)
    text = F.lower(F.translate(F.col("text").cast("string"), "\u0130\u212a", "  "))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text.alias("low"))
    found = F.lit(False)
    for word in anchors(list(known)):
        found = found | F.contains("low", F.lit(word))
    units = F.regexp_extract_all(marked(F.col("text")), F.lit(unit_pattern(list(known))), F.lit(1))
    rows = rows.select("doc_id", F.when(found, units).alias("units"))
    sid = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    ids = F.filter(F.transform("units", lambda x, i: F.struct(i.alias("pos"), F.when(x != "", F.element_at(sid, F.regexp_replace(x, " \u0002 \u0002 ", " "))).alias("sid"))), lambda x: x["sid"].isNotNull())
    rows = rows.select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)

    def told(x: Column, i: Column) -> Column:
        far = (i > 0) & (x["pos"] - F.get("ids", i - 1)["pos"] > gap + 1)
        return F.concat(F.when(far, F.lit(" | ")).otherwise(F.lit("")), F.lit(" "), x["sid"].cast("string"), F.lit("@"), x["pos"].cast("string"), F.lit(" "))

    rows = rows.select("doc_id", F.array_join(F.transform("ids", told), "").alias("line"))
    licence = F.create_map(*[F.lit(x) for kv in licences.items() for x in kv])
    place = lambda m: F.regexp_extract(m, r"@(\d+)", 1).cast("long").alias("place")
    hits = F.transform(F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.element_at(licence, F.regexp_replace(m, r"@\d+", "")).alias("licence"), place(m)))
    rest = F.transform(F.regexp_extract_all(F.regexp_replace("line", pattern, " "), F.lit(r"(\d+@\d+)"), F.lit(1)), lambda m: F.struct(F.lit("unmatched").alias("licence"), place(m)))
    return rows.select("doc_id", F.explode(F.concat(hits, rest)).alias("h")).groupBy("doc_id", "h.licence").agg(F.count("*").alias("n_found"), F.min("h.place").alias("first_sentence"))
