"""Licence scan by sentence rules: normalised sentences become identifiers, identifier sequences meet ordered rules.

A sentence ends at an empty line or at `.`, `!`, `?` or `;` before white space; a line without letters and digits, as in
a comment, is empty too. A single line end may end it or be white space within it, so both hard-wrapped sentences and
single lines without punctuation are known. The normal form has small letters and digits with single spaces. Known sentences
are found from left to right as whole runs of lines, of several at one place the longest. A known sentence with such an end inside,
as "v. 2.0" has, is cut there as a text is, and may go on at once or in the next sentence. Unknown sentences don't count, so
a rule's sentences may stand at any distance. The rules are tried in order on a document's identifiers, and each takes the
runs that it matches, so that a later, shorter rule doesn't count words of an earlier one; what stood on both sides of a
taken run doesn't become neighbours. Licences named in `weak` count only where no other one does, as most licences stand below a
line that reserves all rights; the query names those of `WEAK`. Identifiers that no rule takes are reported too. The plan has one fold over the rules
and one pattern of the sentences, so it grows in proportion to both.

Edge cases: a null or empty text has no sentences; repeated rows, null ids and extra columns pass through (result
columns replace columns of the same name); an empty table gives an empty result. Work stays in a row: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences by identifier.
SENTENCES = {
    "GplUnder3": "This work is licensed under the GNU General Public License, version 3.",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GplImplied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplSee": "See the GNU General Public License for more details.",
    "CcByNc4": "Licensed under CC BY-NC 4.0.",
    "CcBy4": "Licensed under CC BY 4.0.",
    "CcBySa4": "Licensed under CC BY-SA 4.0.",
    "MitReleased": "Released under the MIT License.",
    "MitLicensed": "Licensed under the MIT License.",
    "MitPermission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache2Licensed": "Licensed under the Apache License, Version 2.0.",
    "Apache2The": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Apache2May": "you may not use this file except in compliance with the License.",
    "Apache2Copy": "You may obtain a copy of the License at",
    "BsdRedistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "AllRights": "All rights reserved.",
    "BsdNeither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Mpl2Subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Mpl2Copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Gpl2Free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Lgpl21Free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AgplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "IscPermission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibPermission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BslUnder": "Distributed under the Boost Software License, Version 1.0.",
    "UnlicensePublic": "This is free and unencumbered software released into the public domain.",
    "Cc0Waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Epl2Available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ApacheReleased": "Released under the Apache License, Version 2.0.",
    "BsdReleased": "Released under the BSD License.",
    "GplReleased": "Released under the GNU General Public License, version 3.",
    "Lgpl3Under": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AgplUnder": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MplUnder": "Licensed under the Mozilla Public License, version 2.0.",
    "Cc0Under": "Licensed under CC0 1.0.",
    "CcByNd4": "Licensed under CC BY-ND 4.0.",
    "CcByNcSa4": "Licensed under CC BY-NC-SA 4.0.",
    "CcByNcNd4": "Licensed under CC BY-NC-ND 4.0.",
    "CcBySaWork": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CcByWork": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "PublicDomain": "This work is in the public domain.",
}
#: Rules in order, (licence, sequence of identifiers).
RULES = (
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplImplied", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-3.0", ("GplUnder3",)),
    ("MIT", ("MitPermission", "MitNotice")),
    ("MIT", ("MitReleased",)),
    ("MIT", ("MitLicensed",)),
    ("Apache-2.0", ("Apache2The", "Apache2May", "Apache2Copy")),
    ("Apache-2.0", ("Apache2Licensed",)),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdNeither")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary")),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("Proprietary", ("AllRights",)),
    ("MPL-2.0", ("Mpl2Subject", "Mpl2Copy")),
    ("MPL-2.0", ("Mpl2Subject",)),
    ("MPL-2.0", ("MplUnder",)),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplHope", "GplImplied", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("LGPL-2.1-or-later", ("Lgpl21Free",)),
    ("LGPL-3.0", ("Lgpl3Under",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope", "GplImplied")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("AGPL-3.0", ("AgplUnder",)),
    ("ISC", ("IscPermission",)),
    ("Zlib", ("ZlibAsIs", "ZlibPermission")),
    ("BSL-1.0", ("BslUnder",)),
    ("Unlicense", ("UnlicensePublic",)),
    ("CC0-1.0", ("Cc0Waived",)),
    ("CC0-1.0", ("Cc0Under",)),
    ("EPL-2.0", ("Epl2Available",)),
    ("Apache-2.0", ("ApacheReleased",)),
    ("BSD", ("BsdReleased",)),
    ("GPL-3.0", ("GplReleased",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4",)),
    ("CC-BY-SA-4.0", ("CcBySaWork",)),
    ("CC-BY-4.0", ("CcByWork",)),
    ("Public-Domain", ("PublicDomain",)),
)
#: Licences that count only where no other does.
WEAK = ("Proprietary",)
#: Marks in normal text, which has no capitals otherwise: the end of a sentence, and of a line that may not end one.
END, LINE = "S", "L"
#: Stands among identifiers where a rule took a run.
TAKEN = "|"


def normalise(text: Column) -> Column:
    """The normal form of a text, with a mark at each end of a sentence or line and at both ends of the text."""
    out = F.regexp_replace(F.lower(text), r"(?<=[.!?;])[\x20\x09-\x0D]+", END)
    out = F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(LINE)), f"[^a-z0-9{END}{LINE}]+", " ")
    out = F.regexp_replace(F.concat(F.lit(END), out, F.lit(END)), f" ?([{END}{LINE}]) ?", "$1")
    return F.regexp_replace(out, f"[{END}{LINE}]{{2,}}", END)


def parts(sentence: str) -> list[str]:
    """The normal parts of an ASCII sentence, cut where `normalise` ends a sentence; for tables made in the driver."""
    cut = (normal_text(x) for x in re.split(r"(?<=[.!?;])[\x20\x09-\x0D]+", sentence))
    return [x for x in cut if x]


def pattern(sentences: Iterable[str], inside: str = f"[{LINE} ]", between: str = f"[{END}{LINE} ]") -> str:
    """Whole sentences in normal text, longer ones first; `inside` stands for a blank, `between` for an end inside a sentence."""
    longest_first = sorted({tuple(p) for s in sentences if (p := parts(s))}, key=lambda p: (-sum(map(len, p)) - len(p), p))
    return "|".join(between.join(x.replace(" ", inside) for x in p) for p in longest_first)


def normal_text(sentence: str) -> str:
    """What `normalise` makes of an ASCII sentence, for tables made in the driver."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def scan(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, text: str = "text", weak: Sequence[str] = ()) -> DataFrame:
    """`docs` with sentence_ids (array), licenses (array: distinct, sorted) and unmatched (array of identifiers).

    Only documents in which some sentence is known go through the lookup and the rules.
    """
    ids = {n: k for k, s in sentences.items() if (n := normal_text(s))}
    whole = f"(?<=[{END}{LINE}])(?:{pattern(sentences.values())})(?=[{END}{LINE}])"
    lookup = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # A text without the longest word of any sentence has none of them.
    may = reduce(Column.__or__, (F.lower(body).contains(w) for w in sorted({max(s.split(), key=len) for s in ids})), F.lit(False))
    out = docs.withColumn("_l_found", F.when(may, F.regexp_extract_all(normalise(body), F.lit(whole), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = F.transform("_l_found", lambda s: F.try_element_at(lookup, F.translate(s, END + LINE, "  ")))
    out = out.withColumn("sentence_ids", F.when(F.size("_l_found") > 0, found).otherwise(F.array().cast("array<string>")))
    # Each identifier stands between commas of its own, so matches that touch each other all count; TAKEN stays where one was.
    rest = F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda k: F.concat(k, F.lit(","))), ","))
    none = F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(f",{',,'.join(sequence)},").alias("run")) for name, sequence in rules)) if rules else None

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        names = F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit(f",{TAKEN},")).alias("rest"), names.alias("names"))

    start = F.struct(rest.alias("rest"), none.alias("names"))
    out = out.withColumn("_l_state", F.when(F.size("sentence_ids") > 0, F.aggregate(table, start, step) if rules else start))
    strong = F.filter("_l_state.names", lambda x: ~x.isin(*weak))
    names = F.when(F.size(strong) > 0, strong).otherwise(F.col("_l_state.names"))
    out = out.withColumn("licenses", F.coalesce(F.array_sort(F.array_distinct(names)), none))
    out = out.withColumn("unmatched", F.coalesce(F.filter(F.split("_l_state.rest", ","), lambda x: ~x.isin("", TAKEN)), none))
    return out.drop("_l_found", "_l_state")
