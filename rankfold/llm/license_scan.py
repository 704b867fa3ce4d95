"""Licence scans by sentence-rule recognition.

A text is cut into parts at sentence ends and line ends, each part is normalised, and where consecutive parts make up a
known licence sentence, it becomes an identifier; so wrapped lines, colons and "v. 2.0" inside a sentence do not hide it.
The sequence of identifiers is matched against an ordered list of rules.  Everything happens inside a row with built-in functions: no
shuffle, no state, so neither skew nor a lost executor matters.  The tables of sentences and rules are fixed and small.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT1",
    "licensed under the mit license": "MIT1",
    "this project is licensed under the mit license": "MIT1",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT2",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT3",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "ASIS",
    "licensed under the apache license version 2 0": "APA1",
    "licensed under the apache license version 2 0 the license": "APA1",
    "you may not use this file except in compliance with the license": "APA2",
    "you may obtain a copy of the license at": "APA3",
    "see the license for the specific language governing permissions and limitations under the license": "APA4",
    "this work is licensed under the gnu general public license version 3": "GPL1",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL3",
    "you should have received a copy of the gnu general public license along with this program": "GPL4",
    "licensed under cc by nc 4 0": "CCN1",
    "this work is licensed under cc by nc 4 0": "CCN1",
    "licensed under cc by 4 0": "CCB1",
    "this work is licensed under cc by 4 0": "CCB1",
    "licensed under cc by sa 4 0": "CCS1",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD1",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD2",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD3",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD4",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL1",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGP1",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGP2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGP2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGP1",
    "you should have received a copy of the gnu affero general public license along with this program": "AGP2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC1",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC1",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "BSZ1",
    "this software is provided as is without any express or implied warranty": "ZLB1",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLB2",
    "this is free and unencumbered software released into the public domain": "UNL1",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNL2",
    "boost software license version 1 0 august 17th 2003": "BSL1",
    "distributed under the boost software license version 1 0": "BSL1",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at": "EPL1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "EPL1",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCB1",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCN1",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCS1",
    "licensed under cc0 1 0": "CCZ1",
    "this work is licensed under cc0 1 0": "CCZ1",
    "all rights reserved": "ARR1",
}

#: Licences that an SPDX tag may name, each a sentence of its own.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
SENTENCES |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name.lower())}": f"SPDX:{name}" for name in SPDX}

#: Ordered rules; the first that matches names the licence.
RULES = [
    ("mit-full", "MIT", ("MIT2", "MIT3", "ASIS")),
    ("apache-2-header", "Apache-2.0", ("APA1", "APA2", "APA3", "APA4")),
    ("gpl-3-notice", "GPL-3.0-or-later", ("GPL2", "GPL4")),
    ("gpl-2-notice", "GPL-2.0-or-later", ("GPL3", "GPL4")),
    ("bsd-3-clause", "BSD-3-Clause", ("BSD1", "BSD2", "BSD3", "BSD4")),
    ("bsd-2-clause", "BSD-2-Clause", ("BSD1", "BSD2", "BSD3")),
    ("zlib-full", "Zlib", ("ZLB1", "ZLB2")),
    ("unlicense-full", "Unlicense", ("UNL1", "UNL2")),
    ("boost-full", "BSL-1.0", ("BSL1", "BSL2")),
    ("agpl-3-notice", "AGPL-3.0-or-later", ("AGP1", "AGP2")),
    ("gpl-3-reserved", "conflict", ("GPL1", "ARR1")),
    *((f"spdx-{name.lower()}", name, (f"SPDX:{name}",)) for name in SPDX),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", ("LGP1",)),
    ("lgpl-3-notice", "LGPL-3.0-or-later", ("LGP2",)),
    ("agpl-3-terms", "AGPL-3.0-or-later", ("AGP1",)),
    ("isc-permission", "ISC", ("ISC1",)),
    ("0bsd-permission", "0BSD", ("BSZ1",)),
    ("zlib-permission", "Zlib", ("ZLB2",)),
    ("unlicense-line", "Unlicense", ("UNL1",)),
    ("boost-line", "BSL-1.0", ("BSL1",)),
    ("epl-2-notice", "EPL-2.0", ("EPL1",)),
    ("cc0-line", "CC0-1.0", ("CCZ1",)),
    ("apache-2-line", "Apache-2.0", ("APA1",)),
    ("mit-line", "MIT", ("MIT1",)),
    ("gpl-3-line", "GPL-3.0-only", ("GPL1",)),
    ("gpl-3-terms", "GPL-3.0-or-later", ("GPL2",)),
    ("gpl-2-terms", "GPL-2.0-or-later", ("GPL3",)),
    ("cc-by-nc-4-line", "CC-BY-NC-4.0", ("CCN1",)),
    ("cc-by-sa-4-line", "CC-BY-SA-4.0", ("CCS1",)),
    ("cc-by-4-line", "CC-BY-4.0", ("CCB1",)),
    ("mpl-2-line", "MPL-2.0", ("MPL1",)),
    ("mit-permission", "MIT", ("MIT2",)),
    ("reserved", "proprietary", ("ARR1",)),
]

#: A part ends at a line end, or at a full stop, mark or colon before white space or the end of the text.
SENTENCE_END = r"[.!?:;]+([\t-\r ]+|$)|\n"
#: Every sentence of the table has one of these parts of words, which no line end can divide; texts without any need no normalising.
ANCHORS = ("licen", "copyright", "warrant", "permi", "rights", "distribut", "domain")


def known_lines(sentences: dict[str, str]) -> str:
    """Pattern of a known sentence in normalised parts, one on a line: one or more whole lines, the longest where several fit."""
    return rf"(?m)^ ?({'|'.join(s.replace(' ', '[ ' + chr(92) + 'n]') for s in sorted(sentences, key=len, reverse=True))}) ?$"


def recognised(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order.

    The normalised parts stand one on a line; see ``known_lines``.
    """
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), SENTENCE_END, "\n"), r"[^a-z0-9\n]+", " ")
    parts = F.regexp_replace(plain, r" ?\n[ \n]*", "\n")
    found = F.regexp_extract_all(parts, F.lit(known_lines(sentences)), F.lit(1))
    return F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """One row per document: ``id_col``, n_known (known sentences), sequence, rule, license, all_licenses.

    sequence joins the identifiers by ``|``.  A rule matches when its identifiers follow one another in that sequence;
    text that is no licence sentence may stand between them.  rule and license are those of the first rule that
    matches, null if none does; all_licenses joins the distinct licences of all rules that match, in rule order.

    A null or empty text has no sentence.  Repeated rows are scanned each, an empty table gives an empty result, other
    columns are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    if missing := [s for s in sentences if not any(a in s for a in ANCHORS)]:
        raise ValueError(f"no anchor word in {missing}")
    quick = F.lower(F.col(text_col)).rlike("|".join(ANCHORS))
    found = F.when(quick, recognised(F.col(text_col), sentences)).otherwise(F.array().cast("array<string>"))
    seq = docs.select(F.col(id_col).alias(id_col), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    seq = seq.select(id_col, F.size("found").cast("long").alias("n_known"), F.array_join("found", "|").alias("sequence"))
    fenced = F.concat(F.lit("|"), F.col("sequence"), F.lit("|"))
    hit = lambda ids: fenced.contains("|" + "|".join(ids) + "|")
    first = lambda k: F.coalesce(*[F.when(hit(r[2]), F.lit(r[k])) for r in rules])
    every = F.array_distinct(F.array_compact(F.array(*[F.when(hit(ids), F.lit(name)) for _, name, ids in rules])))
    return seq.select(id_col, "n_known", "sequence", first(0).alias("rule"), first(1).alias("license"), F.array_join(every, ",").alias("all_licenses"))
